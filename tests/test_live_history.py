"""The live view of conversations beside the batch view, batch by batch."""

from passagework.operators.history import prompt_history
from passagework.sources.turn_log import load_turns
from passagework.streaming.live_history import live_history, stream_history
from passagework.streaming.turn_stream import turn_files


def test_live_view_after_every_batch_and_restart(spark, tmp_path):
    source, view, checkpoint = (str(tmp_path / n) for n in ("in", "view", "checkpoint"))
    (tmp_path / "in").mkdir()
    drops = [
        [("a", 0), ("a", 1), ("b", 5)],
        [("a", t) for t in range(2, 40)] + [("c", 1)],
        [("b", 4), ("b", 9), ("b", 6)],
    ]
    for number, turns in enumerate(drops):
        lines = [f'{{"conv_id": "{c}", "turn": {t}, "role": "user", "content": "{c}{t}"}}' for c, t in turns]
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(lines + ['{"role": "user"}']))
        stream_history(turn_files(spark, source), view, checkpoint, n=4).awaitTermination()
        batch = prompt_history(load_turns(spark, source).where("turn is not null"), 4, order="turn")
        want = {r.conv_id: [m.content for m in r.history] for r in batch.collect()}
        got = {}
        for r in sorted(live_history(spark, view).collect(), key=lambda r: r.pos):
            got.setdefault(r.conv_id, []).append(r.content)
        assert got == want
    stream_history(turn_files(spark, source), view, checkpoint, n=4).awaitTermination()
    assert live_history(spark, view).count() == 4 + 4 + 1
