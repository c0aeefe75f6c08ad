"""Repair of conversations beside an exhaustive search of edits, and its odd inputs."""

import hashlib
import random
import zlib
from heapq import heappop, heappush

from pyspark.sql import functions as F

from passagework.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, fault string, _key string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """Cheapest edits by a search over (cost, audit), which meets the least of both first."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, out = heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        role_of = {"u": "user", "a": "assistant"}
        for letter, after in NEXT[state].items():
            if letter in role_of:
                heappush(queue, (cost + 5, audit + "I", i, after, (*out, (role_of[letter], ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                for letter, after in NEXT[state].items():
                    if role[:1] == letter:
                        heappush(queue, (cost + extra, audit + "K", i + 1, after, (*out, (role, text))))
                    if letter in role_of:
                        named = (*out, (role_of[letter], text))
                        heappush(queue, (cost + extra + 1, audit + "R", i + 1, after, named))


def plain(conversations):
    """The summary by conversation of (conv_id, turn, role, text) rows, unhurt."""
    groups = {}
    for conv, turn, role, text in conversations:
        groups.setdefault(conv, []).append(
            (turn, " " if role is None else role, " " if text is None else text)
        )
    found = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            core = text.rstrip(SPACE)
            fault = ""
            if not core:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif core[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append(fault)
        cost, audit, out = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        lines = "\n".join(f"{r}:{t}" for r, t in out)
        found[conv] = (
            gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(lines.encode()).hexdigest(),
        )
    return found


def frame_of(spark, rows):
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
    return df.repartition(3)


def found_by(df):
    rows = repair.repairs(df, run_rows=4).collect()
    found = {r[0]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def random_rows(seed, n_conv, n_turns):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "u", "tool", "", None]
    texts = ["a.", "b!", "c?\n", "d", " ", "", None, "é.", "e. \t"]
    rows = []
    for conv in range(n_conv):
        for turn in range(rnd.randint(1, n_turns)):
            turn = None if rnd.random() < 0.1 else turn * rnd.choice([1, 1, 2])
            text = rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.random()}."
            rows.append((None if conv == 0 else conv, turn, rnd.choice(roles), text))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_repairs_are_the_cheapest(spark):
    rows = random_rows(5, 150, 9)
    assert found_by(frame_of(spark, rows)) == plain(rows)


def test_long_conversation_over_many_batches_and_runs(spark):
    rows = random_rows(7, 3, 9) + [
        (77, t // 3, random.Random(t).choice(["user", "assistant"]), f"line {t % 1500}.")
        for t in range(6000)
    ]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert found_by(frame_of(spark, rows)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_turns_are_what_the_digest_says(spark):
    rows = random_rows(9, 40, 8)
    df = frame_of(spark, rows)
    lines = {}
    for r in sorted(repair.repaired_turns(df).collect(), key=lambda r: r.place):
        assert r.place == len(lines.setdefault(r.conv_id, []))
        assert r.edit in "KRI"
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, row in found_by(df).items():
        text = "\n".join(lines.get(conv, []))
        assert row[-1] == hashlib.sha256(text.encode()).hexdigest()
        initials = "".join(line[:1] for line in lines.get(conv, []))
        assert initials.removeprefix("s").replace("ua", "") == "" and initials != "s"


def test_very_long_text_and_empty_table(spark):
    long = "x. " * 300_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)]
    assert found_by(frame_of(spark, rows)) == plain(rows)
    assert repair.repairs(frame_of(spark, []).limit(0)).collect() == []
    assert repair.repaired_turns(frame_of(spark, []).limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", f"A. b! {c} {t}?") for c in range(40) for t in range(10)]
    rows += [(None, None, None, None), (3, None, "user", "x.")]
    found = repair.damaged(frame_of(spark, rows))
    assert found.columns == ["conv_id", "turn", "role", "text", "present"]
    by_key = {}
    for r in found.collect():
        by_key.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    for conv, turn, role, text in rows:
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(name.encode()) % 20
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(code, text)
        want = [("user" if code == 4 else role, text, code != 0)] * (2 if code == 3 else 1)
        assert by_key[conv, turn] == want


def test_conversation_without_rows_left(spark):
    df = frame_of(spark, [(5, 0, "user", "a."), (6, 0, "user", "a.")])
    rows = repair.repairs(df, F.col("conv_id") == 6).collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert found[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[6][5:7] == (2, "D")
