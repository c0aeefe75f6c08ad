"""The shard files that op8_training_order leaves in the shared folder."""

import glob

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from passagework.llm import queries, training_order

SF = "/root/testdata/sf0.001"


def test_query_writes_its_shards(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/shards"
    monkeypatch.setattr(queries, "shared_folder", lambda *_: folder, raising=False)
    rows = sorted(queries.op8_training_order(spark, SF).collect(), key=lambda r: r.slot)
    files = sorted(glob.glob(f"{tmp_path}/shards/*"))
    assert [f[-12:] for f in files] == [f"{s:08d}.bin" for s in sorted({r.shard for r in rows})]
    assert b"".join(open(f, "rb").read() for f in files) == b"".join(r.tokens for r in rows)
    path_of = lambda shard: f"{folder}/shard-{shard:08d}.bin"
    want = training_order.training_order(
        queries.table(spark, SF, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    assert rows == sorted(want.collect(), key=lambda r: r.slot)
    for slot, ids in zip([0, len(rows) - 1], training_order.read_slots(
        path_of, [0, len(rows) - 1], 1024, 4096
    )):
        assert ids.tobytes() == bytes(rows[slot].tokens)


def test_every_task_gets_a_range_of_slots(spark, frame):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(60)]
    records = training_order.training_order(
        frame(texts), public_tokenizers.path("piece_bpe_32k.model"), length=64, shard_slots=8
    )
    tasks = {}
    for r in records.select("slot", "shard", F.spark_partition_id().alias("task")).collect():
        tasks.setdefault(r.task, []).append((r.slot, r.shard))
    shards = max(s for rows in tasks.values() for _, s in rows) + 1
    assert shards > 3 and len(tasks) == shards
    for task, rows in tasks.items():
        assert {shard for _, shard in rows} == {task}
        assert (np.diff([slot for slot, _ in rows]) == 1).all()
