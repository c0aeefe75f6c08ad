"""Datasets, order, tokens, batches and blocks against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from passagework.functions.fixed_values import BASE_SYSTEM, FORECAST_SYSTEM
from passagework.operators.ordering import (
    concat_datasets,
    global_position,
    running_total,
    seeded_shuffle,
    train_test_split,
    train_test_splits,
)
from passagework.operators.training import (
    HashedTokenizer,
    ModelTokenizer,
    collate,
    dataset_sizes,
    format_examples,
    pack_sequences,
    prepare_forecasts,
    prepare_sft,
    retention,
    tokenize,
    training_steps,
)
from passagework.plans.training_set import build_training_set


def ordered(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


def chat(system, user, answer):
    return (
        f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n"
        f"<|im_start|>assistant\n{answer}<|im_end|>\n"
    )


def test_prepare_sft(spark):
    rows = [("a", "ask", "in", "out"), ("b", None, None, "out"), ("c", "ask", "", None)]
    df = spark.createDataFrame(rows, "id string, instruction string, input string, output string")
    got = {r.id: r.text for r in prepare_sft(df, keep=["id"]).collect()}
    assert got == {
        "a": chat(BASE_SYSTEM, "ask", "out"),
        "b": chat(BASE_SYSTEM, "", "out"),
        "c": chat(BASE_SYSTEM, "ask", ""),
    }
    with_input = prepare_sft(df, keep=["id"], include_input=True).where("id = 'a'").first().text
    assert with_input == chat(BASE_SYSTEM, "ask\nInput: in", "out")
    assert prepare_sft(df).columns == ["text"]


def test_the_limit_itself_still_passes(spark):
    rows = [(n, "w " * n, "o") for n in (5, 6)]
    df = spark.createDataFrame(rows, "n int, instruction string, output string")
    longest = len(chat(BASE_SYSTEM, "w " * 5, "o").split())
    got = format_examples(df, max_tokens=longest).orderBy("n").collect()
    assert [(r.n_tokens - longest, r.valid) for r in got] == [(0, True), (1, False)]
    kept = retention(format_examples(df, max_tokens=longest)).first()
    assert (kept.n_raw, kept.n_kept, kept.retention_pct) == (2, 1, 50.0)


def test_callers_token_count(spark):
    df = spark.createDataFrame([("ask", "out")], "instruction string, output string")
    counted = format_examples(df, token_count=F.length, max_tokens=10).first()
    assert counted.n_tokens == len(chat(BASE_SYSTEM, "ask", "out")) and not counted.valid


def test_forecasts_need_both_sides(spark):
    rows = [(1, " p \n", " a "), (2, "  ", "a"), (3, "p", None), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, prompt string, answer string")
    got = prepare_forecasts(df, keep=["id"]).collect()
    assert [(r.id, r.text) for r in got] == [(1, chat(FORECAST_SYSTEM, "p", "a"))]


@pytest.mark.parametrize("partitions", [1, 8])
def test_order_and_split_do_not_depend_on_partitions(spark, partitions):
    keys = list(range(1003))
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(partitions)
    expected = ordered(keys)
    placed = {r.k: r.position for r in global_position(df, "k").collect()}
    assert placed == {k: i for i, k in enumerate(expected)}
    assert [r.k for r in seeded_shuffle(df, "k").collect()] == expected
    for share in (0.25, 0.226, 0.001, 0.999):
        split = train_test_split(df, "k", share).where("split = 'test'").collect()
        assert {r.k for r in split} == set(expected[: math.ceil(len(keys) * share)])
    rough = train_test_split(df, "k", 0.25, exact=False).where("split = 'test'").count()
    assert 200 < rough < 300


def test_split_of_nothing_and_one(spark):
    df = spark.createDataFrame([("only",)], "k string")
    assert [r.split for r in train_test_split(df, "k").collect()] == ["test"]
    assert train_test_split(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        train_test_split(df, "k", 1.0)


def test_another_seed_gives_another_order(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in seeded_shuffle(df, "k", 1).collect()]
    b = [r.k for r in seeded_shuffle(df, "k", 2).collect()]
    assert a == ordered(range(100), 1) and a != b and sorted(a) == sorted(b)


def test_running_total(spark):
    rows = [(k, k % 7) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, n int")
    got = {r.k: r.start for r in running_total(df, "k", F.col("n")).collect()}
    total = 0
    for k in ordered(range(300)):
        assert got[k] == total
        total += k % 7


def test_concat_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "id int, text string")
    b = spark.createDataFrame([("x", 2.0)], "text string, extra double")
    both = concat_datasets(a=a, b=b)
    assert {(r.dataset, r.n_rows) for r in dataset_sizes(both).collect()} == {("a", 2), ("b", 1)}
    assert both.where("dataset = 'b'").first().id is None


def python_ids(text, max_len=None, room=(1 << 20) - 2):
    tokens = text.split()[:max_len]
    return [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % room + 2 for t in tokens]


def load_characters():
    return lambda texts: [[ord(c) for c in t] for t in texts]


def test_tokenize(spark):
    texts = ["a b  c\n\td", "", "é x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.input_ids for r in tokenize(df, max_len=3).collect()}
    assert got == {i: python_ids(t, 3) for i, t in enumerate(texts)}
    model = tokenize(df, ModelTokenizer(load_characters), max_len=2).collect()
    assert {r.i: r.input_ids for r in model} == {0: [97, 32], 1: [], 2: [233, 32]}
    assert tokenize(df, HashedTokenizer(16), None).select(
        F.max(F.array_max("input_ids")), F.min(F.array_min("input_ids"))
    ).first()[0] < 16


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(9)
    rows = [(k, [rng.randint(2, 99) for _ in range(rng.choice([0, 1, 3, 40]))]) for k in range(57)]
    return rows, spark.createDataFrame(rows, "k int, input_ids array<int>").repartition(6)


def test_collate(sequences):
    rows, df = sequences
    by_key = dict(rows)
    order = ordered(by_key)
    got = {r.k: r for r in collate(df, 8, "k").collect()}
    for start in range(0, len(order), 8):
        batch = order[start : start + 8]
        width = max(len(by_key[k]) for k in batch)
        for k in batch:
            gap = width - len(by_key[k])
            assert got[k].batch_id == start // 8
            assert got[k].input_ids == by_key[k] + [0] * gap
            assert got[k].labels == by_key[k] + [-100] * gap
            assert got[k].attention_mask == [1] * len(by_key[k]) + [0] * gap


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_pack_sequences(sequences, block):
    rows, df = sequences
    by_key = dict(rows)
    stream = [t for k in ordered(by_key) for t in [*by_key[k], 1]]
    blocks = [stream[i : i + block] for i in range(0, len(stream), block)]
    got = {r.block_id: r.input_ids for r in pack_sequences(df, block, "k").collect()}
    assert got == dict(enumerate(blocks))
    full = pack_sequences(df, block, "k", drop_last=True).count()
    assert full == len(stream) // block


def test_training_steps(spark):
    assert training_steps(spark.range(100)).first().training_steps == 100 // 16 * 3
    assert training_steps(spark.range(0)).first().training_steps == 0


def test_build_training_set(spark):
    a = spark.createDataFrame([("a1", "q", "x"), ("a2", "q", "w " * 600)],
                              "example_id string, instruction string, output string")
    b = spark.createDataFrame([("b1", "r", "y")], "example_id string, instruction string, output string")
    built = build_training_set({"a": a, "b": b})
    assert [r.example_id for r in built.collect()] == ordered(["a1", "b1"])
    assert built.columns == ["example_id", "dataset", "input_ids"]
    ids = built.where("example_id = 'b1'").first().input_ids
    assert ids == python_ids(chat(BASE_SYSTEM, "r", "y"))


def test_no_window_over_the_whole_table(spark):
    """Only the table of bucket totals may meet in one task."""
    df = spark.range(1000).withColumnRenamed("id", "k")
    for plan in (global_position(df, "k"), train_test_split(df, "k")):
        text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        before_single = text.split("Exchange SinglePartition")
        for part in before_single[1:]:
            assert "HashAggregate(keys=[_bucket" in part.split("Exchange")[0]


def test_exact_splits_move_no_rows(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(300)] + [(None, 1)], "k int, other int")
    split = train_test_splits(df, "k", {"a": 0.1, "b": 0.5})
    order = ordered(range(300))
    for name, n in (("a", 30), ("b", 150)):
        assert {r.k for r in split.where(f"{name} = 'test'").collect()} == set(order[:n])
    assert split.count() == 301 and split.columns == ["k", "other", "a", "b"]
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
