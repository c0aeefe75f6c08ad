"""Registered queries: datasets, splits, order, tokens, batches and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog.common import SQL_TOKEN, sql_strip, sql_text, table, texts, turns
from passagework.functions.fixed_values import (
    BASE_SYSTEM,
    DEFAULT_TEST_SHARE,
    FORECAST_SYSTEM,
    SCORE_TASK_TEST_SHARE,
)
from passagework.operators.ordering import (
    concat_datasets,
    global_position,
    seeded_shuffle,
    train_test_split,
    train_test_splits,
)
from passagework.operators.training import (
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


def _dialogue(spark, sf_dir):
    """Each user message with the assistant message right after it, if there is one.

    Joined on conversation and turn, so a long conversation spreads over tasks.
    """
    said = turns(spark, sf_dir)
    asked = said.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("content").alias("instruction")
    )
    replied = said.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("output")
    )
    pairs = asked.join(replied, ["conv_id", "turn"], "left")
    return pairs.select(
        F.concat_ws("/", F.lit("conv"), "conv_id", "turn").alias("example_id"),
        "instruction",
        "output",
    )


def _readings(spark, sf_dir):
    """Every document as an example: its source asked, its text answered."""
    return texts(spark, sf_dir).select(
        F.concat_ws("/", F.lit("doc"), "doc_id").alias("example_id"),
        F.col("source").alias("instruction"),
        F.col("lang").alias("input"),
        F.col("text").alias("output"),
    )


def _joined(ids="input_ids"):
    return F.array_join(F.transform(ids, lambda t: t.cast("string")), " ")


def _tokens(spark, sf_dir, max_len=512):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return tokenize(docs, max_len=max_len)


def q_sft_format(spark, sf_dir):
    return prepare_sft(_dialogue(spark, sf_dir), keep=["example_id"], max_tokens=150)


def q_sft_with_input(spark, sf_dir):
    return prepare_sft(_readings(spark, sf_dir), keep=["example_id"], include_input=True)


def q_sft_forecasts(spark, sf_dir):
    pairs = _dialogue(spark, sf_dir).withColumnsRenamed(
        {"instruction": "prompt", "output": "answer"}
    )
    return prepare_forecasts(pairs, keep=["example_id"])


def q_sft_retention(spark, sf_dir):
    kept = retention(format_examples(_readings(spark, sf_dir)), "input")
    return kept.withColumn("retention_pct", F.round("retention_pct", 6))


def q_concat_datasets(spark, sf_dir):
    return concat_datasets(
        conversations=table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"),
        documents=table(spark, sf_dir, "documents").select("doc_id", "text"),
        benchmark=table(spark, sf_dir, "benchmark").select("item_id", "text"),
    )


def q_dataset_sizes(spark, sf_dir):
    return dataset_sizes(q_concat_datasets(spark, sf_dir))


def q_train_test_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    shares = {"quarter": DEFAULT_TEST_SHARE, "scored": SCORE_TASK_TEST_SHARE}
    both = train_test_splits(docs, "doc_id", shares)
    return train_test_split(both, "doc_id", exact=False).withColumnRenamed("split", "hashed")


def q_seeded_shuffle(spark, sf_dir):
    return seeded_shuffle(
        table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", position="position"
    )


def q_tokenize(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return tokens.select(
        "doc_id", F.size("input_ids").alias("n_ids"), _joined().alias("input_ids")
    )


def word_lengths():
    """Stands in for a tokenizer: one id per word, its length."""
    return lambda batch: [[len(word) for word in text.split(" ")] for text in batch]


def q_tokenize_model(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    tokens = tokenize(docs, ModelTokenizer(word_lengths), None)
    return tokens.select("doc_id", _joined().alias("input_ids"))


def q_collate(spark, sf_dir):
    batches = collate(_tokens(spark, sf_dir), 16, "doc_id")
    return batches.select(
        "doc_id",
        "batch_id",
        _joined().alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
        F.size("attention_mask").alias("width"),
        _joined("labels").alias("labels"),
    )


def q_pack_sequences(spark, sf_dir):
    """Whole texts, not cut, in blocks of 2,048 tokens."""
    packed = pack_sequences(_tokens(spark, sf_dir, None), 2048, "doc_id")
    return packed.select(
        F.col("block_id").cast("bigint"),
        F.size("input_ids").alias("n_ids"),
        _joined().alias("input_ids"),
    )


def q_training_steps(spark, sf_dir):
    kept = prepare_sft(_readings(spark, sf_dir), keep=["example_id"])
    return training_steps(kept)


def q_build_training_set(spark, sf_dir):
    sources = {"dialogue": _dialogue(spark, sf_dir), "readings": _readings(spark, sf_dir)}
    built = build_training_set(sources, position="position")
    return built.select(
        "example_id", "dataset", "position", _joined().alias("input_ids")
    )


def q_global_position(spark, sf_dir):
    """Another seed, text keys: the place of every dialogue example."""
    return global_position(_dialogue(spark, sf_dir).select("example_id"), "example_id", 7)


QUERIES = {
    "sft_format": q_sft_format,
    "sft_with_input": q_sft_with_input,
    "sft_forecasts": q_sft_forecasts,
    "sft_retention": q_sft_retention,
    "concat_datasets": q_concat_datasets,
    "dataset_sizes": q_dataset_sizes,
    "train_test_split": q_train_test_split,
    "seeded_shuffle": q_seeded_shuffle,
    "global_position": q_global_position,
    "tokenize": q_tokenize,
    "tokenize_model": q_tokenize_model,
    "collate": q_collate,
    "pack_sequences": q_pack_sequences,
    "training_steps": q_training_steps,
    "build_training_set": q_build_training_set,
}

_NL = "chr(10)"


def _sql_chat(system: str, user: str, assistant: str) -> str:
    def turn(role, content):
        return f"'<|im_start|>{role}' || {_NL} || {content} || '<|im_end|>' || {_NL}"

    return " || ".join(
        [turn("system", sql_text(system)), turn("user", user), turn("assistant", assistant)]
    )


_DIALOGUE = """
dialogue AS (
    SELECT 'conv/' || a.conv_id || '/' || a.turn AS example_id,
           a.text AS instruction, b.text AS output
    FROM conversations a
    LEFT JOIN conversations b
        ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
    WHERE a.role = 'user')
"""
_READINGS = """
readings AS (
    SELECT 'doc/' || doc_id AS example_id, source AS instruction, lang AS input, text AS output
    FROM documents)
"""


def _sql_formatted(name: str, source: str, prompt: str, tag: str = "NULL") -> str:
    return f"""
{name} AS (
    SELECT *, len(regexp_extract_all(text, {SQL_TOKEN})) AS n_tokens
    FROM (SELECT *, {tag} AS dataset,
                 {_sql_chat(BASE_SYSTEM, prompt, "coalesce(output, '')")} AS text
          FROM {source}))
"""


def _sql_ids(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all({text}, {SQL_TOKEN}), "
        "lambda t: CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) % 1048574 + 2)"
    )


def _sql_joined(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


ORACLES = {
    "sft_format": f"""
        WITH {_DIALOGUE}, {_sql_formatted('formatted', 'dialogue', 'instruction')}
        SELECT example_id, text FROM formatted WHERE n_tokens <= 150""",
    "sft_with_input": f"""
        WITH {_READINGS},
        {_sql_formatted('formatted', 'readings', "instruction || chr(10) || 'Input: ' || input")}
        SELECT example_id, text FROM formatted WHERE n_tokens <= 512""",
    "sft_forecasts": f"""
        WITH {_DIALOGUE},
        trimmed AS (
            SELECT example_id, {sql_strip('instruction')} AS prompt,
                   {sql_strip("coalesce(output, '')")} AS answer
            FROM dialogue),
        formatted AS (
            SELECT example_id, {_sql_chat(FORECAST_SYSTEM, 'prompt', 'answer')} AS text
            FROM trimmed WHERE prompt <> '' AND answer <> '')
        SELECT example_id, text FROM formatted
        WHERE len(regexp_extract_all(text, {SQL_TOKEN})) <= 2048""",
    "sft_retention": f"""
        WITH {_READINGS}, {_sql_formatted('formatted', 'readings', 'instruction')}
        SELECT input, count(*) AS n_raw, count(*) FILTER (n_tokens <= 512) AS n_kept,
               round(count(*) FILTER (n_tokens <= 512)::DOUBLE / count(*) * 100, 6)
                   AS retention_pct
        FROM formatted GROUP BY input""",
    "concat_datasets": """
        SELECT conv_id, turn, text, 'conversations' AS dataset, NULL::BIGINT AS doc_id,
               NULL::BIGINT AS item_id FROM conversations
        UNION ALL
        SELECT NULL, NULL, text, 'documents', doc_id, NULL FROM documents
        UNION ALL
        SELECT NULL, NULL, text, 'benchmark', NULL, item_id FROM benchmark""",
    "dataset_sizes": """
        SELECT 'conversations' AS dataset, count(*) AS n_rows FROM conversations
        UNION ALL SELECT 'documents', count(*) FROM documents
        UNION ALL SELECT 'benchmark', count(*) FROM benchmark""",
    "train_test_split": """
        WITH placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS i,
                   count(*) OVER () AS n,
                   CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
                       AS share
            FROM documents)
        SELECT doc_id,
               CASE WHEN i <= ceil(n * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS quarter,
               CASE WHEN i <= ceil(n * 0.226::DOUBLE) THEN 'test' ELSE 'train' END AS scored,
               CASE WHEN share < 0.25 THEN 'test' ELSE 'train' END AS hashed
        FROM placed""",
    "seeded_shuffle": """
        SELECT o_orderkey,
               row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS position
        FROM orders""",
    "global_position": f"""
        WITH {_DIALOGUE}
        SELECT example_id,
               row_number() OVER (ORDER BY md5('7:' || example_id), example_id) - 1 AS position
        FROM dialogue""",
    "tokenize": f"""
        WITH cut AS (SELECT doc_id, {_sql_ids('text')}[1:512] AS ids FROM documents)
        SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, {_sql_joined('ids')} AS input_ids
        FROM cut""",
    "tokenize_model": """
        SELECT doc_id,
               array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ' ')
                   AS input_ids
        FROM documents""",
    "collate": f"""
        WITH cut AS (
            SELECT doc_id, {_sql_ids('text')}[1:512] AS ids,
                   (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) // 16
                       AS batch_id
            FROM documents),
        padded AS (
            SELECT *, CAST(max(len(ids)) OVER (PARTITION BY batch_id) AS INTEGER) AS width
            FROM cut)
        SELECT doc_id, batch_id, CAST(len(ids) AS INTEGER) AS n_real, width,
               {_sql_joined("ids || list_transform(range(width - len(ids)), lambda x: 0)")}
                   AS input_ids,
               {_sql_joined("ids || list_transform(range(width - len(ids)), lambda x: -100)")}
                   AS labels
        FROM padded""",
    "pack_sequences": f"""
        WITH closed AS (
            SELECT doc_id, md5('42:' || doc_id) AS h, {_sql_ids('text')} || [1] AS ids
            FROM documents),
        starts AS (
            SELECT *, coalesce(sum(len(ids)) OVER (
                       ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                       AS start
            FROM closed),
        tokens AS (
            SELECT CAST(start AS BIGINT) + unnest(range(len(ids))) AS place, unnest(ids) AS id
            FROM starts)
        SELECT place // 2048 AS block_id, CAST(count(*) AS INTEGER) AS n_ids,
               string_agg(id, ' ' ORDER BY place) AS input_ids
        FROM tokens GROUP BY block_id""",
    "training_steps": f"""
        WITH {_READINGS}, {_sql_formatted('formatted', 'readings', 'instruction')}
        SELECT count(*) AS n_rows, CAST(count(*) // 16 * 3 AS BIGINT) AS training_steps
        FROM formatted WHERE n_tokens <= 512""",
    "build_training_set": f"""
        WITH {_DIALOGUE}, {_READINGS},
        {_sql_formatted('a', 'dialogue', 'instruction', "'dialogue'")},
        {_sql_formatted('b', 'readings', 'instruction', "'readings'")},
        both_sets AS (
            SELECT example_id, dataset, text FROM a WHERE n_tokens <= 512
            UNION ALL SELECT example_id, dataset, text FROM b WHERE n_tokens <= 512)
        SELECT example_id, dataset,
               row_number() OVER (ORDER BY md5('42:' || example_id), example_id) - 1 AS position,
               {_sql_joined(_sql_ids('text') + '[1:512]')} AS input_ids
        FROM both_sets""",
}
