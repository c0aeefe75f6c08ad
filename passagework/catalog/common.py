"""Pieces shared by the registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.fixed_values import WHITESPACE
from passagework.operators.chunking import METADATA
from passagework.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, in enough partitions for work on its texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their metadata: source, the language in place of a ticker."""
    docs = texts(spark, sf_dir)
    metadata = F.struct(
        F.col("source"),
        F.when(F.col("lang") != "en", F.upper("lang")).alias("ticker"),
        F.lit(None).cast("string").alias("date"),
    )
    return docs.select("doc_id", "text", metadata.cast(METADATA).alias("metadata"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def sql_text(value: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + value.replace("'", "''") + "'"


SQL_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
SQL_TOKEN = "'[^ \\t\\n\\r\\f\\x0b]+'"
SQL_WORD = "'[\\p{L}\\p{N}]+'"


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {SQL_WS})"


SQL_CHUNKS = f"""
chunk_lists AS (
    SELECT doc_id, source, lang,
           list_filter(
               list_transform(range(0, length(text), 448),
                              lambda s: {sql_strip('substring(text, s + 1, 512)')}),
               lambda c: length(c) > 0) AS chunks
    FROM documents),
chunk_rows AS (
    SELECT doc_id, source, lang,
           CAST(unnest(range(len(chunks))) AS INTEGER) AS chunk_no, unnest(chunks) AS text
    FROM chunk_lists),
chunks AS (
    SELECT md5(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || '::' || chunk_no || ':' || text) AS chunk_id, * FROM chunk_rows)
"""


def sql_vectors(name: str, source: str, key: str, dim: int = 384) -> str:
    """CTEs ending in ``name(key, v)``: hashed word counts scaled to length one."""
    return f"""
{name}_words AS (
    SELECT {key}, unnest(regexp_extract_all(lower(text), {SQL_WORD})) AS w FROM {source}),
{name}_counts AS (
    SELECT {key}, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % {dim} AS b, count(*) AS n
    FROM {name}_words GROUP BY ALL),
{name}_maps AS (
    SELECT {key}, map(list(b), list(n)) AS m, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm
    FROM {name}_counts GROUP BY {key}),
{name} AS (
    SELECT {key},
           list_transform(range({dim}),
               lambda b: CAST(CAST(coalesce(m[b], 0) / norm AS FLOAT) AS DOUBLE)) AS v
    FROM {name}_maps)
"""


def sql_distance(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({a}, {b}), "
        "lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    )
