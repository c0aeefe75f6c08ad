"""Files of questions in, files of answers out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import is_blank, strip

RESULT_FIELDS = ["query", "answer", "agent_used", "rag_status", "rag_warning", "error"]


def read_queries(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Questions as ``query_id, query, error``; ``kind`` is ``txt`` or ``jsonl``.

    Without ``kind`` it follows from the ending. Blank lines are skipped. A line
    of JSON that does not parse, or has no query, stays as a row with an error,
    so that the answers show it.
    """
    kind = kind or ("jsonl" if path.rstrip("/").endswith((".jsonl", ".json")) else "txt")
    if kind not in ("txt", "jsonl"):
        raise ValueError(f"unknown kind of query file: {kind}")
    lines = spark.read.text(path).where(~is_blank("value"))
    numbered = lines.withColumn("query_id", F.monotonically_increasing_id())
    if kind == "txt":
        return numbered.select(
            "query_id", strip("value").alias("query"), F.lit(None).cast("string").alias("error")
        )
    parsed = F.from_json("value", "query string", {"mode": "PERMISSIVE"})
    query = F.nullif(strip(parsed["query"]), F.lit(""))
    return numbered.select(
        "query_id",
        query.alias("query"),
        F.when(query.isNull(), "line is not a JSON object with a query").alias("error"),
    )


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with all fields on every line; failed rows have null model fields."""
    has_error = "error" in df.columns
    error = F.col("error") if has_error else F.lit(None).cast("string")
    failed = error.isNotNull()
    model_fields = [
        F.when(~failed, F.col(c)).alias(c)
        for c in ("answer", "agent_used", "rag_status", "rag_warning")
    ]
    lines = df.select("query", *model_fields, error.alias("error"))
    lines.write.mode(mode).option("ignoreNullFields", "false").json(path)
