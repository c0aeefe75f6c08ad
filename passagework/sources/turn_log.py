"""The conversation log: JSON lines, appended to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import is_blank

TURN_SCHEMA = "conv_id string, turn bigint, role string, content string, ts timestamp"
SESSION = "session"


def append_turns(turns: DataFrame, path: str) -> None:
    """Append messages; ``ts`` is written as ISO 8601."""
    turns.write.mode("append").json(path)


def load_turns(spark: SparkSession, path: str, on_bad: str = "drop") -> DataFrame:
    """All logged messages: ``conv_id, turn, role, content, ts, line``.

    Blank lines are skipped. A line that does not parse is dropped, or makes the
    whole log count as empty with ``on_bad="empty"``. A log without conversation
    ids is one conversation. ``line`` sorts as the lines were appended (time and
    name of the file, then the place in it) and breaks ties of ``ts`` and ``turn``.
    """
    if on_bad not in ("drop", "empty"):
        raise ValueError("on_bad is 'drop' or 'empty'")
    parsed = _parsed(spark, path)
    if parsed is None:
        return spark.createDataFrame([], f"{TURN_SCHEMA}, line string")
    good = parsed.where(~F.col("bad")).select(
        F.coalesce("t.conv_id", F.lit(SESSION)).alias("conv_id"),
        "t.turn",
        "t.role",
        "t.content",
        "t.ts",
        "line",
    )
    if on_bad == "empty" and not parsed.where("bad").isEmpty():
        return good.limit(0)
    return good


def count_bad_turns(spark: SparkSession, path: str) -> DataFrame:
    """How many lines of the log do not parse."""
    parsed = _parsed(spark, path)
    if parsed is None:
        return spark.createDataFrame([(0,)], "n_bad bigint")
    return parsed.agg(F.count_if("bad").alias("n_bad"))


def _parsed(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    schema = f"{TURN_SCHEMA}, _corrupt_record string"
    turn = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return (
        lines.where(~is_blank("value"))
        .withColumn("line", _place())
        .withColumn("t", turn)
        .withColumn(
            "bad", F.col("t._corrupt_record").isNotNull() | F.col("t.role").isNull()
        )
    )


def _place() -> Column:
    """Where a line stands in the log; within a block of a file ids follow its lines."""
    file = F.col("_metadata")
    return F.format_string(
        "%016d %s %016d %020d",
        F.unix_millis(file["file_modification_time"]),
        file["file_path"],
        file["file_block_start"],
        F.monotonically_increasing_id(),
    )


def reset_turns(spark: SparkSession, path: str) -> None:
    """Replace the log by an empty one."""
    spark.createDataFrame([], TURN_SCHEMA).write.mode("overwrite").json(path)
