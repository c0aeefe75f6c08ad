"""Evaluation reports, every run kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(
    results: DataFrame, path: str, run_ts: str, notes: dict | None = None, references=()
) -> None:
    """Append a run under its timestamp (``yyyyMMdd_HHmmss``).

    Every task carries the date of the run, a note on its dataset and the published
    scores it stands beside: ``references`` are (task, system, score) or a null score.
    """
    by_task: dict[str, list] = {}
    for task, system, score in references:
        by_task.setdefault(task, []).append((system, score))
    published = {
        task: F.create_map(*[F.lit(x) for s, v in own for x in (s, v)]).cast("map<string,double>")
        for task, own in by_task.items()
    }
    stamped = results.withColumns(
        {
            "dataset_note": _by_task({t: F.lit(n) for t, n in (notes or {}).items()}, "string"),
            "references": _by_task(published, "map<string,double>"),
            "run_date": F.date_format(
                F.to_timestamp(F.lit(run_ts), "yyyyMMdd_HHmmss"), "yyyy-MM-dd HH:mm"
            ),
            "run_ts": F.lit(run_ts),
        }
    )
    stamped.write.mode("append").partitionBy("run_ts").parquet(path)


def _by_task(values: dict, kind: str) -> Column:
    """The value of a row's task, null for others; tasks are a handful of names."""
    found = F.lit(None).cast(kind)
    for task, value in values.items():
        found = F.when(F.col("task") == task, value).otherwise(found)
    return found


def read_report(spark: SparkSession, path: str, run_ts: str | None = None) -> DataFrame:
    """A run by its timestamp, or the latest one."""
    runs = spark.read.parquet(path).withColumn("run_ts", F.col("run_ts").cast("string"))
    if run_ts is not None:
        return runs.where(F.col("run_ts") == run_ts)
    latest = runs.agg(F.max("run_ts").alias("run_ts"))
    return runs.join(F.broadcast(latest), "run_ts")  # one row
