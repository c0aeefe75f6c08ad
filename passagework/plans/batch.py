"""A file of questions to a file of answers."""

from __future__ import annotations

import uuid
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.plans.answer import answer_queries, new_turns, retrieve
from passagework.session import shared_folder, written
from passagework.sources.files import is_complete, names
from passagework.sources.query_files import read_queries, write_results
from passagework.sources.turn_log import append_turns


def run_batch(
    spark: SparkSession,
    questions: str,
    answers: str,
    index: DataFrame,
    models,
    mode: str = "errorifexists",
    log: str | None = None,
    **options,
) -> None:
    """Every line is answered on its own: a bad one gets an error, the rest go on.

    With ``log`` the questions and their answers are also appended to that
    conversation log; an evaluation leaves it out. The answers are then kept in
    the shared folder first, so that the models are asked once.
    """
    queries = read_queries(spark, questions)
    answered = answer_queries(queries, index, models, **options)
    if log is not None:
        kept = shared_folder(spark, "answered")
        answered.write.parquet(kept)
        answered = spark.read.parquet(kept)
    write_results(answered, answers, mode)
    if log is not None:
        append_turns(new_turns(answered), log)


LEDGER = (
    "key string, answer string, agent_used string, rag_status string, rag_warning string, "
    "error string"
)
SLICES = 8
# What a slice needs of its questions, and the options that do not concern the search.
RETRIEVED = ["query_id", "query", "agent_used", "rag_status", "rag_warning", "system_prompt",
             "user_prompt"]
ANSWERING = ("turns", "history", "budget", "limit", "order", "template", "keep", "columns")


def _slice(slices: int):
    return F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")


def resume_batch(
    spark: SparkSession,
    questions: str,
    answers: str,
    index: DataFrame,
    models,
    log: str | None = None,
    ledger: str | None = None,
    slices: int = SLICES,
    **options,
) -> None:
    """Like :func:`run_batch`, but one that was stopped goes on where it was.

    The different questions of the file are answered in ``slices``, each of which is
    written to the ``ledger`` in full or not at all (a folder beside the answers by
    default). Started again, also on a file that has grown, only questions without an
    answer in the ledger are asked, those that failed too. A question that stands on
    several lines is asked once. At the end the answers are written, one line for every
    line of the file, and with ``log`` the conversation log of this batch, both in place
    of those of an earlier run.
    """
    ledger = (ledger or f"{answers.rstrip('/')}-ledger").rstrip("/")
    queries = read_queries(spark, questions)
    key = F.md5("query").alias("key")
    good = queries.where(F.col("error").isNull())
    different = good.select(key, "query").dropDuplicates(["key"])
    done = answered_so_far(spark, ledger).where(F.col("error").isNull()).select("key")
    todo = different.join(done, "key", "left_anti").select(F.col("key").alias("query_id"), "query")
    answering = {"columns": RETRIEVED} | {n: options.pop(n) for n in ANSWERING if n in options}
    if not todo.isEmpty():
        # One search for all that is open, or every slice would read the whole index.
        found, _ = retrieve(todo, index, **options)
        found = written(found.select(*RETRIEVED, _slice(slices).alias("_slice")), "retrieved")
        for (number,) in found.select("_slice").distinct().orderBy("_slice").collect():
            own = found.where(F.col("_slice") == number).drop("_slice")
            answered = answer_queries(own, index, models, **answering)
            fields = [f.split()[0] for f in LEDGER.split(", ")[1:]]
            answered.select(F.col("query_id").alias("key"), *fields).write.parquet(
                f"{ledger}/{number:04d}-{uuid.uuid4().hex}"
            )
    fields = [F.col(f.split()[0]) for f in LEDGER.split(", ")[1:]]
    # A success is kept before a failure of an earlier run.
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), *fields)).alias("best")
    known = answered_so_far(spark, ledger).groupBy("key").agg(best).select(
        F.col("key").alias("_key"), "best.*"
    ).withColumnRenamed("error", "_error")
    lines = queries.join(known, F.md5("query") == F.col("_key"), "left").withColumn(
        "error", F.coalesce("error", "_error")
    )
    write_results(lines, answers, "overwrite")
    if log is not None:
        said = new_turns(lines.where(F.col("error").isNull()))
        said.write.mode("overwrite").json(
            f"{log.rstrip('/')}/batch-{md5(answers.encode()).hexdigest()[:12]}"
        )


def answered_so_far(spark: SparkSession, ledger: str) -> DataFrame:
    """The answers in the slices that were written to their end."""
    parts = [f"{ledger}/{name}" for name in names(spark, ledger)]
    whole = [part for part in parts if is_complete(spark, part)]
    if not whole:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*whole)
