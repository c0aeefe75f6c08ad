"""Registered queries: files, the index store, logs, reports, profiles, streams.

Queries that write put their files below the folder of ``shared_folder``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog.common import SQL_CHUNKS, documents, sql_strip, table, turns
from passagework.catalog.evaluation import ORACLES as EVALUATION
from passagework.catalog.evaluation import PUBLISHED
from passagework.catalog.evaluation import q_task_results
from passagework.catalog.questions import ORACLES as QUESTIONS
from passagework.functions.fixed_values import PUBLISHED_SCORES
from passagework.operators.chunking import METADATA, index_documents
from passagework.operators.embedding import HashedEmbedder
from passagework.operators.history import prompt_history, prune_turns
from passagework.operators.ordering import train_test_split
from passagework.operators.tickers import ticker_profiles
from passagework.session import shared_folder, written
from passagework.sources.documents import read_documents, read_split, write_splits
from passagework.sources.index_store import append_index, clear_index, load_index
from passagework.sources.index_versions import (
    TickerSectionMissing,
    compact,
    delete_documents,
    load_version,
    put_documents,
    refresh_tickers,
)
from passagework.sources.query_files import read_queries
from passagework.sources.reports import read_report, write_report
from passagework.sources.turn_log import (
    append_turns,
    count_bad_turns,
    load_turns,
    reset_turns,
)
from passagework.streaming.index_stream import stream_documents, stream_index
from passagework.streaming.live_history import live_history, stream_history
from passagework.streaming.turn_stream import stream_turns

EMBEDDER = HashedEmbedder()


def _index_rows(index):
    return index.select(
        "chunk_id", "doc_id", "chunk_no", "text", F.col("metadata.source").alias("source"),
        F.size("embedding").alias("dim"), "model_name",
    )


def _arriving(spark, sf_dir, name, schema):
    """A table as a stream, be it one file or a folder of files: a pattern may meet either."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def q_index_store(spark, sf_dir):
    """Written, written again without effect, and read back."""
    path = shared_folder(spark, "index")
    rows = index_documents(documents(spark, sf_dir), EMBEDDER)
    append_index(rows, path)
    append_index(rows, path, skip_existing=True)
    return _index_rows(load_index(spark, path, EMBEDDER.name))


def q_stream_index(spark, sf_dir):
    path, checkpoint = shared_folder(spark, "index"), shared_folder(spark, "stream")
    schema = "doc_id bigint, text string, source string"
    arriving = _arriving(spark, sf_dir, "documents", schema)
    metadata = F.struct("source", F.lit(None).alias("ticker"), F.lit(None).alias("date"))
    docs = arriving.select("doc_id", "text", metadata.cast(METADATA).alias("metadata"))
    docs = docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")  # one file arrives
    stream_index(docs, path, checkpoint, EMBEDDER).awaitTermination()
    return _index_rows(load_index(spark, path, EMBEDDER.name))


def q_index_life(spark, sf_dir):
    """Streamed, cleared, streamed on, appended to: English documents come last, half of them
    in the stream and all in the append."""
    path = shared_folder(spark, "index")
    docs = documents(spark, sf_dir)
    parts = shared_folder(spark, "arriving")
    english = F.col("metadata.ticker").isNull()
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0

    def arrive(rows):
        rows.select("doc_id", "text", "metadata").write.mode("append").parquet(parts)
        arriving = spark.readStream.schema(rows.schema).parquet(parts)
        stream_index(arriving, path, f"{parts}-checkpoint", EMBEDDER).awaitTermination()

    arrive(docs.where(~english))
    clear_index(spark, path)
    arrive(docs.where(english & half))
    append_index(index_documents(docs.where(english), EMBEDDER), path, skip_existing=True)
    return _index_rows(load_index(spark, path, EMBEDDER.name))


def _changed(docs):
    """The French documents, each with a word more at its front."""
    return docs.where(F.col("metadata.ticker") == "FR").withColumn(
        "text", F.concat(F.lit("Nouveau. "), F.coalesce("text", F.lit("")))
    )


def q_index_versions(spark, sf_dir):
    """Put, replaced (French), deleted (German), compacted; beside what the first version had."""
    path = shared_folder(spark, "versions")
    docs = documents(spark, sf_dir)
    first = put_documents(index_documents(docs, EMBEDDER), path)
    put_documents(index_documents(_changed(docs), EMBEDDER), path)
    delete_documents(docs.where(F.col("metadata.ticker") == "DE"), path)
    compact(spark, path)
    before = load_version(spark, path, EMBEDDER.name, first).groupBy("doc_id").agg(
        F.count("*").alias("n_before")
    )
    rows = _index_rows(load_version(spark, path, EMBEDDER.name)).drop("model_name")
    return rows.join(before, "doc_id", "left")


def q_stream_versions(spark, sf_dir):
    """All documents arrive, then the French ones once more, changed."""
    path, parts = shared_folder(spark, "versions"), shared_folder(spark, "arriving")
    docs = documents(spark, sf_dir).select("doc_id", "text", "metadata")

    def arrive(rows):
        rows.write.mode("append").parquet(parts)
        arriving = spark.readStream.schema(rows.schema).parquet(parts)
        stream_documents(arriving, path, f"{parts}-checkpoint", EMBEDDER).awaitTermination()

    arrive(docs)
    arrive(_changed(docs))
    return _index_rows(load_version(spark, path, EMBEDDER.name)).drop("model_name")


def q_ticker_refresh(spark, sf_dir):
    """Profiles of before a year, then of today; one that lacks a section changes nothing."""
    path = shared_folder(spark, "tickers")
    rows = lambda docs: index_documents(docs, EMBEDDER, auto_chunk=False)
    early = written(_profiles(spark, sf_dir, "1996-01-01"), "early-profiles")
    late = written(_profiles(spark, sf_dir), "late-profiles")
    known = early.select(F.col("metadata.ticker").alias("ticker")).distinct()
    refresh_tickers(known, early, path, rows)
    everyone = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker")
    )
    try:
        refresh_tickers(everyone, late, path, rows)
        outcome = "refreshed"
    except TickerSectionMissing:
        outcome = "unchanged"
    unchanged = load_version(spark, path).select("doc_id", "text", F.lit(outcome).alias("step"))
    version = refresh_tickers(known, late, path, rows)
    fresh = load_version(spark, path, version=version).select(
        "doc_id", "text", F.lit("refreshed").alias("step")
    )
    return unchanged.unionByName(fresh)


def q_log_life(spark, sf_dir):
    """Streamed, reset, streamed on, appended to: user messages, then all others."""
    path, parts = shared_folder(spark, "turns"), shared_folder(spark, "arriving")
    said = turns(spark, sf_dir).select("conv_id", "turn", "role", "content")

    def arrive(rows):
        rows.write.mode("append").parquet(parts)
        arriving = spark.readStream.schema(said.schema).parquet(parts)
        stream_turns(arriving, path, f"{parts}-checkpoint").awaitTermination()

    arrive(said)
    reset_turns(spark, path)
    arrive(said.where(F.col("role") == "user"))
    append_turns(said.where(F.col("role") != "user"), path)
    kept = load_turns(spark, path)
    return kept.select(F.col("conv_id").cast("bigint"), "turn", "role", "content")


def q_stream_turns(spark, sf_dir):
    path, checkpoint = shared_folder(spark, "turns"), shared_folder(spark, "stream")
    schema = "conv_id bigint, turn bigint, role string, text string"
    arriving = _arriving(spark, sf_dir, "conversations", schema)
    said = arriving.select("conv_id", "turn", "role", F.col("text").alias("content"))
    stream_turns(said, path, checkpoint).awaitTermination()
    history = prompt_history(load_turns(spark, path), 4)
    return history.select(
        F.col("conv_id").cast("bigint"), F.posexplode("history").alias("pos", "m")
    ).select("conv_id", "pos", "m.role", "m.content")


def q_live_history(spark, sf_dir):
    """User messages arrive, then all others: the view that the stream keeps."""
    view, parts = shared_folder(spark, "live"), shared_folder(spark, "arriving")
    said = turns(spark, sf_dir).select("conv_id", "turn", "role", "content")
    for rows in (said.where("role = 'user'"), said.where("role <> 'user'")):
        rows.write.mode("append").parquet(parts)
        arriving = spark.readStream.schema(said.schema).parquet(parts)
        stream_history(arriving, view, f"{parts}-checkpoint", n=4).awaitTermination()
    kept = live_history(spark, view)
    return kept.select(F.col("conv_id").cast("bigint"), "pos", "role", "content")


def q_turn_log(spark, sf_dir):
    """Two appends, one per side of the conversation, read as one log."""
    path = shared_folder(spark, "turns")
    said = turns(spark, sf_dir)
    append_turns(said.where(F.col("role") == "user"), path)
    append_turns(said.where(F.col("role") != "user"), path)
    kept = prune_turns(load_turns(spark, path, on_bad="empty"), 3)
    return kept.select(F.col("conv_id").cast("bigint"), "turn", "role", "content")


def q_turn_log_bad_lines(spark, sf_dir):
    """Messages between blank and broken lines: good ones read, bad ones counted."""
    path = shared_folder(spark, "turns")
    said = turns(spark, sf_dir)
    append_turns(said, path)
    broken = said.select(
        F.explode(F.array(
            F.lit(""), F.lit("  "), F.concat(F.lit('{"role": "user", "content": '), "turn"),
            F.concat(F.lit('{"turn": '), "turn", F.lit("}")),
        )).alias("value")
    )
    broken.write.mode("append").text(path)
    n_bad = count_bad_turns(spark, path).first()["n_bad"]
    kept = load_turns(spark, path)
    return kept.select(
        F.col("conv_id").cast("bigint"), "turn", "role", "content",
        F.lit(n_bad).cast("bigint").alias("n_bad"),
    )


def q_read_documents(spark, sf_dir):
    """Texts as files of a bounded number of rows, read back whole.

    Every task writes the sources it meets, so no task and no file holds all of one.
    """
    path = shared_folder(spark, "texts")
    docs = table(spark, sf_dir, "documents").select("source", "text")
    docs.write.partitionBy("source").option("maxRecordsPerFile", 200).text(path)
    files = read_documents(spark, path, recursive=True)
    read = files.select(
        F.regexp_extract("metadata.source", "source=(src[0-9]+)", 1).alias("source"),
        F.length("text").alias("n_chars"),
    )
    return read.groupBy("source").agg(F.sum("n_chars").alias("n_chars"))


def q_read_queries(spark, sf_dir):
    """Every document's lines as a file of questions."""
    path = shared_folder(spark, "questions")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    lines = read_queries(spark, path, "txt")
    return lines.groupBy("query").agg(F.count("*").alias("n"))


def q_read_split(spark, sf_dir):
    path = shared_folder(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    write_splits(train_test_split(docs, "doc_id"), path)
    return read_split(spark, path, "test")


def q_report(spark, sf_dir):
    """Two runs written; the later one read."""
    path = shared_folder(spark, "report")
    results = q_task_results(spark, sf_dir)
    write_report(results.withColumn("accuracy", F.lit(0.0)), path, "20250101_080000")
    notes = {"Headline": "quality labels"}
    write_report(results, path, "20250101_090000", notes, PUBLISHED_SCORES)
    latest = read_report(spark, path).drop("run_ts")
    listed = F.explode_outer("references").alias("system", "reference")
    return latest.select("*", listed).drop("references")


def q_ticker_profiles(spark, sf_dir):
    """Customers as tickers, their orders as facts; closed orders are the news."""
    return _profiles(spark, sf_dir).select("doc_id", "text", "metadata.*")


def _profiles(spark, sf_dir, until=None):
    """Profiles from all orders, or from those before a day."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    if until is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(until).cast("timestamp"))
    ticker = F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker")
    price, date = F.col("o_totalprice"), F.col("o_orderdate")
    spans = orders.groupBy("o_custkey").agg(
        F.max(date).alias("as_of"),
        F.max(price).alias("high_52w"),
        F.min(price).alias("low_52w"),
        F.sum(price).alias("market_cap"),
        F.count("*").cast("double").alias("trailing_eps"),
    )
    snapshot = customers.join(spans, F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
        "as_of",
        F.col("c_acctbal").alias("price"),
        F.lit(None).cast("double").alias("pe_ratio"),
        "market_cap",
        "high_52w",
        "low_52w",
        F.col("c_nationkey").cast("double").alias("forward_eps"),
        "trailing_eps",
    )
    quarter_end = F.last_day(F.add_months(F.trunc(date, "quarter"), 2))
    quarterly = orders.groupBy(ticker, quarter_end.alias("period_end")).agg(
        F.sum(price).alias("revenue"),
        F.max(price).alias("net_income"),
        F.count("*").cast("double").alias("eps"),
        F.min(price).alias("profit_margin"),
    )
    annual = orders.groupBy(ticker, F.year(date).alias("fiscal_year")).agg(
        F.sum(price).alias("revenue"),
        F.max(price).alias("ebitda"),
        F.min(price).alias("free_cash_flow"),
    )
    news = orders.where(F.col("o_orderstatus") == "F").select(
        ticker,
        date.alias("published"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("headline"),
        F.col("o_orderpriority").alias("publisher"),
        F.lit(None).cast("string").alias("summary"),
    )
    return ticker_profiles(snapshot, quarterly, annual, news)


QUERIES = {
    "index_store": q_index_store,
    "stream_index": q_stream_index,
    "index_life": q_index_life,
    "index_versions": q_index_versions,
    "stream_versions": q_stream_versions,
    "ticker_refresh": q_ticker_refresh,
    "log_life": q_log_life,
    "stream_turns": q_stream_turns,
    "live_history": q_live_history,
    "turn_log": q_turn_log,
    "turn_log_bad_lines": q_turn_log_bad_lines,
    "read_documents": q_read_documents,
    "read_queries": q_read_queries,
    "read_split": q_read_split,
    "report": q_report,
    "ticker_profiles": q_ticker_profiles,
}

_INDEX = f"""
    WITH {SQL_CHUNKS}
    SELECT chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, chunk_no, text, source,
           CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 384 END AS dim,
           'hashed-words-384' AS model_name
    FROM chunks"""

_CHANGED = """
    WITH changed AS (
        SELECT doc_id, source, lang,
               CASE WHEN lang = 'fr' THEN 'Nouveau. ' || coalesce(text, '') ELSE text END AS text
        FROM documents)"""
_VERSIONED = f"""
    {_CHANGED}, {SQL_CHUNKS.replace("FROM documents", "FROM changed")}
    SELECT chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, chunk_no, text, source,
           CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 384 END AS dim
    FROM chunks"""


def _money(column: str) -> str:
    return f"coalesce(CAST(CAST(round({column}, 2) AS DECIMAL(20, 2)) AS VARCHAR), 'n/a')"


def _facts(**columns: str) -> str:
    return " || chr(10) || ".join(f"'{n}: ' || {_money(c)}" for n, c in columns.items())


_PROFILES = f"""
        WITH facts AS (SELECT *, 'C' || o_custkey AS ticker FROM orders),
        spans AS (
            SELECT ticker, o_custkey, max(o_orderdate) AS as_of, max(o_totalprice) AS high,
                   min(o_totalprice) AS low, sum(o_totalprice) AS cap, count(*) AS n
            FROM facts GROUP BY ALL),
        snapshot AS (
            SELECT ticker, 'snapshot' AS section, '' AS period, as_of::DATE AS d,
                   {_facts(price='c_acctbal', pe_ratio='NULL::DOUBLE', market_cap='cap',
                           high_52w='high', low_52w='low', forward_eps='c_nationkey::DOUBLE',
                           trailing_eps='n::DOUBLE')} AS body
            FROM spans JOIN customer ON c_custkey = o_custkey),
        quarters AS (
            SELECT ticker, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS d,
                   sum(o_totalprice) AS s, max(o_totalprice) AS hi, count(*) AS n,
                   min(o_totalprice) AS lo
            FROM facts GROUP BY ALL),
        quarterly AS (
            SELECT ticker, 'quarterly' AS section, strftime(d, '%Y-%m-%d') AS period, d::DATE AS d,
                   {_facts(revenue='s', net_income='hi', eps='n::DOUBLE', profit_margin='lo')}
                       AS body
            FROM quarters
            QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) <= 8),
        years AS (
            SELECT ticker, year(o_orderdate) AS y, sum(o_totalprice) AS s,
                   max(o_totalprice) AS hi, min(o_totalprice) AS lo
            FROM facts GROUP BY ALL),
        annual AS (
            SELECT ticker, 'annual' AS section, CAST(y AS VARCHAR) AS period,
                   make_date(y, 12, 31) AS d,
                   {_facts(revenue='s', ebitda='hi', free_cash_flow='lo')} AS body
            FROM years QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY y DESC) <= 4),
        ranked_news AS (
            SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY o_orderdate DESC,
                                         'Order ' || o_orderkey, o_orderpriority) AS i
            FROM facts WHERE o_orderstatus = 'F'),
        news AS (
            SELECT ticker, 'news' AS section, CAST(i AS VARCHAR) AS period, o_orderdate::DATE AS d,
                   'Order ' || o_orderkey || chr(10) || 'Publisher: ' || o_orderpriority
                       || chr(10) AS body
            FROM ranked_news WHERE i <= 10),
        sections AS (
            SELECT * FROM snapshot UNION ALL SELECT * FROM quarterly
            UNION ALL SELECT * FROM annual UNION ALL SELECT * FROM news),
        complete AS (
            SELECT ticker FROM sections GROUP BY ticker HAVING count(DISTINCT section) = 4)
        SELECT concat_ws('/', ticker, section, nullif(period, '')) AS doc_id,
               concat_ws(' ', ticker, section, nullif(period, '')) || chr(10) || body AS text,
               'market_data' AS source, ticker, strftime(d, '%Y-%m-%d') AS date
        FROM sections SEMI JOIN complete USING (ticker)"""
_EARLY = "FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'"

ORACLES = {
    "index_store": _INDEX,
    "stream_index": _INDEX,
    "index_life": _INDEX + " WHERE lang = 'en'",
    "stream_versions": _VERSIONED,
    "index_versions": f"""
        SELECT * FROM ({_VERSIONED} WHERE lang <> 'de') JOIN (
            WITH {SQL_CHUNKS}
            SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n_before FROM chunks GROUP BY ALL)
            USING (doc_id)""",
    "ticker_refresh": f"""
        WITH early AS (SELECT doc_id, text, ticker FROM ({_PROFILES.replace("FROM orders", _EARLY)})),
        late AS ({_PROFILES})
        SELECT doc_id, text, 'unchanged' AS step FROM early
        UNION ALL
        SELECT doc_id, text, 'refreshed' FROM late
        WHERE ticker IN (SELECT ticker FROM early)""",
    "log_life": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "stream_turns": QUESTIONS["prompt_history"],
    "live_history": QUESTIONS["prompt_history"],
    "turn_log": """
        SELECT conv_id, turn, role, text AS content FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest
            FROM conversations)
        WHERE newest <= 3""",
    "turn_log_bad_lines": """
        SELECT conv_id, turn, role, text AS content,
               (SELECT 2 * count(*) FROM conversations) AS n_bad
        FROM conversations""",
    "read_documents": """
        SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
        FROM documents GROUP BY source""",
    "read_queries": f"""
        WITH lines AS (
            SELECT {sql_strip('unnest(string_split(text, chr(10)))')} AS query FROM documents)
        SELECT query, count(*) AS n FROM lines WHERE query <> '' GROUP BY query""",
    "read_split": """
        SELECT doc_id, lang, text FROM (
            SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS i,
                   count(*) OVER () AS n
            FROM documents)
        WHERE i <= ceil(n * 0.25::DOUBLE)""",
    "report": f"""
        SELECT r.*, CASE WHEN task = 'Headline' THEN 'quality labels' END AS dataset_note,
               p.system, p.reference, '2025-01-01 09:00' AS run_date
        FROM ({EVALUATION['task_results']}) r
        LEFT JOIN (VALUES {PUBLISHED}) p(task, system, reference) USING (task)""",
    "ticker_profiles": _PROFILES,
}
