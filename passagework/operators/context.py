"""From hits to context blocks, and questions enriched with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.fixed_values import BASE_SYSTEM, EMPTY_INDEX, MAX_DISTANCE, TOP_K
from passagework.functions.prompts import passage, system_prompt
from passagework.functions.status import rag_status, rag_status_msg, rag_warning
from passagework.operators.search import MAX_BROADCAST_HITS, gate, knn, vector_size
from passagework.session import written
from passagework.sources.text_store import store_texts, texts_at

# Beyond the first, questions are looked at for repeated vectors, and passages are stored
# and not moved; at most so many different vectors, and characters of their passages, are
# broadcast.
MIN_QUESTIONS = 10_000
MAX_REPEATED = 20_000
MAX_BROADCAST_CHARS = 32 << 20

HIT = ["rank", "chunk_id", "text", "score", "metadata", "passing"]


def with_texts(hits: DataFrame, index: DataFrame, index_id: str = "chunk_id") -> DataFrame:
    """Text and metadata of the hits, joined after the top-k.

    Only ids and scores go through the ranking; the wide columns are read for
    the final hits. Whether the hits are broadcast is left to their actual size.
    """
    return hits.join(index.select(index_id, "text", "metadata"), index_id)


def context_blocks(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per question: its hits in order, their counts and the numbered passages.

    Passages are numbered after the gate. ``context_block`` is null when none
    passed. A question has at most k hits, so the collected lists are bounded.
    """
    hit = F.struct(*HIT)
    grouped = hits.groupBy(query_id).agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    return _laid_out(grouped, query_id)


def _laid_out(grouped: DataFrame, *columns: str) -> DataFrame:
    """``columns``, the sorted ``hits``, their counts and the numbered passages of each row."""
    grouped = grouped.withColumn("passed", F.filter("hits", lambda h: h["passing"]))
    passages = F.transform(
        "passed",
        lambda h, i: passage(
            i + 1,
            h["text"],
            h["metadata"]["source"],
            h["metadata"]["ticker"],
            h["metadata"]["date"],
        ),
    )
    return grouped.select(
        *columns,
        "hits",
        F.size("hits").alias("n_hits"),
        F.size("passed").alias("n_passing"),
        (F.size("hits") - F.size("passed")).alias("n_rejected"),
        F.array_min(F.transform("hits", lambda h: h["score"])).alias("best_score"),
        F.when(F.size("passed") > 0, F.array_join(passages, "\n\n")).alias("context_block"),
    )


def enrich(
    queries: DataFrame,
    index: DataFrame,
    embedder=None,
    k: int = TOP_K,
    max_distance: float = MAX_DISTANCE,
    base_system: str = BASE_SYSTEM,
    dim: int | None = None,
    **search,
) -> DataFrame:
    """One row per question with an explicit status, whatever was found.

    ``queries`` has ``query_id, query`` and either ``embedding`` or an
    ``embedder`` to make it. All its columns are kept; added are
    ``system_prompt, user_prompt, retrieved_chunks, rag_used, rag_status,
    rag_status_msg, rag_warning`` and the counts behind them. ``dim``, the size
    of the index's vectors, saves computing one to see where it is known. Vectors
    made here are written to the shared folder, as search and status both read them;
    with an empty index none are made.
    """
    return enrich_dealt(
        queries, index, embedder, k, max_distance, base_system, dim, None, **search
    )[0]


def enrich_dealt(
    queries: DataFrame, index: DataFrame, embedder, k: int, max_distance: float,
    base_system: str, dim: int | None, deal, marker: str | None = None, **search,
) -> tuple[DataFrame, bool]:
    """:func:`enrich`, and whether its rows lie as ``deal`` has put the questions.

    That is so where passages are few enough to be broadcast, or where questions are many
    and passages are stored: they then meet questions that are dealt already, and never
    travel with them. With a ``marker`` stored passages are not read at all: it stands for
    the text of each, and the columns ``_places`` and ``_folder`` say what it stands for.
    """
    dealt = False
    empty = index.isEmpty()
    made = embedder is not None and "embedding" not in queries.columns and not empty
    if made:
        queries = written(queries.withColumn("embedding", embedder.vector("query")), "questions")
    if dim is None and not empty:
        dim = vector_size(index)
    asked = queries.count() if made else 0
    repeated = _repeated(queries) if asked >= MIN_QUESTIONS else None
    failed = F.lit(False) if empty else (
        F.col("embedding").isNull()
        | (F.size("embedding") != F.lit(dim if dim is not None else -1))
        | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    )
    if empty:
        # Nothing can be found, and the status says so whatever the vectors are: none is made.
        found = context_blocks(with_texts(gate(knn(queries, index, 0, dim=0)), index))
        nothing_found = [f for f in found.schema if f.name != "query_id"]
        joined = queries.withColumns({f.name: F.lit(None).cast(f.dataType) for f in nothing_found})
    elif repeated is None and asked >= MIN_QUESTIONS:
        # Many questions quote a text many times, and their vectors are read no more.
        hits = written(gate(knn(queries, index, k, dim=dim, **search), max_distance), "hits")
        places, folder = _with_places(hits, index)
        joined = queries.withColumn("_failed", failed).drop("embedding")
        none = F.array().cast(places.schema["_hits"].dataType)
        joined = joined.join(places, "query_id", "left").withColumn("_hits", F.coalesce("_hits", none))
        failed = F.col("_failed")
        if deal is not None:
            joined, dealt = deal(joined), True
        joined = _quoting(joined, folder) if marker is None else _marked(joined, folder, marker)
    elif repeated is None:
        hits = gate(knn(queries, index, k, dim=dim, **search), max_distance)
        joined = queries.join(context_blocks(with_texts(hits, index)), "query_id", "left")
    else:
        # Questions with one vector have the same passages: found and laid out once.
        found = knn(repeated, index, k, query_id="_first", dim=dim, **search)
        texts = with_texts(gate(found, max_distance), index)
        blocks = written(context_blocks(texts, "_first"), "repeated-blocks")
        size = blocks.agg(F.sum(F.length("context_block"))).first()[0] or 0
        if size <= MAX_BROADCAST_CHARS:
            blocks = F.broadcast(blocks)
            if deal is not None:
                queries, dealt = deal(queries), True
        firsts = F.broadcast(repeated.select("_first", F.col("embedding").alias("_vector")))
        joined = (
            queries.join(firsts, F.col("embedding") == F.col("_vector"), "left")
            .join(blocks, "_first", "left")
            .drop("_first", "_vector")
        )
    n_hits = F.coalesce("n_hits", F.lit(0))
    n_passing = F.coalesce("n_passing", F.lit(0))
    counted = joined.withColumns(
        {
            "n_hits": n_hits,
            "n_passing": n_passing,
            "n_rejected": n_hits - n_passing,
            "rag_status": rag_status(F.lit(empty), failed, n_hits, n_passing),
        }
    )
    counted = counted.withColumn(
        "rag_status_msg",
        rag_status_msg(
            F.col("rag_status"),
            F.col("n_hits"),
            F.col("n_passing"),
            F.col("best_score"),
            max_distance,
        ),
    )
    used = F.col("n_passing") > 0
    returned = F.when(used, F.filter("hits", lambda h: h["passing"])).otherwise(F.col("hits"))
    nothing = F.array().cast(counted.schema["hits"].dataType)
    enriched = counted.withColumns(
        {
            "system_prompt": system_prompt("context_block", base_system),
            "user_prompt": F.col("query"),
            "retrieved_chunks": F.coalesce(returned, nothing),
            "rag_used": used,
            "rag_warning": rag_warning(F.col("rag_status"), F.col("rag_status_msg")),
        }
    ).drop("hits", "embedding", "_failed")
    return enriched, dealt


def _with_places(hits: DataFrame, index: DataFrame) -> tuple[DataFrame, str]:
    """Per question its hits with the places of their texts, and the folder that has these.

    Texts go into the store as the index is read; neither they nor the index are shuffled.
    Only those that were hit are stored if their ids can be broadcast, as hashes: another
    text that is stored beside them is not read.
    """
    texts = index.select("chunk_id", "metadata", "text")
    wanted = hits.select(F.xxhash64("chunk_id").alias("_hash")).distinct()
    if wanted.count() <= MAX_BROADCAST_HITS:
        hashed = texts.withColumn("_hash", F.xxhash64("chunk_id"))
        texts = hashed.join(F.broadcast(wanted), "_hash", "left_semi").drop("_hash")
    placed, folder = store_texts(texts, "passages")
    hit = F.struct(*[c for c in HIT if c != "text"], "place")
    found = hits.join(placed, "chunk_id")
    return found.groupBy("query_id").agg(F.collect_list(hit).alias("_hits")), folder


def _quoting(questions: DataFrame, folder: str) -> DataFrame:
    """Questions with ``_hits`` of :func:`_with_places`, and what :func:`context_blocks` has."""
    columns = [c for c in questions.columns if c != "_hits"]
    places = F.transform("_hits", lambda h: h["place"])
    read = questions.withColumn("_texts", texts_at(places, folder))
    hit = F.zip_with(
        "_hits", "_texts",
        lambda h, text: F.struct(*[(text if c == "text" else h[c]).alias(c) for c in HIT]),
    )
    return _laid_out(read.withColumn("hits", F.sort_array(hit)), *columns)


def _marked(questions: DataFrame, folder: str, marker: str) -> DataFrame:
    """As :func:`_quoting`, with ``marker`` for every text; ``_places`` are those of the
    texts in the context block, in its order."""
    columns = [c for c in questions.columns if c != "_hits"]

    def marked(h):
        text = F.when(h["place"].isNotNull(), F.lit(marker)).alias("text")
        return F.struct(*[text if c == "text" else h[c].alias(c) for c in HIT], h["place"].alias("place"))

    hits = questions.withColumn("hits", F.sort_array(F.transform("_hits", marked)))
    quoted = F.filter("hits", lambda h: h["passing"] & h["place"].isNotNull())
    placed = hits.withColumn("_places", F.transform(quoted, lambda h: h["place"]))
    return _laid_out(placed.withColumn("_folder", F.lit(folder)), *columns, "_places", "_folder")


def _repeated(queries: DataFrame) -> DataFrame | None:
    """The different vectors of the questions, each with one of its ids, if they are few.

    Few are at most ``MAX_REPEATED``, and at most half as many as there are questions;
    the estimate beforehand keeps other questions from being grouped.
    """
    estimate = queries.agg(
        F.count("embedding").alias("n"),
        F.approx_count_distinct(F.xxhash64("embedding")).alias("different"),
    ).first()
    if estimate["n"] < MIN_QUESTIONS or 2 * estimate["different"] > estimate["n"]:
        return None
    if estimate["different"] > MAX_REPEATED:
        return None
    known = queries.where(F.col("embedding").isNotNull())
    firsts = known.groupBy("embedding").agg(F.min("query_id").alias("_first"))
    return written(firsts, "repeated-vectors")


def first_warning(results: DataFrame, session, order) -> DataFrame:
    """The one question per session beside which the empty-index notice is shown.

    A minimum per session, so it is combined before the shuffle and a session
    of any length costs one row per partition.
    """
    session, order = _listed(session), _listed(order)
    kept = [c for c in results.columns if c not in session and c not in order]
    first = F.min(F.struct(*order, *kept)).alias("first")
    return (
        results.where(F.col("rag_status") == EMPTY_INDEX)
        .groupBy(*session)
        .agg(first)
        .select(*session, "first.*")
    )


def _listed(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)
