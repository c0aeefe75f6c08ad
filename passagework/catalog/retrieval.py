"""Registered queries: chunks, vectors, search, status and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.catalog.common import (
    SQL_CHUNKS,
    documents,
    sql_distance,
    sql_strip,
    sql_text,
    sql_vectors,
    table,
    texts,
    turns,
)
from passagework.functions.fixed_values import (
    BASE_SYSTEM,
    CONTEXT_END,
    CONTEXT_INTRO,
    EMPTY_INDEX_MSG,
    EMPTY_INDEX_WARNING,
    ERROR_MSG,
    LOW_CONFIDENCE_WARNING,
)
from passagework.operators.approximate import approximate_knn, build_cells, recall
from passagework.operators.chunking import (
    chunk_documents,
    chunk_pages,
    index_documents,
    split_pages,
)
from passagework.operators.context import context_blocks, enrich, first_warning, with_texts
from passagework.operators.embedding import HashedEmbedder, ModelEmbedder, components, embed
from passagework.operators.search import gate, knn
from passagework.operators.vector_store import embed_once
from passagework.session import shared_folder
from passagework.sources.index_store import empty_index, index_status, ingest_summary

EMBEDDER = HashedEmbedder()


def q_chunk_documents(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return chunk_documents(docs)


def q_chunk_pages(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return chunk_pages(split_pages(docs, "\n"))


def q_chunk_stats(spark, sf_dir):
    chunks = chunk_documents(texts(spark, sf_dir).select("source", "doc_id", "text"))
    return chunks.groupBy("source").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("chunk_no") == 0).alias("n_documents"),
        F.sum(F.length("text")).alias("n_chars"),
    )


def q_embed_hashed(spark, sf_dir):
    index = index_documents(documents(spark, sf_dir), EMBEDDER)
    weights = components(index, "chunk_id", pos="bucket", value="w")
    return weights.where(F.col("w") != 0).select(
        "chunk_id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight")
    )


def q_index_status(spark, sf_dir):
    return index_status(index_documents(documents(spark, sf_dir), EMBEDDER))


def q_ingest_summary(spark, sf_dir):
    index = index_documents(documents(spark, sf_dir), EMBEDDER)
    whole = index_documents(documents(spark, sf_dir), EMBEDDER, auto_chunk=False)
    return ingest_summary(whole, index)


def letters_model():
    """Stands in for an embedding model: counts of the letters a, e, i, o, u."""
    return lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts]


def missing_model():
    raise OSError("this model is not here")


def q_embed_model(spark, sf_dir):
    """Whole documents through a caller's model, the second of two."""
    embedder = ModelEmbedder([("missing", missing_model), ("letters", letters_model)], 5)
    docs = texts(spark, sf_dir).select("doc_id", "text")
    vectors = embed(docs, "text", embedder)
    counts = components(vectors, "doc_id", "model_name")
    return counts.withColumn("n", F.col("x").cast("bigint")).drop("x")


def q_embed_once(spark, sf_dir):
    """Documents embedded into a store of vectors, then once more from the store alone."""
    path = shared_folder(spark, "vectors")
    docs = texts(spark, sf_dir).select("doc_id", "text")
    embed_once(docs, ModelEmbedder([("letters", letters_model)], 5), path)
    again = embed_once(docs, ModelEmbedder([("letters", no_more_calls)], 5), path)
    counts = components(again, "doc_id", "model_name")
    return counts.withColumn("n", F.col("x").cast("bigint")).drop("x")


def no_more_calls():
    """A model under the same name that must not be asked: its vectors would be wrong."""
    return lambda texts: [[-1.0] * 5 for _ in texts]


def _vector_hits(spark, sf_dir, **search):
    """Every vector's nearest others: one more than wanted, then itself left out."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    index = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    others = knn(queries, index, 6, **search).where(F.col("chunk_id") != F.col("query_id"))
    again = Window.partitionBy("query_id").orderBy("rank")
    return others.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= 5)


def q_knn_topk(spark, sf_dir):
    return _vector_hits(spark, sf_dir).withColumn("score", F.round("score", 6))


def q_knn_many_questions(spark, sf_dir):
    """The same search by the plan for questions too many to broadcast."""
    hits = _vector_hits(spark, sf_dir, max_broadcast_bytes=0, pivots=8)
    return hits.withColumn("score", F.round("score", 6))


def _probed(spark, sf_dir, k, **search):
    """All vectors put to an index of all vectors that is stored by trained cells."""
    vectors = table(spark, sf_dir, "embeddings")
    path = shared_folder(spark, "cells")
    build_cells(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), path)
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return approximate_knn(queries, path, k, **search)


def q_knn_all_cells(spark, sf_dir):
    """With every cell probed the approximate search is exact."""
    hits = _probed(spark, sf_dir, 6, probes=1 << 12, refine=16)
    others = hits.where(F.col("chunk_id") != F.col("query_id"))
    again = Window.partitionBy("query_id").orderBy("rank")
    ranked = others.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= 5)
    return ranked.withColumn("score", F.round("score", 6))


def q_ann_recall(spark, sf_dir):
    """The share of the five nearest of all vectors that a search of some cells finds."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    index = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    measured = recall(_probed(spark, sf_dir, 5), knn(queries, index, 5))
    return measured.select("n_exact", (F.col("recall") >= 0.9).alias("recall_is_high"))


def q_gate_hits(spark, sf_dir):
    hits = gate(_vector_hits(spark, sf_dir))
    return hits.groupBy("query_id").agg(
        F.count_if("passing").alias("n_passing"),
        F.count_if(~F.col("passing")).alias("n_rejected"),
        F.round(F.min("score"), 6).alias("best_score"),
    )


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def _index(spark, sf_dir):
    return index_documents(documents(spark, sf_dir), EMBEDDER)


def q_text_search(spark, sf_dir):
    questions = _questions(spark, sf_dir).withColumn("embedding", EMBEDDER.vector("query"))
    hits = knn(questions, _index(spark, sf_dir), dim=EMBEDDER.dim)
    return hits.withColumn("score", F.round("score", 6))


def q_context_blocks(spark, sf_dir):
    questions = _questions(spark, sf_dir).withColumn("embedding", EMBEDDER.vector("query"))
    index = _index(spark, sf_dir)
    blocks = context_blocks(with_texts(gate(knn(questions, index, dim=EMBEDDER.dim)), index))
    return blocks.select(
        "query_id",
        "n_hits",
        "n_passing",
        "n_rejected",
        F.round("best_score", 6).alias("best_score"),
        "context_block",
    )


def q_enrich_prompts(spark, sf_dir):
    questions, index = _questions(spark, sf_dir), _index(spark, sf_dir)
    return enrich(questions, index, EMBEDDER, dim=EMBEDDER.dim).select(
        "query_id",
        "system_prompt",
        "user_prompt",
        F.size("retrieved_chunks").alias("n_returned"),
        "rag_used",
        "rag_status",
        "rag_status_msg",
        "rag_warning",
    )


def q_rag_status(spark, sf_dir):
    """The same questions against the index, an empty one, and with foreign vectors."""
    questions, index = _questions(spark, sf_dir), _index(spark, sf_dir)
    foreign = HashedEmbedder(64)
    cases = {
        "indexed": enrich(questions, index, EMBEDDER, dim=EMBEDDER.dim),
        "empty": enrich(questions, empty_index(spark), EMBEDDER),
        "foreign": enrich(questions, index, foreign, dim=EMBEDDER.dim),
    }
    out = None
    for name, result in cases.items():
        rows = result.select(
            F.lit(name).alias("setting"),
            "query_id",
            "rag_status",
            "rag_used",
            "rag_status_msg",
            "rag_warning",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def q_first_warning(spark, sf_dir):
    said = turns(spark, sf_dir).where(F.col("role") == "user")
    questions = said.select(
        F.concat_ws("/", "conv_id", "turn").alias("query_id"),
        F.col("content").alias("query"),
        "conv_id",
        "turn",
    )
    results = enrich(questions, empty_index(spark), EMBEDDER)
    return first_warning(results.select("conv_id", "turn", "query_id", "rag_status", "rag_warning"),
                         "conv_id", "turn")


QUERIES = {
    "chunk_documents": q_chunk_documents,
    "chunk_pages": q_chunk_pages,
    "chunk_stats": q_chunk_stats,
    "embed_hashed": q_embed_hashed,
    "index_status": q_index_status,
    "ingest_summary": q_ingest_summary,
    "embed_model": q_embed_model,
    "embed_once": q_embed_once,
    "knn_topk": q_knn_topk,
    "knn_many_questions": q_knn_many_questions,
    "knn_all_cells": q_knn_all_cells,
    "ann_recall": q_ann_recall,
    "gate_hits": q_gate_hits,
    "text_search": q_text_search,
    "context_blocks": q_context_blocks,
    "enrich_prompts": q_enrich_prompts,
    "rag_status": q_rag_status,
    "first_warning": q_first_warning,
}

_VECTOR_HITS = f"""
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {sql_distance('a.v', 'b.v')} AS score
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS INTEGER)
              AS rank
    FROM pairs),
hits AS (SELECT * FROM ranked WHERE rank <= 5)
"""

_NEAREST = f"""
    WITH {_VECTOR_HITS}
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits"""

_TEXT_HITS = f"""
{SQL_CHUNKS},
{sql_vectors('index_vectors', 'chunks', 'chunk_id')},
questions AS (SELECT item_id AS query_id, text FROM benchmark),
{sql_vectors('question_vectors', 'questions', 'query_id')},
pairs AS (
    SELECT q.query_id, x.chunk_id, {sql_distance('q.v', 'x.v')} AS score
    FROM question_vectors q, index_vectors x),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS INTEGER)
              AS rank
    FROM pairs),
hits AS (SELECT * FROM ranked WHERE rank <= 5)
"""

_BLOCKS = f"""
{_TEXT_HITS},
marked AS (
    SELECT h.*, score <= 1.2::DOUBLE AS passing, c.text, c.source,
           CASE WHEN c.lang <> 'en' THEN upper(c.lang) END AS ticker
    FROM hits h JOIN chunks c USING (chunk_id)),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, passing ORDER BY rank) AS i FROM marked),
blocks AS (
    SELECT query_id,
           CAST(count(*) AS INTEGER) AS n_hits,
           CAST(count(*) FILTER (passing) AS INTEGER) AS n_passing,
           CAST(count(*) FILTER (NOT passing) AS INTEGER) AS n_rejected,
           min(score) AS best_score,
           string_agg('[' || i || '] source=' || source
                      || coalesce(' ticker=' || ticker, '') || chr(10) || text,
                      chr(10) || chr(10) ORDER BY i) FILTER (passing) AS context_block
    FROM numbered GROUP BY query_id)
"""

_LOW_MSG = (
    "'All ' || n_hits || ' candidate chunk(s) exceeded the distance threshold (1.2). "
    "Best score: ' || printf('%.3f', best_score) || "
    "'. Consider raising max_distance or adding more relevant documents.'"
)
_OK_MSG = (
    "'Injected ' || n_passing || ' chunk(s) (rejected ' || n_rejected || ' below threshold).'"
)
STATUSES = f"""
{_BLOCKS},
statuses AS (
    SELECT q.query_id, q.text, coalesce(n_hits, 0) AS n_hits, coalesce(n_passing, 0) AS n_passing,
           coalesce(n_rejected, 0) AS n_rejected, context_block,
           CASE WHEN v IS NULL THEN 'error' WHEN n_passing = 0 THEN 'low_confidence' ELSE 'ok' END
               AS rag_status,
           CASE WHEN v IS NULL THEN {sql_text(ERROR_MSG)}
                WHEN n_passing = 0 THEN {_LOW_MSG} ELSE {_OK_MSG} END AS rag_status_msg
    FROM questions q LEFT JOIN question_vectors USING (query_id) LEFT JOIN blocks USING (query_id))
"""
_FAILED = "'RAG retrieval failed (' || {m} || '). Answer based on model knowledge only.'"
_WARNING = f"""
    CASE rag_status WHEN 'low_confidence' THEN {sql_text(LOW_CONFIDENCE_WARNING)} || rag_status_msg
                    WHEN 'error' THEN {_FAILED.format(m='rag_status_msg')} END
"""

_LETTERS = """
        WITH letters AS (SELECT unnest(range(5)) AS i)
        SELECT doc_id, 'letters' AS model_name, CAST(i AS INTEGER) AS pos,
               length(text) - length(replace(text, substr('aeiou', i + 1, 1), '')) AS n
        FROM documents, letters"""

ORACLES = {
    "chunk_documents": f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_no, text FROM chunks",
    "chunk_pages": f"""
        WITH pages_of AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
        page_rows AS (
            SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS page_no,
                   unnest(parts) AS text
            FROM pages_of),
        chunk_lists AS (
            SELECT doc_id, page_no,
                   list_filter(
                       list_transform(range(0, length(text), 448),
                                      lambda s: {sql_strip('substring(text, s + 1, 512)')}),
                       lambda c: length(c) > 0) AS chunks
            FROM page_rows)
        SELECT doc_id, page_no, CAST(unnest(range(len(chunks))) AS INTEGER) AS chunk_no,
               unnest(chunks) AS text
        FROM chunk_lists""",
    "chunk_stats": f"""
        WITH {SQL_CHUNKS}
        SELECT source, count(*) AS n_chunks, count(*) FILTER (chunk_no = 0) AS n_documents,
               CAST(sum(length(text)) AS BIGINT) AS n_chars
        FROM chunks GROUP BY source""",
    "embed_hashed": f"""
        WITH {SQL_CHUNKS}, {sql_vectors('vectors', 'chunks', 'chunk_id')}
        SELECT chunk_id, CAST(bucket AS INTEGER) AS bucket, round(w, 6) AS weight
        FROM (SELECT chunk_id, unnest(range(384)) AS bucket, unnest(v) AS w FROM vectors)
        WHERE w <> 0""",
    "index_status": f"""
        WITH {SQL_CHUNKS}
        SELECT 'hashed-words-384' AS model_name, count(*) AS n_chunks FROM chunks""",
    "ingest_summary": f"""
        WITH {SQL_CHUNKS}
        SELECT (SELECT count(*) FROM documents) AS chunks_added, count(*) AS total_chunks
        FROM chunks""",
    "embed_model": _LETTERS,
    "embed_once": _LETTERS,
    "knn_topk": _NEAREST,
    "knn_many_questions": _NEAREST,
    "knn_all_cells": _NEAREST,
    "ann_recall": "SELECT 5 * count(*) AS n_exact, TRUE AS recall_is_high FROM embeddings",
    "gate_hits": f"""
        WITH {_VECTOR_HITS}
        SELECT query_id, count(*) FILTER (score <= 1.2::DOUBLE) AS n_passing,
               count(*) FILTER (score > 1.2::DOUBLE) AS n_rejected,
               round(min(score), 6) AS best_score
        FROM hits GROUP BY query_id""",
    "text_search": f"""
        WITH {_TEXT_HITS}
        SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""",
    "context_blocks": f"""
        WITH {_BLOCKS}
        SELECT query_id, n_hits, n_passing, n_rejected, round(best_score, 6) AS best_score,
               context_block
        FROM blocks""",
    "enrich_prompts": f"""
        WITH {STATUSES}
        SELECT query_id,
               {sql_text(BASE_SYSTEM)} || CASE WHEN context_block IS NULL THEN '' ELSE
                   {sql_text(CONTEXT_INTRO)} || context_block || {sql_text(CONTEXT_END)} END
                   AS system_prompt,
               text AS user_prompt,
               CASE WHEN n_passing > 0 THEN n_passing ELSE n_hits END AS n_returned,
               n_passing > 0 AS rag_used, rag_status, rag_status_msg, {_WARNING} AS rag_warning
        FROM statuses""",
    "rag_status": f"""
        WITH {STATUSES}
        SELECT 'indexed' AS setting, query_id, rag_status, n_passing > 0 AS rag_used,
               rag_status_msg, {_WARNING} AS rag_warning
        FROM statuses
        UNION ALL
        SELECT 'empty', query_id, 'empty_index', false, {sql_text(EMPTY_INDEX_MSG)},
               {sql_text(EMPTY_INDEX_WARNING)}
        FROM questions
        UNION ALL
        SELECT 'foreign', query_id, 'error', false, {sql_text(ERROR_MSG)},
               {_FAILED.format(m=sql_text(ERROR_MSG))}
        FROM questions""",
    "first_warning": f"""
        SELECT conv_id, min(turn) AS turn, conv_id || '/' || min(turn) AS query_id,
               'empty_index' AS rag_status, {sql_text(EMPTY_INDEX_WARNING)} AS rag_warning
        FROM conversations WHERE role = 'user' GROUP BY conv_id""",
}
