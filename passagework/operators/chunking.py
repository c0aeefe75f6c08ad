"""Documents and pages to overlapping character chunks. Narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from passagework.functions.text import strip

METADATA = "struct<source:string,ticker:string,date:string>"


def chunk_documents(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    text: str = "text",
) -> DataFrame:
    """One row per chunk: the document's other columns, ``chunk_no`` from 0, text.

    Chunks are ``size`` characters, start ``size - overlap`` apart while the
    start lies inside the text, are trimmed, and are dropped when empty.

    The text is cut once into pieces of one step, and a chunk is a piece plus
    the start of its followers. Taking each chunk by ``substring`` would walk
    the text from its start every time: quadratic in the length of a document.
    """
    step = size - overlap
    if overlap < 0 or step < 1:
        raise ValueError("size must be larger than overlap, and overlap not negative")
    others = [c for c in docs.columns if c != text]
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut = docs.select(*others, pieces.alias("_pieces"))
    chunks = F.transform("_pieces", lambda piece, i: strip(_extend(piece, i, size, step)))
    kept = F.filter(chunks, lambda chunk: F.length(chunk) > 0)
    return cut.select(*others, F.posexplode(kept).alias("chunk_no", text))


def _extend(piece: Column, i: Column, size: int, step: int) -> Column:
    overlap = size - step
    if overlap == 0:
        return piece
    if overlap <= step:
        follower = F.coalesce(F.get("_pieces", i + 1), F.lit(""))
        return F.concat(piece, F.left(follower, F.lit(overlap)))
    reach = 1 + -(-overlap // step)
    return F.left(F.array_join(F.slice("_pieces", i + 1, reach), ""), F.lit(size))


def chunk_pages(
    pages: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    text: str = "text",
) -> DataFrame:
    """Chunk a table of pages; numbering and offsets restart on every page."""
    if "page_no" not in pages.columns:
        raise ValueError("pages need a page_no column")
    return chunk_documents(pages, size, overlap, text)


def split_pages(docs: DataFrame, separator: str = "\f", text: str = "text") -> DataFrame:
    """Whole-document text to one row per page, ``page_no`` from 0."""
    others = [c for c in docs.columns if c != text]
    pattern = "".join(f"\\x{{{ord(c):x}}}" for c in separator)
    parts = F.split(text, pattern, -1)
    return docs.select(*others, F.posexplode(parts).alias("page_no", text))


def chunk_key(doc_id: str, page_no: str | None, chunk_no: str, text: str) -> Column:
    """Chunk id from content: indexing the same chunk again gives the same id.

    The document's id stands behind its length and a missing page is empty, so
    no two chunks are written alike.
    """
    doc = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    page = F.coalesce(F.col(page_no).cast("string"), F.lit("")) if page_no else F.lit("")
    return F.md5(
        F.concat_ws(":", F.length(doc).cast("string"), doc, page, F.col(chunk_no), F.col(text))
    )


def index_documents(
    docs: DataFrame,
    embedder,
    auto_chunk: bool = True,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Documents (``doc_id, text[, page_no][, metadata]``) to index rows.

    With ``auto_chunk`` off every document is one chunk, as it is. The parent's
    metadata is repeated on each chunk.
    """
    if "metadata" not in docs.columns:
        docs = docs.withColumn("metadata", F.lit(None).cast(METADATA))
    paged = ["page_no"] if "page_no" in docs.columns else []
    docs = docs.select("doc_id", *paged, "metadata", "text")
    if auto_chunk:
        chunks = chunk_documents(docs, size, overlap)
    else:
        chunks = docs.where(F.col("text").isNotNull()).withColumn("chunk_no", F.lit(0))
    rows = chunks.select(
        chunk_key("doc_id", *(paged or [None]), "chunk_no", "text").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        "chunk_no",
        "text",
        F.col("metadata").cast(METADATA).alias("metadata"),
    )
    return rows.withColumn("embedding", embedder.vector("text")).withColumn(
        "model_name", F.lit(embedder.name)
    )
