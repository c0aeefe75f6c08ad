"""New documents into the index as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.operators.chunking import METADATA, index_documents
from passagework.sources.documents import TEXT_FILES, decode_text
from passagework.sources.index_store import without_repeats, write_batch
from passagework.sources.index_versions import put_documents

DOCUMENT_SCHEMA = f"doc_id string, text string, metadata {METADATA}"


def document_files(spark: SparkSession, path: str, pattern: str = TEXT_FILES) -> DataFrame:
    """A stream of the text files that appear below a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    metadata = F.struct(
        F.col("path").alias("source"),
        F.lit(None).cast("string").alias("ticker"),
        F.date_format("modificationTime", "yyyy-MM-dd").alias("date"),
    )
    return files.select(
        F.md5("path").alias("doc_id"),
        decode_text(F.col("content")).alias("text"),
        metadata.cast(METADATA).alias("metadata"),
    )


def stream_index(
    documents: DataFrame, path: str, checkpoint: str, embedder, **trigger
) -> StreamingQuery:
    """Chunk, embed and append a stream of documents; by default what is there now.

    A batch has a folder of its own in the index, named after the checkpoint and its
    number: run again after a failure it replaces what it had written, and no stored id
    is looked up. Streams, appends and clearing share one index. A document that
    arrives twice is appended twice; :func:`stream_documents` replaces it.
    """
    stream = _stream_name(checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        rows = index_documents(batch, embedder)
        write_batch(rows, path, embedder.name, f"stream-{stream}-{number:012d}")

    return _started(documents, add, checkpoint, trigger)


def stream_documents(
    documents: DataFrame, path: str, checkpoint: str, embedder, **trigger
) -> StreamingQuery:
    """A stream of documents into a versioned index: each batch is one new version.

    A document that comes again takes the place of its earlier chunks. The version keeps
    the number of the batch, so one that runs again after a failure changes nothing.
    Of a document that comes several times in one batch all chunks stay, each once.
    """
    stream = _stream_name(checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        rows = without_repeats(index_documents(batch, embedder), ["model_name", "chunk_id"])
        put_documents(rows, path, stream=(stream, number))

    return _started(documents, add, checkpoint, trigger)


def _stream_name(checkpoint: str) -> str:
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def _started(documents: DataFrame, add, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
