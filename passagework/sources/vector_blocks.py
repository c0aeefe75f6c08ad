"""Vectors in block files of the shared folder, for tasks that meet many of them.

A search compares blocks with blocks. The tasks read both from here, so nothing is
copied for each meeting: what is written grows with the vectors, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row

from passagework.session import shared_files

BATCH_ROWS = 4096


def write_blocks(rows: DataFrame, folder: str, most: int | None = None) -> list[Row]:
    """Files of ``rows`` (``block, id, v``), and of each its ``block, file, n``.

    Rows of a block lie together in a partition. A file has rows of one block, and not
    more than ``most``; a repeated task writes files of other names.
    """
    return rows.select("block", "id", "v").mapInArrow(
        _write(folder, most), "block int, file string, n bigint"
    ).collect()


def read_block(store, root: str, file: str, rows: int) -> Iterator[pa.RecordBatch]:
    """``id, v`` of a file, so many rows at a time."""
    with store.open_input_stream(f"{root}/{file}") as source:
        # A thread for each core would hold memory of its own.
        for batch in pa.ipc.open_stream(source, options=pa.ipc.IpcReadOptions(use_threads=False)):
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)


def _write(folder: str, most: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared_files(folder)
        store.create_dir(root, recursive=True)
        attempt, options = TaskContext.get().taskAttemptId(), pa.ipc.IpcWriteOptions(compression="zstd")
        ended, sink, writer, here, held = [], None, None, None, 0

        def close():
            writer.close()
            sink.close()
            ended.append({"block": here, "file": f"{attempt}-{len(ended)}", "n": held})

        for batch in batches:
            for block, run in _runs(batch):
                while run.num_rows:
                    if writer is not None and (block != here or held == most):
                        close()
                        writer = None
                    if writer is None:
                        sink = store.open_output_stream(f"{root}/{attempt}-{len(ended)}")
                        writer = pa.ipc.new_stream(sink, run.schema, options=options)
                        here, held = block, 0
                    piece = run.slice(0, BATCH_ROWS if most is None else min(BATCH_ROWS, most - held))
                    writer.write_batch(piece)
                    held, run = held + piece.num_rows, run.slice(piece.num_rows)
        if writer is not None:
            close()
        schema = pa.schema([("block", pa.int32()), ("file", pa.string()), ("n", pa.int64())])
        yield pa.RecordBatch.from_pylist(ended, schema=schema)

    return write


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Neighbouring rows of one block."""
    blocks = batch["block"].to_numpy()
    rows = batch.select(["id", "v"])
    edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield int(blocks[a]), rows.slice(a, b - a)
