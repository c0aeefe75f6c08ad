"""Texts in files of the shared folder, read where they are needed.

A text that many rows quote is stored once. Rows carry its place, a few bytes, through
joins and shuffles, and the task that wants the text reads it from there: what is moved
and kept on disk grows with the texts, not with how often they are quoted.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.session import shared_files, shared_folder, written

# Of a task's file: where a text starts, its bytes there and as text.
PLACE = "struct<file:bigint,start:bigint,stored:int,bytes:int>"
PARTS = {"file": pa.int64(), "start": pa.int64(), "stored": pa.int32(), "bytes": pa.int32()}
CODEC = "zstd"
WRITE_ROWS = 1024
SLICE_BYTES = 4 << 20  # of texts that a reader gives at once, if no row has more
KEPT_BYTES = 32 << 20  # of texts that a reader has read and may give again
OPEN_FILES = 64


def store_texts(df: DataFrame, purpose: str, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a ``place`` instead of its text, and the folder that has the texts.

    A task writes one file, named after the attempt: rows only ever name the files of
    attempts that have ended well. A null text has no place.
    """
    folder = shared_folder(df.sparkSession, purpose)
    kept = [field for field in df.schema.fields if field.name != text]
    schema = T.StructType([*kept, T.StructField("place", T.DataType.fromDDL(PLACE))])
    placed = df.select(*[F.col(f.name) for f in kept], F.col(text)).mapInArrow(_write(folder), schema)
    return written(placed, f"{purpose}-places"), folder


def texts_at(places: Column, folder: str) -> Column:
    """The texts of an array of places, in its order; null where there is no place."""

    @F.arrow_udf("array<string>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = TextReader(folder)
        try:
            for batch in batches:
                for rows in _slices(batch):
                    yield reader.texts(rows)
        finally:
            reader.close()

    return read(places)


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared_files(folder)
        store.create_dir(root, recursive=True)
        file, codec, end = TaskContext.get().taskAttemptId(), pa.Codec(CODEC), 0
        with store.open_output_stream(f"{root}/{file}") as sink:
            for batch in batches:
                for at in range(0, batch.num_rows, WRITE_ROWS):
                    rows, places = batch.slice(at, WRITE_ROWS), []
                    for text in rows.column(rows.num_columns - 1).cast(pa.large_binary()).to_pylist():
                        if text is None:
                            places.append(None)
                            continue
                        packed = codec.compress(text, asbytes=True)
                        sink.write(packed)
                        places.append((file, end, len(packed), len(text)))
                        end += len(packed)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns[:-1], _places(places)], [*rows.schema.names[:-1], "place"]
                    )

    return write


def _places(places: list) -> pa.Array:
    rows = [None if place is None else dict(zip(PARTS, place)) for place in places]
    return pa.array(rows, pa.struct(list(PARTS.items())))


def bytes_of(lists: pa.Array) -> np.ndarray:
    """Per list of places the bytes of their texts."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    sizes = pc.fill_null(pc.struct_field(lists.flatten(), "bytes"), 0).to_numpy()
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return np.diff(sums[np.concatenate([[0], np.cumsum(lengths)])])


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    """Parts of lists of places whose texts take about ``SLICE_BYTES``."""
    ends = np.concatenate([[0], np.cumsum(bytes_of(batch))])
    at = 0
    while at < len(batch):
        stop = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, at + 1), len(batch))
        yield batch.slice(at, stop - at)
        at = stop


class TextReader:
    """Texts of a store's files; those used last are kept, within bounds."""

    def __init__(self, folder: str):
        self.store, self.root = shared_files(folder)
        self.codec = pa.Codec(CODEC)
        self.files: OrderedDict[int, pa.NativeFile] = OrderedDict()
        self.kept: OrderedDict[tuple[int, int], bytes] = OrderedDict()
        self.held = 0

    def texts(self, rows: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
        flat = rows.flatten()
        columns = [pc.struct_field(flat, n).to_pylist() for n in PARTS]
        wanted = {(p[0], p[1]): p[2:] for p in zip(*columns) if p[0] is not None}
        found = {}
        for place in sorted(wanted):  # a file is read forward
            found[place] = self._text(place, *wanted[place])
        texts = [found.get(place) for place in zip(*columns[:2])]
        # Bytes were taken as they were and are given back so, without a look at them.
        raw = pa.array(texts, pa.binary())
        values = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), raw.null_count)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=rows.is_null())

    def _text(self, place: tuple[int, int], stored: int, size: int) -> bytes:
        if place in self.kept:
            self.kept.move_to_end(place)
            return self.kept[place]
        if not size:
            return b""
        packed = self._file(place[0]).read_at(stored, place[1])
        if len(packed) != stored:
            raise RuntimeError(f"file {place[0]} of {self.root} ends within the text at {place[1]}")
        text = self.codec.decompress(packed, decompressed_size=size, asbytes=True)
        self.kept[place] = text
        self.held += size
        while self.held > KEPT_BYTES:
            self.held -= len(self.kept.popitem(last=False)[1])
        return text

    def _file(self, number: int) -> pa.NativeFile:
        if number in self.files:
            self.files.move_to_end(number)
            return self.files[number]
        if len(self.files) >= OPEN_FILES:
            self.files.popitem(last=False)[1].close()
        self.files[number] = self.store.open_input_file(f"{self.root}/{number}")
        return self.files[number]

    def close(self) -> None:
        for file in self.files.values():
            file.close()
