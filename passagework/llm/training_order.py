"""Token ids in training order, as records of one size.

All documents, each closed by an end id, form one stream in the order in which
they are read, cut into sequences of one length. A keyed permutation of the sequence numbers
gives every sequence its slot: a balanced Feistel network over the next power of
four, walked along its cycle until it falls inside the range. Tokens travel once,
straight to the range of slots they belong to, and a shard is a run of slots:
record i of shard s is slot s * shard_slots + i, at byte i * stride.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import sentence_pieces
from passagework.llm.common import (
    id_and_text,
    sized,
    slices,
    stored,
    worker_state,
)

ROUNDS = 6
SEQUENCE_TOKENS = 1024
SHARD_SLOTS = 4096
MAX_TASKS = 1 << 15
MAX_VOCABULARY = 1 << 16
# Longer texts are encoded word by word, as the library holds far more than the text.
LONG_TEXT = 1 << 16
# Words of one call of the library, and bytes of text whose words are looked up together.
RUN_WORDS = 500
PART_BYTES = 8 << 20
# What is written once and read once is packed well; pages are as large as a part.
CODEC = "zstd"
STORED = {
    "compression": CODEC,
    "parquet.compression.codec.zstd.level": 7,
    "parquet.page.size": PART_BYTES,
}
RUN_LEVEL = 3
INDEX = ["slot", "sequence", "shard", "byte_offset", "doc_ids", "path"]


class Permutation:
    """A keyed bijection of range(n), computed number by number."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        digest = hashlib.sha256(key.encode()).digest()
        self.keys = np.frombuffer(digest, dtype="<u4")[:ROUNDS].astype(np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left = x >> np.uint64(self.half)
        right = x & np.uint64((1 << self.half) - 1)
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x).astype(np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, lambda x: self._once(x, self.keys))

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        """The inverse: which sequence a slot holds, to resume or to audit a run."""

        def back(x):
            mask = np.uint64((1 << self.half) - 1)
            swapped = ((x & mask) << np.uint64(self.half)) | (x >> np.uint64(self.half))
            y = self._once(swapped, self.keys[::-1])
            return ((y & mask) << np.uint64(self.half)) | (y >> np.uint64(self.half))

        return self._walk(slot, back)


def special_ids(model: bytes) -> tuple[int, int]:
    """(end id, id that fills up) of a model whose ids fit 16 bits."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    if library.get_piece_size() > MAX_VOCABULARY:
        raise ValueError(f"{library.get_piece_size()} ids do not fit 16 bits")
    if library.eos_id() < 0:
        raise ValueError("the model has no end id")
    return library.eos_id(), max(library.pad_id(), 0)


class Words:
    """The library behind a table of the words of a slice: each is encoded once.

    Where no piece holds a blank inside, and texts are taken as they are, a text is
    its words side by side. Which tokens start a word is then read off the tokens.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        self.starts = np.array([p.startswith(sentence_pieces.MARK) for p in pieces])

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts side by side, and how many each has."""
        # One thread: the cores of an executor belong to its tasks.
        lists = self.library.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ids = np.fromiter(chain.from_iterable(lists), dtype="<u2", count=int(sizes.sum()))
        return ids, sizes

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words without a blank, none of them empty."""
        runs = [" ".join(words[i : i + RUN_WORDS]) for i in range(0, len(words), RUN_WORDS)]
        ids, _ = self.flat(runs)
        first = np.flatnonzero(self.starts[ids])
        if len(first) != len(words):
            return self.flat(words)
        return ids, np.diff(np.append(first, len(ids)))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of some ``PART_BYTES`` of text; one text is never cut."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
        part = np.cumsum(sizes, dtype=np.int64) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in pairwise(cuts):
            if end > start:
                yield batch.slice(start, end - start)


def _tokens(shared, end_id: int):
    def alone(words: Words, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return words.flat([text])[0]
        ids = sentence_pieces._encoder(shared).encode([text])[0]
        return np.frombuffer(ids, dtype=np.int32).astype("<u2")

    def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """16-bit ids of all texts, each closed by an end id, and how many each has."""
        model, tables = shared.value
        words = worker_state(("words", hash(model)), lambda: Words(model))
        own = pc.fill_null(texts, "")
        # Texts whose blanks part no words, or that hold the mark itself, go alone.
        odd = pc.match_substring_regex(own, f"^$|^ | $|  |{sentence_pieces.MARK}")
        if not (tables["plain"] and tables["closed"]):
            odd = pc.fill_null(pc.equal(own, own), True)
        cut = pc.split_pattern(pc.if_else(odd, "", own), " ")
        bounds = np.asarray(cut.offsets).astype(np.int64)
        bounds -= bounds[0]
        coded_words = cut.flatten().dictionary_encode()
        index = np.asarray(coded_words.indices).astype(np.int64)
        known = coded_words.dictionary.to_pylist()
        short = np.array([0 < len(w) <= LONG_TEXT for w in known], dtype=bool)
        ids, sizes = words.words([w for w, s in zip(known, short) if s])
        end = len(known)
        lengths, starts = np.zeros((2, end + 1), dtype=np.int64)
        lengths[:end][short], starts[:end][short] = sizes, np.cumsum(sizes) - sizes
        lengths[end], starts[end] = 1, len(ids)
        rows = np.flatnonzero(np.asarray(odd))
        long = np.flatnonzero(~short & np.array([w != "" for w in known], dtype=bool))
        others = [alone(words, own[row].as_py()) for row in rows.tolist()]
        others += [alone(words, known[k]) for k in long.tolist()]
        more = np.array([len(o) for o in others], dtype=np.int64)
        place = len(ids) + 1 + np.cumsum(more) - more
        index[bounds[rows]] = end + 1 + np.arange(len(rows))
        starts[long], lengths[long] = place[len(rows) :], more[len(rows) :]
        starts = np.append(starts, place[: len(rows)])
        lengths = np.append(lengths, more[: len(rows)])
        flat = np.concatenate([ids, [end_id], *others]).astype("<u2")
        index = np.insert(index, bounds[1:], end)
        n = lengths[index]
        ends = np.cumsum(n)
        place = np.repeat(starts[index] - (ends - n), n)
        place += np.arange(len(place))
        return flat[place], np.diff(ends[bounds[1:] + np.arange(len(own))], prepend=0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, inside = TaskContext.get().partitionId(), 0
        for batch in parts(batches):
            flat, sizes = coded(batch.column("text"))
            ends = np.cumsum(sizes)
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes),
                [None, pa.py_buffer(np.append(0, 2 * ends)), pa.py_buffer(flat)],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), packed.cast(pa.binary()), pa.array(sizes),
                 pa.array(np.full(len(sizes), part, dtype=np.int64)),
                 pa.array(inside + ends - sizes)],
                names=["doc_id", "tokens", "n", "part", "inside"],
            )
            inside += int(ends[-1])

    return read


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds ``offset``: tokens of all rows before, in the order of the stored table.

    A row knows the tokens before it in its part; the totals of the parts, one
    short row for each task that encoded, are summed up and joined.
    """
    from pyspark.sql import Window

    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = stored(
        totals.select(
            "part",
            (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"),
        ),
        "parts",
    )
    return tokens.join(sized(before), "part").withColumn(
        "offset", F.col("before") + F.col("inside")
    )


def _pieces(n_sequences: int, key: str, length: int):
    """Runs of tokens by sequence; packed, as they are most of what is shuffled."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation, codec = Permutation(n_sequences, key), pa.Codec(CODEC, RUN_LEVEL)
        for batch in slices(batches, 1024):
            rows = []
            for doc, raw, offset in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "tokens", "offset"))
            ):
                at = 0
                while at < len(raw) // 2:
                    sequence, start = divmod(offset + at, length)
                    taken = min(length - start, len(raw) // 2 - at)
                    run = codec.compress(raw[2 * at : 2 * (at + taken)], asbytes=True)
                    rows.append((sequence, start, taken, doc, run))
                    at += taken
            if not rows:
                continue
            sequence, start, taken, doc, raw = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(permutation.slot(np.array(sequence))), pa.array(sequence, pa.int64()),
                 pa.array(start, pa.int32()), pa.array(taken, pa.int32()),
                 pa.array(doc, pa.int64()), pa.array(raw, pa.binary())],
                names=["slot", "sequence", "start", "n", "doc_id", "tokens"],
            )

    return read


def _records(length: int, pad_id: int):
    """Pieces, sorted by slot and start, to one record per slot."""

    def record(slot, sequence, docs, raws):
        body = b"".join(raws)
        body += np.full(length - len(body) // 2, pad_id, dtype="<u2").tobytes()
        return slot, sequence, docs, body

    def batch_of(rows):
        slot, sequence, docs, body = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(slot, pa.int64()), pa.array(sequence, pa.int64()),
             pa.array(docs, pa.list_(pa.int64())), pa.array(body, pa.binary())],
            names=["slot", "sequence", "doc_ids", "tokens"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, unpacked = [], None, pa.Codec(CODEC).decompress
        for batch in slices(batches, 1024):
            names = ("slot", "sequence", "n", "doc_id", "tokens")
            for slot, sequence, n, doc, raw in zip(*(batch.column(c).to_pylist() for c in names)):
                if now is None or now[0] != slot:
                    if now is not None:
                        done.append(record(*now))
                    now = (slot, sequence, [], [])
                now[2].append(doc)
                now[3].append(unpacked(raw, 2 * n, asbytes=True))
            if len(done) >= 256:
                yield batch_of(done)
                done = []
        if now is not None:
            done.append(record(*now))
        if done:
            yield batch_of(done)

    return read


def training_order(
    docs: DataFrame,
    model_path: str,
    key: str = "order",
    length: int = SEQUENCE_TOKENS,
    shard_slots: int = SHARD_SLOTS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per slot: slot, sequence, shard, byte_offset, doc_ids, tokens.

    ``tokens`` holds ``length`` little-endian 16-bit ids; the last sequence is
    filled up with the model's padding id, 0 if it has none. A model whose ids do not fit
    16 bits, or without an end id, is refused. Rows are dealt to partitions by ranges of slots and sorted
    in them. Documents follow each other as they are read, null and repeated ids
    too; null and empty texts are an end id alone. An empty table gives no rows.
    """
    own = id_and_text(docs, id_column, text_column)
    shared = sentence_pieces._shared(docs, model_path)
    end_id, pad_id = special_ids(shared.value[0])
    tokens = stored(
        own.mapInArrow(
            _tokens(shared, end_id),
            "doc_id long, tokens binary, n long, part long, inside long",
        ),
        "tokens",
        **STORED,
    )
    total = tokens.agg(F.sum("n")).first()[0] or 0
    sequences = -(-total // length)
    pieces = with_offsets(tokens).mapInArrow(
        _pieces(sequences, key, length),
        "slot long, sequence long, start int, n int, doc_id long, tokens binary",
    )
    shards = max(1, -(-sequences // shard_slots))
    shard = F.floor(F.col("slot") / shard_slots)
    tasks = min(shards, MAX_TASKS)
    task = F.floor(shard * tasks / shards).cast("int")
    dealt = pieces.repartitionById(tasks, task)
    records = dealt.sortWithinPartitions("slot", "start").mapInArrow(
        _records(length, pad_id), "slot long, sequence long, doc_ids array<long>, tokens binary"
    )
    return records.select(
        "slot",
        "sequence",
        shard.alias("shard"),
        (F.pmod("slot", F.lit(shard_slots)) * (2 * length)).alias("byte_offset"),
        "doc_ids",
        "tokens",
    )


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        open_shard, sink, path = None, None, None

        def close():
            sink.close()
            store.move(f"{path}.{attempt}", path)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "tokens"))
            paths = []
            for shard, tokens in zip(*columns):
                if shard != open_shard:
                    if sink is not None:
                        close()
                    path = f"{root}/shard-{shard:08d}.bin"
                    open_shard = shard
                    sink = store.open_output_stream(f"{path}.{attempt}")
                sink.write(tokens)
                paths.append(path)
            kept = [batch.column(c) for c in INDEX[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(paths, pa.string())], names=INDEX)
        if sink is not None:
            close()

    return write


def write_index(records: DataFrame, folder: str) -> DataFrame:
    """Writes the files of :func:`write_shards`; a stored row for each of their records.

    The rows (see ``INDEX``) say where a record lies and which documents are in it;
    its tokens are in the file alone.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return stored(
        records.select(*INDEX[:-1], "tokens").mapInArrow(
            _write(folder),
            "slot long, sequence long, shard long, byte_offset long, doc_ids array<long>, "
            "path string",
        ),
        "index",
    )


def write_shards(records: DataFrame, folder: str, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """The rows of :func:`training_order` as binary files, one per shard.

    ``folder`` is a URI that every executor can write (a shared mount, HDFS, an
    object store). A task writes beside the final name and then renames, so a
    repeated task leaves one file. Returns (shard, path, first_slot, n).
    """
    return manifest(write_index(records, folder))


def manifest(index: DataFrame) -> DataFrame:
    """The files behind an index: (shard, path, first_slot, n)."""
    return index.groupBy("shard", "path").agg(
        F.min("slot").alias("first_slot"), F.count("*").alias("n")
    )


def _read(folder: str, length: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        at, file = None, None
        for batch in slices(batches):
            found = []
            for path, offset in zip(*(batch.column(c).to_pylist() for c in ("path", "byte_offset"))):
                if path != at:
                    if file is not None:
                        file.close()
                    at, file = path, store.open_input_file(path)
                tokens = file.read_at(2 * length, offset)
                if len(tokens) != 2 * length:
                    raise RuntimeError(f"{path} ends within the record at byte {offset}")
                found.append(tokens)
            kept = [batch.column(c) for c in INDEX[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(found, pa.binary())], names=[*INDEX[:-1], "tokens"]
            )
        if file is not None:
            file.close()

    return read


def read_index(index: DataFrame, folder: str, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """The rows of :func:`training_order` with the tokens the files hold."""
    return index.mapInArrow(
        _read(folder, length),
        "slot long, sequence long, shard long, byte_offset long, doc_ids array<long>, "
        "tokens binary",
    )


def read_slots(path_of, slots: Iterator[int], length: int, shard_slots: int) -> Iterator[np.ndarray]:
    """Token ids of ``slots`` from the files of :func:`write_shards`, for a reader that resumes."""
    from pyarrow import fs

    shard, file = None, None
    try:
        for slot in slots:
            if slot // shard_slots != shard:
                if file is not None:
                    file.close()
                shard = slot // shard_slots
                store, path = fs.FileSystem.from_uri(path_of(shard))
                file = store.open_input_file(path)
            at = slot % shard_slots * 2 * length
            yield np.frombuffer(file.read_at(2 * length, at), dtype="<u2")
    finally:
        if file is not None:
            file.close()
