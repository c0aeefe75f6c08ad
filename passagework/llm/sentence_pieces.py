"""SentencePiece encoding by suffix arrays, and decoding.

The segments of a batch that a worker has not met are put side by side and their
suffixes sorted; every piece of the vocabulary is found in them by binary search.
Each occurrence is an edge from its start to its end. Edges are relaxed in order of
position: of the edges that reach a position exactly one ends the encoding of the
text up to there, namely the one that byte-pair merging would not have joined with,
or cut across, the piece before it. That test needs only the two pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import id_and_text, slices, texts_of, worker_state

MARK = "▁"
# What a worker keeps for its later tasks, in two such caches, and texts that are cut up at once.
CACHE_SEGMENTS = 60_000
PAIR_SLOTS = 1 << 21
RUN_LETTERS = 300_000
SLICE_TEXTS = 256
FAR = np.int64(2**40)
START, UNKNOWN, NONE = -1, -2, -3
NORMAL, BYTE = 1, 6


class Merges:
    """Reachable pieces of a byte-pair vocabulary: how, and when, each is formed.

    A symbol is a piece or a single character that only stands inside pieces.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        kinds = {p.type for p in spec.pieces} - {2, 3}
        if spec.trainer_spec.model_type != 2 or not kinds <= {NORMAL, BYTE} or BYTE not in kinds:
            raise ValueError("not a byte-pair model with byte fallback and plain pieces")
        rule = spec.normalizer_spec
        if not rule.add_dummy_prefix or not rule.escape_whitespaces:
            raise ValueError("not a model that marks the start of a text as a blank")
        self.plain = rule.name == "identity" and not rule.remove_extra_whitespaces
        normal = [(i, p.piece, p.score) for i, p in enumerate(spec.pieces) if p.type == NORMAL]
        self.byte_ids = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        self.decoded = [
            b"" if p.type in (2, 3) else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE
            else p.piece.replace(MARK, " ").encode()
            for p in spec.pieces
        ]
        order = {s: r for r, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        rank = {piece: order[score] for _, piece, score in normal}
        known = {piece: i for i, piece, _ in normal}
        letters = sorted({c for _, piece, _ in normal for c in piece})
        self.virtual = len(spec.pieces)
        self.symbols = [(p, i) for i, p, _ in normal if len(p) == 1]
        loose = [c for c in letters if c not in known]
        self.symbols += [(c, self.virtual + k) for k, c in enumerate(loose)]
        number = dict(self.symbols)
        size = self.virtual + len(loose)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.time = np.full(size, -1, dtype=np.int64)
        self.irregular = []
        for i, piece, _ in sorted(normal, key=lambda x: len(x[1])):
            if len(piece) < 2:
                continue
            parts = _merge(piece, rank)
            if parts is None:
                continue
            number[piece] = i
            self.symbols.append((piece, i))
            self.left[i], self.right[i] = number[parts[0]], number[parts[1]]
            self.time[i] = rank[piece]
            if rank[piece] < max(self.time[self.left[i]], self.time[self.right[i]]):
                self.irregular.append(piece)
        pairs = {}
        for piece, i in number.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank[piece]
        self.size = size
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_times = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.closed = not any(MARK in p.lstrip(MARK) for _, p, _ in normal)
        self.letters = letters
        self._pack()

    @classmethod
    def restored(cls, state: dict) -> Merges:
        """The tables as a broadcast brings them: plain values only."""
        merges = object.__new__(cls)
        merges.__dict__.update(state)
        return merges

    def _pack(self) -> None:
        """Pieces as numbers of four letters each, for the binary search."""
        code = {c: k + 1 for k, c in enumerate(self.letters)}
        if len(code) >= 65535:
            raise ValueError("too many letters")
        self.code = code
        longest = max(len(p) for p, _ in self.symbols)
        self.quads = -(-longest // 4)
        self.lengths = np.array([len(p) for p, _ in self.symbols], dtype=np.int64)
        self.ids = np.array([i for _, i in self.symbols], dtype=np.int64)
        padded = np.zeros((len(self.symbols), self.quads * 4), dtype=np.uint64)
        ceiling = np.full_like(padded, 0xFFFF)
        for row, (piece, _) in enumerate(self.symbols):
            padded[row, : len(piece)] = ceiling[row, : len(piece)] = [code[c] for c in piece]
        self.low, self.high = (_quads(x.reshape(-1, 4)).reshape(-1, self.quads)
                               for x in (padded, ceiling))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a text whose parts are ``a`` and ``b`` keeps them apart.

        Goes back in time: the part formed last is undone, to its side next to the
        boundary. At each stage the two neighbours must not merge before the event
        that ended the stage; of equal ranks the one further left comes first.
        """
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        limit = np.full(len(a), FAR)
        x, y = a.copy(), b.copy()
        while len(live):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            found = self.pair_keys[at] == key
            merged = found & (2 * self.pair_times[at] < limit)
            good[live[merged]] = False
            tx, ty = self.time[x], self.time[y]
            go = ~merged & ((tx >= 0) | (ty >= 0))
            live, x, y, tx, ty = live[go], x[go], y[go], tx[go], ty[go]
            first = tx > ty
            limit = np.where(first, 2 * tx, 2 * ty + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return good


def _merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two parts of the last merge, or None if merging does not end in the piece."""
    parts, last = list(piece), None
    while len(parts) > 1:
        best = min(
            ((rank[a + b], k) for k, (a, b) in enumerate(pairwise(parts)) if a + b in rank),
            default=None,
        )
        if best is None:
            return None
        k = best[1]
        last = (parts[k], parts[k + 1])
        parts[k : k + 2] = [last[0] + last[1]]
    return last


def _quads(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.uint64)
    return (c[:, 0] << np.uint64(48)) | (c[:, 1] << np.uint64(32)) | (
        c[:, 2] << np.uint64(16)
    ) | c[:, 3]


def suffix_array(codes: np.ndarray, quad: np.ndarray, width: int) -> np.ndarray:
    """Positions in the order of the ``width`` letters that follow, by doubling."""
    key, length = quad[: len(codes)], 4
    order = np.argsort(key)
    while length < width:
        ranked = key[order]
        rank = np.zeros(len(codes) + length, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
        key = rank[: len(codes)] * (len(codes) + 1) + rank[length : length + len(codes)]
        order, length = np.argsort(key), length * 2
    return order


def occurrences(merges: Merges, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence (start, length, symbol) of every symbol in a coded text."""
    width = merges.quads * 4
    tail = np.concatenate((codes, np.zeros(width + 4, dtype=codes.dtype)))
    quad = _quads(np.lib.stride_tricks.sliding_window_view(tail, 4))
    suffixes = suffix_array(codes, quad, width)
    keys = [quad[4 * k : 4 * k + len(codes)] for k in range(merges.quads)]
    first = keys[0][suffixes]
    low = np.searchsorted(first, merges.low[:, 0], side="left")
    high = np.searchsorted(first, merges.high[:, 0], side="right")
    long = np.flatnonzero((merges.lengths > 4) & (low < high))
    if len(long):
        a, b = low[long], high[long]
        low[long] = _bound(keys, suffixes, a, b, merges.low[long], False)
        high[long] = _bound(keys, suffixes, a, b, merges.high[long], True)
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    start = np.repeat(low[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return (
        suffixes[start].astype(np.int32),
        np.repeat(merges.lengths[hit].astype(np.int32), count),
        np.repeat(merges.ids[hit].astype(np.int32), count),
    )


def _bound(keys, suffixes, low, high, targets, after: bool) -> np.ndarray:
    """Binary search of every target at once, within its own range of suffixes."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if len(open_) == 0:
            return low
        middle = (low[open_] + high[open_]) // 2
        at = suffixes[middle]
        less = np.zeros(len(open_), dtype=bool)
        same = np.ones(len(open_), dtype=bool)
        for k, key in enumerate(keys):
            value, target = key[at], targets[open_, k]
            less |= same & (value < target)
            same &= value == target
        if after:
            less |= same
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


class Encoder:
    """The vocabulary in a worker, with the segments it has met of late.

    When the cache is full it becomes the older one, from which segments come back
    when they are met again; what was not met meanwhile is dropped.
    """

    def __init__(self, model: bytes, merges: Merges):
        import sentencepiece

        self.merges = merges
        self.normalize = sentencepiece.SentencePieceProcessor(model_proto=model).normalize
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.letters = np.zeros(0x110000, dtype=np.uint16)
        for letter, code in merges.code.items():
            self.letters[ord(letter)] = code

    def segments(self, text: str) -> list[str]:
        """Parts of the text that are encoded alone, without the blank mark they start with."""
        if not text:
            return []
        if not (self.merges.plain and self.merges.closed):
            plain = self.normalize(text)
        elif text[0] == " " or "  " in text or MARK in text:
            plain = MARK + text.replace(" ", MARK)
        else:
            return text.split(" ")
        if not self.merges.closed:
            return [plain[1:]] if plain else []
        return [s[1:] for s in self.cut(plain)]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`Merges.apart` behind a table of the pairs met last."""
        key = a.astype(np.int64) * self.merges.size + b
        slot = _scatter(key) % PAIR_SLOTS
        known = self.pairs[slot]
        good = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            value = self.merges.apart(fresh // self.merges.size, fresh % self.merges.size)[back]
            good[new] = value
            self.pairs[slot[new]] = key[new] << 1 | value
        return good

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Token ids of each segment behind a blank mark, as the bytes of 32-bit numbers."""
        joined = MARK + f"\0{MARK}".join(segments) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments)) + 1
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        codes = self.letters[points]
        codes[ends] = 0
        at, length, symbol = occurrences(self.merges, codes)
        unknown = codes == 0
        unknown[ends] = False
        unknown = np.flatnonzero(unknown).astype(np.int32)
        if len(unknown):
            at = np.concatenate((at, unknown))
            length = np.concatenate((length, np.ones(len(unknown), dtype=np.int32)))
            symbol = np.concatenate((symbol, np.full(len(unknown), UNKNOWN, dtype=np.int32)))
        stop = at + length
        depth = stop - np.repeat(starts.astype(np.int32), lengths + 1)[at]
        if lengths.max(initial=0) < 2**15:
            depth = depth.astype(np.int16)  # sorted by radix
        order = np.argsort(depth, kind="stable")
        at, stop, symbol = at[order], stop[order], symbol[order]
        last = np.full(len(codes) + 1, NONE, dtype=np.int32)
        last[starts] = START
        back = np.zeros(len(codes) + 1, dtype=np.int32)
        rounds = np.cumsum(np.bincount(depth)) if len(depth) else [0]
        for begin, end in pairwise(rounds):
            a, b, s = at[begin:end], stop[begin:end], symbol[begin:end]
            before = last[a]
            good = (before < 0) | (s < 0)
            test = np.flatnonzero(~good)
            good[test] = self.apart(before[test], s[test])
            last[b[good]] = s[good]
            back[b[good]] = a[good]
        mark = np.zeros(len(codes) + 1, dtype=bool)
        place = ends
        while len(place):
            mark[place] = True
            place = back[place]
            place = place[last[place] != START]
        token_ends = np.flatnonzero(mark)
        tokens = last[token_ends]
        bounds = np.concatenate(([0], np.searchsorted(token_ends, ends, side="right"))).tolist()
        odd = (tokens < 0) | (tokens >= self.merges.virtual)
        if not odd.any():
            raw = tokens.tobytes()
            return [raw[4 * a : 4 * b] for a, b in pairwise(bounds)]
        letters = [chr(p).encode() for p in points[token_ends[odd] - 1].tolist()]
        spelled = dict(zip(np.flatnonzero(odd).tolist(), letters))
        raw = tokens.tobytes()
        found = [raw[4 * a : 4 * b] for a, b in pairwise(bounds)]
        with_odd = np.unique(np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1)
        for n in with_odd.tolist():
            ids: list[int] = []
            for k in range(bounds[n], bounds[n + 1]):
                ids += [self.merges.byte_ids[x] for x in spelled[k]] if k in spelled else [tokens[k]]
            found[n] = np.array(ids, dtype=np.int32).tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.segments(t) for t in texts]
        if len(self.cache) > CACHE_SEGMENTS:
            self.older, self.cache = self.cache, {}
        found = [list(map(self.cache.get, s)) for s in cut]
        missing = set()
        for segments, coded in zip(cut, found):
            if None in coded:
                missing.update(s for s, c in zip(segments, coded) if c is None)
        self._add(missing)
        for segments, coded in zip(cut, found):
            if None in coded:
                coded[:] = [self.cache[s] if c is None else c for s, c in zip(segments, coded)]
        return [b"".join(coded) for coded in found]

    def _add(self, missing: set[str]) -> None:
        """The missing segments come from the older cache, or are encoded in runs."""
        new, letters = [], 0
        for segment in missing:
            if segment in self.older:
                self.cache[segment] = self.older[segment]
                continue
            new.append(segment)
            letters += len(segment)
            if letters >= RUN_LETTERS:
                self.cache.update(zip(new, self.encode_segments(new)))
                new, letters = [], 0
        if new:
            self.cache.update(zip(new, self.encode_segments(new)))

    def decode(self, ids: list[int]) -> str:
        return decode_ids(self.merges.decoded, ids)


def _scatter(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(
        np.int64
    )


def decode_ids(pieces: list[bytes], ids: list[int]) -> str:
    """Pieces side by side; the blank before the first word goes."""
    text = b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _encoder(shared) -> Encoder:
    model, tables = shared.value
    return worker_state(
        ("sentence pieces", hash(model)), lambda: Encoder(model, Merges.restored(tables))
    )


def _encode(shared, check: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in slices(batches, SLICE_TEXTS):
            texts = texts_of(batch)
            coded = encoder.encode(texts)
            offsets = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32))
            )
            columns = [batch.column("doc_id"), ids, pa.array(np.diff(offsets).astype(np.int64))]
            names = ["doc_id", "ids", "n_tokens"]
            if check:
                same = [
                    encoder.decode(np.frombuffer(c, dtype=np.int32).tolist()) == t
                    for c, t in zip(coded, texts)
                ]
                columns.append(pa.array(same, pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return read


def _decode(shared):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value[1]["decoded"]
        for batch in slices(batches, SLICE_TEXTS):
            texts = [decode_ids(pieces, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return read


def _shared(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        model = f.read()
    return df.sparkSession.sparkContext.broadcast((model, vars(Merges(model))))


def encode(
    docs: DataFrame,
    model_path: str,
    check: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, n_tokens, and round_trip on demand.

    The ids are those of the byte-pair model at ``model_path`` (read on the
    driver), without begin and end. ``round_trip`` tells whether they decode to the
    text; a text that holds the library's own blank mark does not. Null and empty
    texts have no tokens. Ids of documents are passed through, null and repeated
    ones too; an empty table gives no rows.
    """
    fields = "doc_id long, ids array<int>, n_tokens long" + ", round_trip boolean" * check
    own = id_and_text(docs, id_column, text_column)
    return own.mapInArrow(_encode(_shared(docs, model_path), check), fields)


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids give an empty text."""
    own = tokens.select(F.col("doc_id"), F.col("ids"))
    return own.mapInArrow(_decode(_shared(tokens, model_path)), "doc_id long, text string")
