"""Exact nearest vectors within blocks, the part of a search that runs in tasks.

Distances that decide or leave a block are summed in dimension order on
doubles; the matrix product only preselects, with a margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUERY_BLOCK = 512
SLAB_ROWS = 4096
MERGE_ROWS = 1 << 11
SLICE_BYTES = 4 << 20
CROWDED = 4  # times k rows of a slab below the bound: the slab's own k-th is looked at
ROUNDING = 2.0**-22  # of a term of a sum in single precision, with room
LARGEST = 1e30  # squared lengths beyond are not compared in single precision


def rows_of(ids, vectors, dim: int) -> tuple[list, np.ndarray]:
    """Ids and matrix of the rows whose vector has the right size and no gaps.

    Tested here and not by a filter on the DataFrame: where the vectors are
    computed by a UDF, Spark would compute them once more for the filter.
    """
    if isinstance(vectors, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    if not pc.all(fits).as_py():
        ids, vectors = ids.filter(fits), vectors.filter(fits)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)  # null reads as NaN
    matrix = np.ascontiguousarray(flat, dtype=np.float64).reshape(-1, dim)
    good = ~np.isnan(matrix).any(axis=1)
    if good.all():
        return ids.to_pylist(), matrix
    return ids.filter(pa.array(good)).to_pylist(), matrix[good]


def slices_of(batch: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors take ``SLICE_BYTES`` as doubles; copies are sorted there."""
    rows = max(256, SLICE_BYTES // (8 * dim))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Best:
    """Best k per question over the index blocks seen so far, kept in arrays.

    A product in single precision preselects, with a margin beyond its rounding. Once a
    question has k rows their last distance is a bound for all later slabs; a slab with many
    rows below it has a better one of its own.
    """

    def __init__(self, ids, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.limit = np.full(len(ids), np.inf)
        self.filled = np.zeros(len(ids), dtype=np.int64)
        self.scores: np.ndarray | None = None  # made with the first block
        self.hits: np.ndarray | None = None

    def add(self, ids, block: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Index rows for all questions, or for those at the places ``asked`` alone."""
        asked = np.arange(len(self.vectors)) if asked is None else asked
        ids, block = without_surplus_copies(ids, block, self.k)
        if not len(ids) or not len(asked):
            return
        ids = _id_array(ids)
        if self.scores is None:
            self.scores = np.full((len(self.vectors), self.k), np.inf)
            self.hits = np.empty((len(self.vectors), self.k), dtype=ids.dtype)
        elif self.hits.dtype != ids.dtype:
            self.hits, ids = self.hits.astype(object), ids.astype(object)
        block_norms = np.einsum("ij,ij->i", block, block)
        for at in range(0, len(block), SLAB_ROWS):
            slab, norms = block[at : at + SLAB_ROWS], block_norms[at : at + SLAB_ROWS]
            most = norms.max()
            sides = np.empty((len(slab), slab.shape[1] + 1), dtype=np.float32)
            if most < LARGEST:
                sides[:, :-1], sides[:, -1] = slab, norms
            for start in range(0, len(asked), QUERY_BLOCK):
                part = asked[start : start + QUERY_BLOCK]
                rows, cols = self._candidates(part, sides, most)
                self._merge(part[rows], cols, ids[at : at + SLAB_ROWS], slab)

    def _candidates(self, part, sides, most):
        norms, limit = self.norms[part], self.limit[part]
        if not (most < LARGEST and norms.max() < LARGEST):  # beyond single precision
            return tuple(g.ravel() for g in np.indices((len(norms), len(sides))))
        asked = np.ones((len(norms), sides.shape[1]), dtype=np.float32)
        asked[:, :-1] = -2.0 * self.vectors[part]
        rough = asked @ sides.T  # the distance without the question's own norm
        margin = (sides.shape[1] + 8) * ROUNDING * (1.0 + norms + most)
        bound = (limit - norms + margin).astype(np.float32)
        near = rough <= bound[:, None]
        if len(sides) > self.k:
            # Among these rows alone the k-th is a bound too, and the better one where many
            # rows are nearer than what was found so far.
            crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > CROWDED * self.k)
            if len(crowded):
                kth = np.partition(rough[crowded], self.k - 1, axis=1)[:, self.k - 1]
                nearer = (kth + 2.0 * margin[crowded]).astype(np.float32)
                bound[crowded] = np.minimum(bound[crowded], nearer)
                near[crowded] = rough[crowded] <= bound[crowded, None]
        return np.nonzero(near)

    def _merge(self, rows, cols, ids, block) -> None:
        if not len(rows):
            return
        score = np.zeros(len(rows))
        for at in range(0, len(rows), MERGE_ROWS):
            piece = slice(at, at + MERGE_ROWS)
            gap = np.ascontiguousarray((self.vectors[rows[piece]] - block[cols[piece]]).T)
            for step in gap:  # dimension order, as a left fold
                score[piece] += step * step
        near = ~(score > self.limit[rows])
        rows, score, found = rows[near], score[near], ids[cols[near]]
        met = np.unique(rows)
        held = np.arange(self.k)[None, :] < self.filled[met][:, None]
        rows = np.concatenate([np.repeat(met, self.filled[met]), rows])
        score = np.concatenate([self.scores[met][held], score])
        found = np.concatenate([self.hits[met][held], found])
        order = np.lexsort((_ranks(found), score, rows))
        rows, score, found = rows[order], score[order], found[order]
        first = np.searchsorted(rows, rows)
        place = np.arange(len(rows)) - first
        kept = place < self.k
        rows, place = rows[kept], place[kept]
        self.scores[rows, place], self.hits[rows, place] = score[kept], found[kept]
        self.filled[met] = np.bincount(np.searchsorted(met, rows), minlength=len(met))
        full = met[self.filled[met] == self.k]
        self.limit[full] = self.scores[full, -1]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        names, types = schema.names, [f.type for f in schema]
        if self.scores is None:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names)
        held = np.arange(self.k)[None, :] < self.filled[:, None]
        asked = pa.array(self.ids, type=types[0]).take(pa.array(np.nonzero(held)[0]))
        columns = [asked, pa.array(self.hits[held], type=types[1]),
                   pa.array(self.scores[held], type=types[2])]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _id_array(ids) -> np.ndarray:
    """Ids as numbers where all are, as Python objects otherwise."""
    if all(type(i) is int for i in ids):
        return np.array(ids, dtype=np.int64)
    out = np.empty(len(ids), dtype=object)
    out[:] = ids
    return out


def _ranks(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, null first."""
    if ids.dtype != object:
        return ids
    known = sorted(set(ids.tolist()), key=lambda i: (i is not None, i))
    rank = {i: n for n, i in enumerate(known)}
    return np.array([rank[i] for i in ids.tolist()], dtype=np.int64)


def without_surplus_copies(ids, block: np.ndarray, k: int):
    """Of equal vectors only the k smallest ids can be among the best k.

    Dropping the others first keeps a block of copies from making every one of
    its rows a candidate for every question.
    """
    if len(block) <= k:
        return ids, block
    rows = np.ascontiguousarray(block + 0.0).view(np.dtype((np.void, block.shape[1] * 8))).ravel()
    _, group, counts = np.unique(rows, return_inverse=True, return_counts=True)
    if counts.max() <= k:
        return ids, block
    kept, seen = [], np.zeros(len(counts), dtype=np.int64)
    for at in sorted(range(len(ids)), key=ids.__getitem__):
        if seen[group[at]] < k:
            seen[group[at]] += 1
            kept.append(at)
    return [ids[at] for at in kept], block[kept]
