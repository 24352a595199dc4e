"""Distances of a block of candidate rows to a bounded set of source vectors.

This is the per-task helper of ``placerank.operators.neighbours``.  Spark decides
which rows reach it; it never sees more than one Arrow batch of candidates and
keeps no more than ``n`` of them per source and country.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Distances are reported to this many decimals, so that equal listings tie and
# are ordered by id instead of by rounding noise.
DIGITS = 6
_TIE = 2 * 10.0**-DIGITS
_CHUNK = 64
_MATRIX_CELLS = 4_000_000
_FEW = 16
#: Entries of the rows of one distance matrix, a longer row alone.
_ENTRIES = 1 << 21
#: Entries of sparse rows that are taken times the weights of a chunk of sources at once.
_PRODUCTS = 1 << 16


def _ragged(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column as flat values and row lengths."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.asarray(column.flatten()).astype(dtype, copy=False), lengths


def _row_sums(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Sums of consecutive entries that belong to the same row."""
    out = np.zeros((n_rows,) + values.shape[1:])
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


@dataclass
class Block:
    """Rows of vectors: dense if ``indices`` is None, else one run per row."""

    values: np.ndarray
    lengths: np.ndarray
    indices: np.ndarray | None

    @classmethod
    def from_columns(cls, values: pa.Array, indices: pa.Array | None) -> Block:
        flat, lengths = _ragged(values, "float64")
        found = None if indices is None else _ragged(indices, "int64")[0]
        return cls(flat, lengths, found)

    @property
    def n_rows(self) -> int:
        return len(self.lengths)

    def dense(self) -> np.ndarray:
        return self.values.reshape(self.n_rows, -1)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.lengths)

    def squared_norms(self) -> np.ndarray:
        return _row_sums(self.values**2, self.rows(), self.n_rows)


def _sparse_dots(candidates: Block, sources: Block) -> np.ndarray:
    """Dot products, candidates by sources, over the terms the sources hold."""
    dots = np.zeros((candidates.n_rows, sources.n_rows))
    rows, source_rows = candidates.rows(), sources.rows()
    for first in range(0, sources.n_rows, _CHUNK):
        width = min(_CHUNK, sources.n_rows - first)
        mine = (source_rows >= first) & (source_rows < first + width)
        terms, places = np.unique(sources.indices[mine], return_inverse=True)
        if not len(terms):
            continue
        weights = np.zeros((len(terms), width))
        weights[places, source_rows[mine] - first] = sources.values[mine]
        at = np.minimum(np.searchsorted(terms, candidates.indices), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == candidates.indices)
        # A row's products may come in two parts, which add up.
        for start in range(0, len(hit), _PRODUCTS):
            some = hit[start : start + _PRODUCTS]
            low, high = rows[some[0]], rows[some[-1]] + 1
            products = candidates.values[some, None] * weights[at[some]]
            dots[low:high, first : first + width] += _row_sums(products, rows[some] - low, high - low)
    return dots


def distances(candidates: Block, sources: Block) -> np.ndarray:
    """Euclidean distances, candidates by sources, rounded."""
    if candidates.indices is None:
        dots = candidates.dense() @ sources.dense().T
    else:
        dots = _sparse_dots(candidates, sources)
    squared = (
        candidates.squared_norms()[:, None] + sources.squared_norms()[None, :] - 2 * dots
    )
    return np.round(np.sqrt(np.maximum(squared, 0.0)), DIGITS)


def _met(lists: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``lists`` of ids, and where in ``ids`` each of their entries is."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    asked, order = as_ids(lists.flatten()), np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, asked, sorter=order), len(ids) - 1)]
    known = ids[at] == asked
    return np.repeat(np.arange(len(lengths)), lengths)[known], at[known]


def met_distances(candidates: Block, sources: Block, lists: pa.Array, ids: np.ndarray) -> np.ndarray:
    """As ``distances``, infinite but for the sources of each candidate's list.

    Few pairs of dense vectors are measured one by one.
    """
    rows, at = _met(lists, ids)
    found = np.full((candidates.n_rows, sources.n_rows), np.inf)
    if candidates.indices is not None or len(rows) * _FEW > found.size:
        found[rows, at] = distances(candidates, sources)[rows, at]
        return found
    a, b = candidates.dense(), sources.dense()
    a_norms, b_norms = candidates.squared_norms(), sources.squared_norms()
    step = max(1, _MATRIX_CELLS // max(a.shape[1], 1))
    for first in range(0, len(rows), step):
        i, j = rows[first : first + step], at[first : first + step]
        squared = a_norms[i] + b_norms[j] - 2 * np.einsum("ij,ij->i", a[i], b[j])
        found[i, j] = np.round(np.sqrt(np.maximum(squared, 0.0)), DIGITS)
    return found


@dataclass
class Sources:
    """The source side of a search; small enough to be sent to every task."""

    ids: np.ndarray
    block: Block
    targets: list[list[str]]

    def by_country(self) -> dict[str, np.ndarray]:
        wanted: dict[str, list[int]] = {}
        for position, countries in enumerate(self.targets):
            for country in countries:
                wanted.setdefault(country, []).append(position)
        return {c: np.asarray(sorted(set(p))) for c, p in wanted.items()}

    def part(self, positions: np.ndarray) -> Block:
        starts = np.r_[0, np.cumsum(self.block.lengths)]
        picked = [np.arange(starts[p], starts[p + 1]) for p in positions]
        take = np.concatenate(picked) if picked else np.zeros(0, dtype=np.int64)
        indices = None if self.block.indices is None else self.block.indices[take]
        return Block(self.block.values[take], self.block.lengths[positions], indices)


def as_ids(column: pa.Array) -> np.ndarray:
    """Ids as a sortable numpy array."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.asarray(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


def _nearest(sources: np.ndarray, ids: np.ndarray, dist: np.ndarray, n: int):
    """The first ``n`` by distance and id of each source, as aligned arrays."""
    order = np.lexsort((ids, dist, sources))
    sources, ids, dist = sources[order], ids[order], dist[order]
    first = np.searchsorted(sources, sources, side="left")
    keep = np.arange(len(sources)) - first < n
    return sources[keep], ids[keep], dist[keep]


def _slices(batches: Iterable[pa.RecordBatch], wanted: dict[str, np.ndarray]):
    """Rows of one wanted country at a time, few and short enough for one distance matrix."""
    for batch in batches:
        for country in pc.unique(batch.column("addr_cc")).to_pylist():
            if country not in wanted:
                continue
            rows = batch.filter(pc.equal(batch.column("addr_cc"), country))
            ends = np.cumsum(pc.list_value_length(rows.column("values")).to_numpy(zero_copy_only=False))
            step, first = max(1, _MATRIX_CELLS // len(wanted[country])), 0
            while first < rows.num_rows:
                before = ends[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(ends, before + _ENTRIES, side="right")))
                stop = min(stop, first + step)
                yield country, rows.slice(first, stop - first)
                first = stop


def nearest_in_batches(
    batches: Iterable[pa.RecordBatch], sources: Sources, n: int, drop_self: bool
) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per country: source positions, neighbour ids and distances of the best rows."""
    wanted = sources.by_country()
    parts = {c: sources.part(p) for c, p in wanted.items()}
    best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    # Once a source has n rows, only rows as near as its n-th are looked at.
    bound = {c: np.full(len(p), np.inf) for c, p in wanted.items()}
    for country, rows in _slices(batches, wanted):
        sparse = rows.column("indices") if "indices" in rows.schema.names else None
        block = Block.from_columns(rows.column("values"), sparse)
        ids = as_ids(rows.column("property_id"))
        positions = wanted[country]
        if "sources" in rows.schema.names:
            dist = met_distances(block, parts[country], rows.column("sources"), sources.ids[positions])
        else:
            dist = distances(block, parts[country])
        if drop_self:
            dist[ids[:, None] == sources.ids[positions][None, :]] = np.inf
        limit = bound[country]
        if len(ids) > n:
            limit = np.minimum(limit, np.partition(dist, n - 1, axis=0)[n - 1])
        row, col = np.nonzero((dist <= limit + _TIE) & np.isfinite(dist))
        if not len(row):
            continue
        found = (positions[col], ids[row], dist[row, col])
        if country in best:
            found = tuple(np.concatenate(pair) for pair in zip(best[country], found))
        best[country] = _nearest(*found, n)
        bound[country] = _nth(best[country], positions, n)
    for country, found in best.items():
        yield (country, *found)


def _nth(best: tuple, positions: np.ndarray, n: int) -> np.ndarray:
    """The n-th distance of each source, or infinity while it has fewer."""
    sources, _, dist = best
    ends = np.searchsorted(sources, positions, side="right")
    full = ends - np.searchsorted(sources, positions, side="left") >= n
    return np.where(full, dist[np.maximum(ends - 1, 0)], np.inf)


def total_distances(batch: pa.RecordBatch, picks: Block) -> np.ndarray:
    """Summed distance of each row of a batch to all picks, rounded."""
    sparse = batch.column("indices") if "indices" in batch.schema.names else None
    block = Block.from_columns(batch.column("values"), sparse)
    return np.round(distances(block, picks).sum(axis=1), DIGITS)


def block_of(rows: Sequence, sparse: bool) -> Block:
    """A block from collected rows with ``values`` and, if sparse, ``indices``."""
    values = pa.array([r["values"] for r in rows], pa.list_(pa.float64()))
    indices = pa.array([r["indices"] for r in rows], pa.list_(pa.int64())) if sparse else None
    return Block.from_columns(values, indices)
