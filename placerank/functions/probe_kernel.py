"""Random projections of vectors and the buckets around them, for one Arrow batch at a time.

This is the per-task helper of ``placerank.operators.probing``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from placerank.functions.nearest_kernel import Block

#: Components are projected by this many random rows; higher indices take one by their last bits.
ROWS = 1 << 18


@dataclass(frozen=True)
class Projections:
    """``tables`` keys of ``functions`` projections each, cut in steps of ``width``."""

    tables: int
    functions: int
    width: float
    seed: int


@lru_cache(maxsize=2)
def _directions(shape: Projections) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(shape.seed)
    many = shape.tables * shape.functions
    offsets = random.uniform(0, 1, size=many)
    return random.normal(size=(ROWS, many)).astype(np.float32), offsets


def places(block: Block, shape: Projections) -> np.ndarray:
    """Vectors by tables by functions: where they lie, in steps."""
    directions, offsets = _directions(shape)
    if block.indices is None:
        dense = block.dense()
        found = np.zeros((len(dense), directions.shape[1]))
        for first in range(0, dense.shape[1], ROWS):
            part = dense[:, first : first + ROWS]
            found += part @ directions[: part.shape[1]]
    else:
        found = np.zeros((block.n_rows, directions.shape[1]))
        starts = np.r_[0, np.cumsum(block.lengths)]
        for i in range(block.n_rows):
            some = slice(starts[i], starts[i + 1])
            found[i] = block.values[some] @ directions[block.indices[some] & (ROWS - 1)]
    return (found / shape.width + offsets).reshape(-1, shape.tables, shape.functions)


def keys(steps: np.ndarray) -> np.ndarray:
    """One number for the whole steps along the last axis; unlike ones may rarely share it."""
    mixed = np.zeros(steps.shape[:-1], dtype=np.uint64)
    for f in range(steps.shape[-1]):
        mixed = (mixed ^ steps[..., f].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def probes(at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables and keys of the ``most`` buckets nearest to one vector, the nearest first.

    A bucket is reached by steps across some of the boundaries around the vector, and its
    cost is the sum of the squares of the ways there.  Sets of steps come from a queue that all
    tables share: a set is followed by those with its last step replaced by the next dearer
    one, or with that one added.
    """
    tables, functions = at.shape
    home = np.floor(at).astype(np.int64)
    gaps = np.concatenate([at - home, 1 - (at - home)], axis=1) ** 2
    order = np.argsort(gaps, axis=1, kind="stable")
    costs = np.take_along_axis(gaps, order, axis=1).tolist()
    steps = order.tolist()
    queue = [(0.0, t, ()) for t in range(tables)]
    found_tables: list[int] = []
    found_steps: list[np.ndarray] = []
    while queue and len(found_tables) < most:
        cost, t, chosen = heapq.heappop(queue)
        functions_of = [steps[t][c] % functions for c in chosen]
        if len(set(functions_of)) == len(chosen):
            moved = home[t].copy()
            for c in chosen:
                moved[steps[t][c] % functions] += -1 if steps[t][c] < functions else 1
            found_tables.append(t)
            found_steps.append(moved)
        last = chosen[-1] if chosen else -1
        if last + 1 < 2 * functions:
            dearer = costs[t][last + 1]
            heapq.heappush(queue, (cost + dearer, t, (*chosen, last + 1)))
            if chosen:
                heapq.heappush(queue, (cost + dearer - costs[t][last], t, (*chosen[:-1], last + 1)))
    return np.array(found_tables, dtype=np.int32), keys(np.array(found_steps))
