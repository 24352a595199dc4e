"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: a node sends vectors to a side by their
projection on a random direction, cut at the sample's median.  Every row is then routed to
one leaf of each tree.  A query walks all trees through one shared priority queue, always
following the open branch whose cutting planes it is nearest to, until the leaves it has
met hold enough rows.  Within the leaves met, distances are exact.

How many rows are enough is measured, not set: the neighbours of a bounded number of
queries are found by brute force over all rows, and the budget is the least one with which
the walk meets the wanted share of them.

Leaves are packed into bins of bounded size; a leaf that holds more rows, such as one with
many copies of a vector, is dealt over several bins.  A task keeps the rows of one bin and
reads the queries that come to it as a stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import batch_iterator, column, uniform
from placerank.sources.scratch import written

#: Rows the trees are fitted on, and queries the budget is measured with.
SAMPLE_ROWS = 16_384
ASKED = 128
#: Sampled rows of a leaf at most, and rows of a bin.
LEAF_SAMPLE = 32
BIN_ROWS = 4096
TREES = 6
#: Share of true neighbours that the measured budget must meet.
TARGET = 0.95
_SLACK = 1e-9


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` as a long and ``values``; unusable vectors and null keys are left out."""
    x = column(vector)

    def sound(v: Column) -> Column:
        return F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))

    usable = F.forall(x, sound) & F.exists(x, lambda v: v != 0)
    return df.where(usable & column(key).isNotNull()).select(
        column(key).cast("long").alias("key"), x.alias("values")
    )


def matrix(values: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers: shorter ones end in zeros, longer ones are cut."""
    lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    flat = np.asarray(pc.list_flatten(values), dtype=np.float64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fits = place < width
    out[np.repeat(np.arange(len(lengths)), lengths)[fits], place[fits]] = flat[fits]
    return out


# --- the trees -------------------------------------------------------------------------
@dataclass
class Tree:
    """Cutting planes; a child from 0 on is another plane, one below 0 the leaf ``~child``."""

    directions: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_rows: int, random: np.random.Generator) -> Tree:
        planes: list[tuple[np.ndarray, float]] = []
        children: list[list[int]] = []
        leaves = 0
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            left = right = rows[:0]
            if len(rows) > leaf_rows:
                direction = random.normal(size=sample.shape[1])
                direction /= np.linalg.norm(direction)
                at = sample[rows] @ direction
                offset = float(np.median(at))
                left, right = rows[at <= offset], rows[at > offset]
            if len(left) and len(right):
                here = len(planes)
                planes.append((direction, offset))
                children.append([0, 0])
                todo += [(right, here, 1), (left, here, 0)]
            else:
                here = ~leaves
                leaves += 1
            if parent >= 0:
                children[parent][side] = here
        return cls(
            np.array([p for p, _ in planes]).reshape(-1, sample.shape[1]),
            np.array([o for _, o in planes]), np.array(children, dtype=np.int64).reshape(-1, 2), leaves,
        )

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """Signed distances to all planes, vectors by planes."""
        return vectors @ self.directions.T - self.offsets

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector."""
        rows = np.arange(len(vectors))
        at = np.full(len(vectors), 0 if len(self.offsets) else -1)
        sides = self.margins(vectors) > 0
        while len(inner := rows[at >= 0]):
            at[inner] = self.children[at[inner], sides[inner, at[inner]].astype(np.int64)]
        return ~at


@dataclass
class Forest:
    trees: list[Tree]
    width: int

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors by trees: their leaves, numbered over all trees."""
        return np.stack([t.route(vectors) + s for t, s in zip(self.trees, self.starts())], axis=1)

    def starts(self) -> np.ndarray:
        return np.cumsum([0, *(t.leaves for t in self.trees)])

    def walk(self, margins: list[np.ndarray]) -> Iterator[int]:
        """All leaves, those first whose branches lie nearest to a query.

        ``margins`` are the query's for each tree.  An open branch waits in one queue for all
        trees, by the largest distance to a plane on whose other side the query is.
        """
        starts = self.starts().tolist()
        queue = [(0.0, t, 0 if len(tree.offsets) else -1) for t, tree in enumerate(self.trees)]
        while queue:
            far, t, node = heapq.heappop(queue)
            children, margin = self.trees[t].children, margins[t]
            while node >= 0:
                side = int(margin[node] > 0)
                away = max(far, abs(float(margin[node])))
                heapq.heappush(queue, (away, t, int(children[node][1 - side])))
                node = int(children[node][side])
            yield starts[t] + ~node

    def visits(self, vectors: np.ndarray, rows: np.ndarray, enough: float) -> Iterator[list[int]]:
        """Per query the leaves met until they hold ``enough`` rows together."""
        planes = [t.margins(vectors) for t in self.trees]
        for i in range(len(vectors)):
            met, total = [], 0
            for leaf in self.walk([p[i] for p in planes]):
                met.append(leaf)
                total += rows[leaf]
                if total >= enough:
                    break
            yield met


def fit_forest(
    vectors: DataFrame, trees: int, sample_rows: int, leaf_sample: int, seed: int
) -> Forest:
    """Trees over about ``sample_rows`` of ``vectors``, taken by a hash of their keys."""
    rows = vectors.count()
    share = sample_rows / max(rows, 1)
    sample = vectors.where(uniform(F.lit(seed), F.col("key")) < share).limit(2 * sample_rows)
    found = sample.select("values").toArrow().column(0).combine_chunks()
    lengths = pc.list_value_length(found)
    width = max(pc.max(lengths).as_py() or 0, 1)
    random = np.random.default_rng(seed)
    points = matrix(found, width)
    points = points[np.lexsort(points.T)]
    return Forest([Tree.fit(points, leaf_sample, random) for _ in range(trees)], width)


# --- the index -------------------------------------------------------------------------
@dataclass
class Index:
    """Routed rows (``key``, ``values``, ``leaves``), the forest, and rows of each leaf."""

    rows: DataFrame
    forest: Forest
    counts: np.ndarray
    bin_rows: int

    def bins(self) -> tuple[np.ndarray, np.ndarray]:
        """First bin and number of bins of each leaf: neighbouring small leaves share one."""
        first, many = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64)
        now, held = 0, 0
        for leaf, rows in enumerate(self.counts.tolist()):
            if rows > self.bin_rows:
                now += held > 0
                many[leaf] = -(-rows // self.bin_rows)
                first[leaf], now, held = now, now + many[leaf], 0
                continue
            if held + rows > self.bin_rows:
                now, held = now + 1, 0
            first[leaf] = now
            held += rows
        return first, many


def build_index(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    leaf_sample: int = LEAF_SAMPLE,
    bin_rows: int = BIN_ROWS,
    seed: int = 11,
) -> Index:
    """A forest and every usable row of ``df`` in a leaf of each of its trees, as a written table."""
    vectors = usable_vectors(df, key, vector)
    forest = fit_forest(vectors, trees, sample_rows, leaf_sample, seed)
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = sent.value.route(matrix(batch.column(1), sent.value.width))
            listed = pa.array(list(leaves.astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=["key", "values", "leaves"])

    kind = vectors.schema["values"].dataType.simpleString()
    rows = written(vectors.mapInArrow(run, f"key long, values {kind}, leaves array<int>"), "routed")
    counts = np.zeros(forest.starts()[-1], dtype=np.int64)
    for row in rows.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        counts[row["leaf"]] = row["count"]
    return Index(rows, forest, counts, bin_rows)


# --- exact distances -------------------------------------------------------------------
def _nearest_rows(
    queries: np.ndarray, q_ids: np.ndarray, q_lengths: np.ndarray,
    rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and distances: the ``k`` nearest and all that tie with them."""
    squared = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :] - 2 * queries @ rows.T
    squared[(q_ids[:, None] == ids[None, :]) | (q_lengths[:, None] != lengths[None, :])] = np.inf
    limit = np.full(len(queries), np.inf)
    if len(rows) > k:
        limit = np.partition(squared, k - 1, axis=1)[:, k - 1]
    size = (queries**2).sum(axis=1) + (rows**2).sum(axis=1).max(initial=0.0)
    q, r = np.nonzero((squared <= (limit + _SLACK * size)[:, None]) & np.isfinite(squared))
    gaps = queries[q] - rows[r]
    return q, r, np.sqrt((gaps * gaps).sum(axis=1))


def _best(q: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each query by distance and id, repeated ids once."""
    order = np.lexsort((dist, ids, q))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    order = order[np.lexsort((ids[order], dist[order], q[order]))]
    sorted_q = q[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q, side="left") < k]


_FOUND = "query_id long, vec_id long, score double"


def _found(query_ids: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())],
        names=["query_id", "vec_id", "score"],
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``rank`` from 1 by ``score`` and ``vec_id``, up to ``k``."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of few queries: these are sent to all rows, so their number must be bounded."""
    width, asked = 1, queries.select("key", "values").toArrow().combine_chunks()
    if asked.num_rows:
        width = max(pc.max(pc.list_value_length(asked.column(1))).as_py(), 1)
    values = asked.column(1).combine_chunks()
    sent = vectors.sparkSession.sparkContext.broadcast(
        (asked.column(0).to_numpy(), matrix(values, width), pc.list_value_length(values).to_numpy(zero_copy_only=False))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, at, q_lengths = sent.value
        for batch in batches if len(q_ids) else ():
            ids = batch.column(0).to_numpy()
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            q, r, dist = _nearest_rows(at, q_ids, q_lengths, matrix(batch.column(1), width), ids, lengths, k)
            keep = _best(q, ids[r], dist, k)
            yield _found(q_ids[q[keep]], ids[r[keep]], dist[keep])

    found = vectors.select("key", "values").mapInArrow(run, _FOUND)
    return _ranked(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k)


def measured_budget(index: Index, queries: DataFrame, k: int, target: float, asked: int) -> float:
    """Rows a walk must meet so that it meets ``target`` of the true neighbours.

    Measured on at most ``asked`` queries against all rows.  Without queries, or with a target
    of 1 or more, everything is searched.
    """
    few = written(queries.orderBy(F.xxhash64("key"), "values").limit(asked), "asked")
    true = brute_force(index.rows, few, k).select("query_id", F.col("vec_id").alias("key"))
    homes = index.rows.join(F.broadcast(true), "key").select("query_id", "leaves").collect()
    if not homes or target >= 1:
        return float("inf")
    found = few.select("key", "values").toArrow().combine_chunks()
    at = matrix(found.column(1).combine_chunks(), index.forest.width)
    walks = {}
    for query, met in zip(found.column(0).to_pylist(), index.forest.visits(at, index.counts, float("inf"))):
        held = np.zeros(len(index.counts))
        held[met] = np.cumsum(index.counts[met])
        walks[query] = held
    needed = np.sort([walks[row["query_id"]][row["leaves"]].min() for row in homes])
    return float(needed[min(int(np.ceil(target * len(needed))), len(needed)) - 1])


# --- search ----------------------------------------------------------------------------
def search(index: Index, queries: DataFrame, k: int, enough: float) -> DataFrame:
    """``query_id``, ``vec_id`` and ``score`` of the nearest rows in the leaves each query meets."""
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast((index.forest, index.counts, *index.bins()))
    kind = index.rows.schema["values"].dataType.simpleString()
    schema = f"bin long, asks boolean, key long, leaves array<int>, values {kind}"

    def out(batch: pa.RecordBatch, bins: list, at: list, leaves: list, asks: bool) -> pa.RecordBatch:
        picked = batch.take(pa.array(at, pa.int64()))
        listed = pa.array(leaves, pa.list_(pa.int32()))
        columns = [pa.array(bins, pa.int64()), pa.array([asks] * len(at), pa.bool_()), picked.column(0), listed]
        return pa.RecordBatch.from_arrays(
            [*columns, picked.column(1)], names=["bin", "asks", "key", "leaves", "values"]
        )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, first, many = sent.value
        for batch in batches:
            leaves = np.asarray(pc.list_flatten(batch.column(2))).reshape(batch.num_rows, -1)
            salt = batch.column(3).to_numpy()[:, None]
            bins = first[leaves] + salt % many[leaves]
            at = np.repeat(np.arange(batch.num_rows), leaves.shape[1])
            yield out(batch, bins.ravel(), at, list(leaves.reshape(-1, 1).astype(np.int32)), False)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, counts, first, many = sent.value
        for batch in batches:
            bins, at, leaves = [], [], []
            vectors = matrix(batch.column(1), forest.width)
            for i, met in enumerate(forest.visits(vectors, counts, enough)):
                wanted: dict[int, list[int]] = {}
                for leaf in met:
                    for b in range(first[leaf], first[leaf] + many[leaf]):
                        wanted.setdefault(b, []).append(leaf)
                bins += wanted.keys()
                leaves += wanted.values()
                at += [i] * len(wanted)
                if len(at) > 20_000:
                    yield out(batch, bins, at, leaves, True)
                    bins, at, leaves = [], [], []
            yield out(batch, bins, at, leaves, True)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bin_ = None
        for batch in batches:
            asks = np.asarray(batch.column(1))
            split = int(np.searchsorted(asks, True))
            if split:
                held.append(batch.slice(0, split))
            if split == batch.num_rows or not held:
                continue
            bin_ = bin_ or _Bin(held)
            some = batch.slice(split)
            for start in range(0, some.num_rows, 512):
                yield bin_.nearest(some.slice(start, 512), k)

    salt = F.pmod(F.xxhash64("key", "values"), F.lit(1 << 40)).alias("salt")
    every = index.rows.select("key", "values", "leaves", salt).mapInArrow(placed, schema)
    every = every.unionByName(queries.select("key", "values").mapInArrow(asking, schema))
    # Rows of a bin come before the queries that ask it.
    dealt = every.repartition("bin").sortWithinPartitions("bin", "asks")
    found = dealt.groupBy("bin").applyInArrow(batch_iterator(rerank), _FOUND)
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


class _Bin:
    """Rows of some leaves, kept while queries come by."""

    def __init__(self, held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        values = table.column("values").combine_chunks()
        leaf = np.asarray(pc.list_flatten(table.column("leaves")))
        order = np.argsort(leaf, kind="stable")
        self.lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False)[order]
        self.width = int(self.lengths.max())
        self.rows = matrix(values, self.width)[order]
        self.ids = table.column("key").to_numpy()[order]
        names, starts = np.unique(leaf[order], return_index=True)
        self.leaves = {n: slice(a, b) for n, a, b in zip(names.tolist(), starts, [*starts[1:], len(leaf)])}

    def nearest(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        values = asked.column(4)
        lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False)
        at, q_ids = matrix(values, self.width), asked.column(2).to_numpy()
        wanted: dict[int, list[int]] = {}
        for i, leaves in enumerate(asked.column(3).to_pylist()):
            for leaf in leaves:
                wanted.setdefault(leaf, []).append(i)
        parts = []
        for leaf, some in wanted.items():
            here = self.leaves.get(leaf)
            if here is None:
                continue
            some = np.array(some)
            q, r, dist = _nearest_rows(
                at[some], q_ids[some], lengths[some], self.rows[here], self.ids[here], self.lengths[here], k
            )
            parts.append((some[q], self.ids[here][r], dist))
        if not parts:
            return _found(*(np.zeros(0),) * 3)
        q, ids, dist = map(np.concatenate, zip(*parts))
        keep = _best(q, ids, dist, k)
        return _found(q_ids[q[keep]], ids[keep], dist[keep])


def nearest_vectors(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    target: float = TARGET,
    index: Index | None = None,
    asked: int = ASKED,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest rows found.

    ``queries`` has columns ``key`` and ``vector`` as ``df`` has; an ``index`` of ``df`` may be
    given.  ``score`` is the Euclidean distance in double precision; ties go to the smaller
    key.  Vectors that are null, empty, zero, or hold a null or non-finite component, and
    rows with a null key, take no part on either side.  Only vectors of one length are
    compared.  A query never finds rows with its own key.  Rows that repeat a key count as one
    candidate at its nearest, and as one query.  A query that has met fewer than ``k`` rows
    is searched again through all leaves, so it gets all candidates there are.  Empty tables
    give no rows.  Other columns are not read.
    """
    index = index or build_index(df, key, vector)
    asking = written(usable_vectors(queries, key, vector), "queries")
    enough = measured_budget(index, asking, k, target, asked)
    found = written(search(index, asking, k, enough), "found")
    held = found.groupBy("query_id").agg(F.count("*").alias("n")).withColumnRenamed("query_id", "key")
    sizes = index.rows.groupBy(F.size("values").alias("length")).agg(F.count("*").alias("rows"))
    short = (
        asking.withColumn("length", F.size("values"))
        .join(sizes, "length").join(held, "key", "left")
        .where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("rows") - 1))
        .select("key", "values")
    )
    if enough < float("inf") and not (short := written(short, "short")).isEmpty():
        again = search(index, short, k, float("inf"))
        kept = found.join(short.select(F.col("key").alias("query_id")), "query_id", "left_anti")
        found = kept.unionByName(again)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
