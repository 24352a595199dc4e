"""Clusters against a plain computation, and what dictionaries keep."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placerank.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


def plain(rows, k, rounds):
    """(vec_id, cluster, distance, centroid) of every row, with Python's whole numbers."""
    rows = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    keyed = [r for r in rows if r[0] is not None]
    start = sorted(keyed, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [
            [sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c
            for j, c in enumerate(centroids)
        ]
    return [(i, nearest(v)[1], nearest(v)[0], tuple(centroids[nearest(v)[1]])) for i, v in rows]


def ours(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    found = clusters.cluster_vectors(df, dimensions=6, **options).collect()
    return [(r["vec_id"], r["cluster"], r["distance"], tuple(r["centroid"])) for r in found], found


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("chunk_rows", [1, 7, 8192])
def test_equals_plain_computation(spark, chunk_rows):
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=6).round(2).tolist()) for i in range(90)]
    rows += [(100 + i, [0.5, -0.25, 0.0, 1.0, 2.0, -3.0]) for i in range(40)]  # copies
    rows += [(5, rows[5][1]), (6, [9.0] * 6), (None, [0.1] * 6)]  # repeated keys, a null one
    got, found = ours(spark, rows, k=4, rounds=3, chunk_rows=chunk_rows)
    assert ordered(got) == ordered(plain(rows, 4, 3))
    assert {r["inertia"] for r in found} == {sum(r[2] for r in got)}
    by_cluster = {}
    for r in got:
        by_cluster[r[1]] = by_cluster.get(r[1], 0) + r[2]
    assert all(by_cluster[r["cluster"]] == r["cluster_inertia"] for r in found)


def test_unusable_vectors_few_and_none(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0] * 5 + [None]), (5, [nan] * 6), (6, [inf] * 6), (7, [1e9] * 6)]
    assert ours(spark, bad)[0] == []
    assert ours(spark, [])[0] == []
    assert ours(spark, bad + [(8, [0.0] * 6)])[0] == [(8, 0, 0, (0,) * 6)]
    assert ours(spark, [(None, [0.0] * 6)])[0] == []


def test_large_numbers_are_exact(spark):
    rows = [(i, [100_000.0 + i] * 6) for i in range(5)] + [(9, [-100_000.0] * 6)]
    assert ordered(ours(spark, rows, k=2, rounds=2)[0]) == ordered(plain(rows, 2, 2))


def test_dictionaries_lose_nothing_and_widen():
    random = np.random.default_rng(2)
    few = random.integers(-9, 9, size=(5, 16))
    vectors = np.concatenate([few[random.integers(0, 5, 400)], random.integers(-999, 999, size=(3, 16))])
    blocks = clusters.encode(vectors)
    back = np.concatenate([b.entries[b.codes] for b in blocks], axis=1)
    assert (back == vectors).all() and {b.entries.shape[1] for b in blocks} == {8}
    single = clusters.encode(random.integers(-10**6, 10**6, size=(50, 16)))
    assert {b.entries.shape[1] for b in single} == {1}
    centroids = random.integers(-99, 99, size=(3, 16))
    expected = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (clusters.distances(blocks, centroids) == expected).all()


def test_chunks_are_bounded(spark):
    df = spark.range(1000).select("id", F.array(*[F.col("id") * 1.0] * 6).alias("v")).coalesce(1)
    chunks = clusters.dictionary_chunks(clusters.integer_vectors(df, "id", "v", 6, 1), 6, 64)
    assert [r["n"] for r in chunks.select(F.size("keys").alias("n")).collect()] == [64] * 15 + [40]
