"""The multi-probe index: order of buckets, recall and share of pairs, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from placerank.functions.nearest_kernel import Block
from placerank.functions.probe_kernel import Projections, keys, places, probes
from placerank.operators import neighbours, probing

SCHEMA = "property_id bigint, addr_cc string, features_norm array<double>"


def test_buckets_come_by_their_distance():
    rng = np.random.default_rng(1)
    at = rng.uniform(-3, 3, size=(3, 4))
    tables, found = probes(at, 3 * 3**4)
    cost = {}
    for t in range(3):
        home = np.floor(at[t])
        for moves in itertools.product((-1, 0, 1), repeat=4):
            gaps = [(f - h) if m < 0 else (h + 1 - f) if m > 0 else 0 for m, f, h in zip(moves, at[t], home)]
            cost[t, int(keys((home + moves).astype(np.int64)))] = sum(g * g for g in gaps)
    assert len(set(zip(tables.tolist(), found.tolist()))) == len(found) == len(cost) == 243
    got = [cost[key] for key in zip(tables.tolist(), found.tolist())]
    assert got == pytest.approx(sorted(cost.values()))
    assert len(probes(at, 10)[0]) == 10 and set(probes(at, 3)[0]) == {0, 1, 2}  # own buckets first


def test_sparse_and_dense_vectors_share_buckets():
    shape = Projections(3, 2, 0.5, 7)
    dense = np.array([[0.0, 2.0, 0.0, -1.0], [1.0, 0.0, 0.0, 0.0]])
    a = places(Block(dense.ravel(), np.array([4, 4]), None), shape)
    b = places(Block(np.array([2.0, -1.0, 1.0]), np.array([2, 1]), np.array([1, 3, 0])), shape)
    assert np.allclose(a, b)


def clustered(n=1500, dim=24, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, "FR" if i % 3 else "DE", x[i].tolist()) for i in range(n)]


def test_recall_from_a_small_share_of_pairs(spark):
    df = spark.createDataFrame(clustered(), SCHEMA).repartition(4)
    requests = neighbours.every_country(df.select("property_id").where("property_id % 10 = 0"), ["FR", "DE"])
    index = probing.build_probe_index(df, width=0.5)
    looked_at = probing.measured_probes(index, requests, 8, 0.95)
    pairs = probing.probed_pairs(index, requests, looked_at)
    ids = ["src_property_id", "neighbor_property_id", "target_cc"]
    exact = neighbours.nearest_neighbours(df, requests, 8)
    found = neighbours.nearest_of_pairs(index.vectors, pairs, 8)
    both = exact.join(found.withColumnRenamed("l2_dist", "again"), ids)
    n, n_exact = both.count(), exact.count()
    assert n >= 0.9 * n_exact and both.where("abs(l2_dist - again) > 1e-6").count() == 0
    assert pairs.count() < 0.2 * 150 * 1500
    assert pairs.count() == pairs.distinct().count()


def test_unreachable_recall_is_answered_exactly(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 32))
    df = spark.createDataFrame([(i, "FR", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    requests = neighbours.every_country(df.select("property_id").where("property_id < 5"), ["FR"])
    index = probing.build_probe_index(df, width=0.001, tables=2, functions=6)
    assert probing.measured_probes(index, requests, 5, 0.95) is None
    rows = {tuple(r) for r in probing.probe_neighbours(index, requests, 5).collect()}
    assert rows == {tuple(r) for r in neighbours.nearest_neighbours(df, requests, 5).collect()}


def test_unknown_and_empty(spark):
    rows = [(1, "FR", [1.0, 0.0]), (2, "FR", [0.9, 0.1]), (3, "FR", None), (4, None, [1.0, 0.0]), (5, "DE", [0.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(1, "FR"), (1, "FR"), (1, "XX"), (99, "FR"), (3, "FR"), (None, "FR")], "property_id bigint, target_cc string")
    index = probing.build_probe_index(df, width=5.0, tables=2, functions=1)
    found = probing.probe_neighbours(index, asked, 5, looked_at=6).select("src_property_id", "neighbor_property_id").collect()
    assert [tuple(r) for r in found] == [(1, 2)]
    assert probing.probe_neighbours(index, asked.limit(0), 5).count() == 0
    nothing = probing.build_probe_index(df.where(F.lit(False)), width=1.0)
    assert probing.probe_neighbours(nothing, asked, 5).count() == 0
