"""The pivot search against the plain one, and what it skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placerank.operators import neighbours, pivots

SCHEMA = "property_id bigint, addr_cc string, features_norm array<double>"


def clustered(n=1200, dim=12, centres=25, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + 40] = x[0]  # copies tie
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, "FR" if i % 3 else "DE", x[i].tolist()) for i in range(n)]


def as_set(df):
    return {tuple(r) for r in df.select("src_property_id", "neighbor_property_id", "target_cc", "l2_dist").collect()}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(clustered(), SCHEMA).repartition(4)


def test_exact_and_below_all_pairs(spark, frame):
    requests = neighbours.every_country(frame.select("property_id").where("property_id % 12 = 0"), ["FR", "DE", "XX"])
    best, met = pivots.pivot_blocks(frame, requests, 6, pivots=30)
    assert as_set(best) == as_set(neighbours.nearest_neighbours(frame, requests, 6))
    rows = {r["round"]: r["n"] for r in met.groupBy("round").agg(F.sum("rows").alias("n")).collect()}
    assert sum(rows.values()) == 100 * 1200  # every block of both countries is known for every source
    assert rows.get(1, 0) + rows.get(2, 0) < 0.25 * 100 * 1200


def test_large_blocks_in_parts(spark, frame, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 40)
    monkeypatch.setattr(pivots, "SOURCE_ROWS", 7)
    requests = neighbours.every_country(frame.select("property_id").where("property_id % 40 = 0"), ["FR"])
    got = pivots.pivot_neighbours(frame, requests, 9, pivots=3)
    assert as_set(got) == as_set(neighbours.nearest_neighbours(frame, requests, 9))


def test_fewer_candidates_than_wanted_and_unknown_ids(spark):
    rows = [(1, "FR", [1.0, 0.0]), (2, "FR", [0.6, 0.8]), (3, "FR", [0.0, 1.0]), (4, "FR", None), (5, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(1, "FR"), (1, "FR"), (1, "XX"), (99, "FR"), (None, "FR"), (4, "FR")], "property_id bigint, target_cc string")
    got = pivots.pivot_neighbours(df, asked, 5, pivots=2)
    assert [r[1] for r in sorted(as_set(got), key=lambda r: r[3])] == [2, 3]
    assert pivots.pivot_neighbours(df, asked.limit(0), 5).count() == 0


def test_sparse_vectors(spark, frame):
    sparse = frame.select(
        "property_id", "addr_cc",
        F.transform(F.sequence(F.lit(0), F.size("features_norm") - 1), lambda i: (i * 5).cast("bigint")).alias("indices"),
        "features_norm",
    )
    requests = neighbours.every_country(frame.select("property_id").where("property_id % 60 = 0"), ["DE"])
    got = pivots.pivot_neighbours(sparse, requests, 4, pivots=10)
    assert as_set(got) == as_set(neighbours.nearest_neighbours(frame, requests, 4))
