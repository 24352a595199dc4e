"""States of batches, merged, against the profile of the whole."""

import random

import pytest

from placerank.operators import profile_state as ps
from placerank.operators import profiling
from placerank.sources.scratch import scratch_path

SCHEMA = "price double, guests int, title string, odd_name double, empty string"


def rows(n=300, seed=1):
    pick = random.Random(seed)
    return [
        (pick.choice([None, pick.uniform(1e9, 1e9 + 50)]), pick.randint(1, 9), pick.choice([None, "a", "bcd", ""]), float(i), None)
        for i in range(n)
    ]


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cuts", [[], [1], [100, 101, 250], [0, 300]])
def test_profile_after_append_equals_that_of_the_whole(spark, cuts):
    data = rows()
    path = scratch_path(spark, "states")
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        ps.append_profile(spark.createDataFrame(data[a:b], SCHEMA), path)
    state = ps.stored_profile(spark, path)
    whole = spark.createDataFrame(data, SCHEMA)
    assert as_rows(ps.missing_from_state(state).drop("distinct")) == as_rows(profiling.missing_values(whole))
    report = profiling.distribution_report(whole, exact=True).drop("outliers")
    got, expected = as_rows(ps.distribution_from_state(state)), as_rows(report)
    assert [r[0] for r in got] == [r[0] for r in expected] and len(got) == 4
    for a, b in zip(got, expected):
        assert a[1:] == pytest.approx(b[1:], abs=0.011)
    distinct = {r["column"]: r["distinct"] for r in ps.missing_from_state(state, show_all=True).collect()}
    assert distinct["guests"] == 9 and distinct["title"] == 3 and distinct["empty"] == 0
    assert abs(distinct["odd_name"] - 300) < 15


def test_states_merge_in_any_order(spark):
    data = rows(200, 2)
    parts = [ps.profile_state(spark.createDataFrame(data[i::4], SCHEMA)) for i in range(4)]
    ahead = ps.merged(parts[0].unionByName(parts[1])).unionByName(ps.merged(parts[2].unionByName(parts[3])))
    at_once = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    one, other = (as_rows(ps.distribution_from_state(ps.merged(s))) for s in (ahead, at_once))
    assert one == other


def test_no_rows(spark):
    state = ps.merged(ps.profile_state(spark.createDataFrame([], SCHEMA)))
    assert ps.distribution_from_state(state).count() == 0
    assert [r["present"] for r in ps.missing_from_state(state, show_all=True).collect()] == [0] * 5


def test_quartiles_are_exact_beyond_the_size_of_a_sketch(spark):
    df = spark.range(60_000).selectExpr("pmod(id * 7919, 60000) + 1.0d as v")
    path = scratch_path(spark, "states")
    for i in range(3):
        ps.append_profile(df.where(f"v % 3 = {i}"), path, accuracy=64)
    row = ps.distribution_from_state(ps.stored_profile(spark, path)).first()
    assert (row["non_null"], row["q25"], row["median"], row["q75"]) == (60_000, 15_000.0, 30_000.0, 45_000.0)


def test_sketches_answer_where_a_batch_has_no_counts(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    parts = [ps.profile_state(df.where(f"v % 2 = {i}"), values=bool(i)) for i in range(2)]
    row = ps.distribution_from_state(ps.merged(parts[0].unionByName(parts[1]))).first()
    assert (row["q25"], row["median"], row["q75"]) == (24.0, 49.0, 74.0)
