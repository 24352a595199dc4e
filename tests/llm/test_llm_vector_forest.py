"""The forest against brute force: recall, exact scores, ties, hot copies and odd rows."""

import numpy as np
import pytest

from placerank.llm import vector_forest as vf

SCHEMA = "vec_id long, embedding array<double>, rank string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "r", 0) for i, v in rows], SCHEMA).repartition(3)


def exact(rows, asked, k):
    """(query, vec) in order with distances, by looking at all rows."""
    out = {}
    for q, v in asked:
        best = {}
        for i, w in rows:
            if i != q and len(w) == len(v):
                d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                best[i] = min(best.get(i, d), d)
        for i, d in best.items():
            out.setdefault(q, {})[i] = min(out.get(q, {}).get(i, d), d)
    return {q: sorted((d, i) for i, d in found.items())[:k] for q, found in out.items()}


def ours(spark, rows, asked, k=10, **options):
    built = {n: options.pop(n) for n in ("bin_rows", "leaf_sample", "sample_rows", "trees") if n in options}
    df = frame(spark, rows)
    index = vf.build_index(df, **built)
    out = {}
    found = vf.nearest_vectors(df, frame(spark, asked), k, index=index, **options)
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_recall_of_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    asked = [r for r in rows if r[0] % 100 == 0]
    expected = exact(rows, asked, 10)
    found = {}
    for r in vf.nearest_vectors(df, df.where("vec_id % 100 = 0")).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    true = [(q, i, d) for q, best in expected.items() for d, i in best]
    met = [found[q][i] == pytest.approx(d, abs=1e-12) for q, i, d in true if i in found[q]]
    assert all(met) and len(met) / len(true) >= 0.9
    assert all(len(best) == 10 for best in found.values())


def test_everything_searched_is_exact(spark):
    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=4).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 1.0]) for i in range(120)]  # copies: one hot leaf, over several bins
    rows += [(7, [9.0, 9.0, 9.0, 9.0]), (0, rows[0][1])]  # repeated keys
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    got = ours(spark, rows, asked, target=1.0, bin_rows=32, leaf_sample=8, trees=3)
    expected = exact(rows, asked, 10)
    assert {q: [i for _, i in best] for q, best in got.items()} == {q: [i for _, i in best] for q, best in expected.items()}
    assert all(a[0] == pytest.approx(b[0], abs=1e-12) for q in got for a, b in zip(got[q], expected[q]))


def test_few_rows_and_other_lengths_find_all_there_are(spark):
    random = np.random.default_rng(6)
    rows = [(i, random.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [1.0 + i, 2.0]) for i in range(5)]
    asked = [rows[0], rows[100], rows[200]]
    got = ours(spark, rows, asked, leaf_sample=4, bin_rows=16, target=0.5)
    assert got[200] == [(1.0, 201), (2.0, 202), (3.0, 203), (4.0, 204)]
    assert len(got[0]) == len(got[100]) == 10
    assert [i for _, i in ours(spark, rows[:3], rows[:1])[0]] == [i for _, i in exact(rows[:3], rows[:1], 10)[0]]


def test_unusable_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0])]
    assert ours(spark, bad, bad) == {}
    assert ours(spark, [], []) == {}
    good = [(8, [1.0, 0.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0])]
    assert ours(spark, bad + good, bad + good[:1]) == {8: [(0.0, 10), (pytest.approx(2**0.5), 9)]}


def test_walk_goes_by_distance_to_the_planes():
    random = np.random.default_rng(7)
    points = random.normal(size=(500, 3))
    forest = vf.Forest([vf.Tree.fit(points, 20, random) for _ in range(3)], 3)
    routed = forest.route(points)
    counts = np.bincount(routed.ravel(), minlength=forest.starts()[-1])
    assert counts.sum() == 1500 and all(t.leaves > 20 for t in forest.trees)
    asked = points[:20] + 1e-3  # off the planes, which go through points
    routed = forest.route(asked)
    for i, met in enumerate(forest.visits(asked, counts, float("inf"))):
        assert sorted(met) == list(range(len(counts)))  # every leaf once
        assert set(met[:3]) == set(routed[i])  # its own leaves first, at distance 0


def test_budget_grows_with_the_target(spark):
    random = np.random.default_rng(8)
    df = frame(spark, [(i, random.normal(size=16).tolist()) for i in range(800)])
    index = vf.build_index(df, leaf_sample=16)
    asked = vf.usable_vectors(df.where("vec_id % 20 = 0"), "vec_id", "embedding")
    budgets = [vf.measured_budget(index, asked, 5, target, 40) for target in (0.5, 0.9, 1.0)]
    assert 0 < budgets[0] < budgets[1] < budgets[2] == float("inf")
