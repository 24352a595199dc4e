"""Exact quantiles against numpy, on values that are hard to narrow down."""

import math
import re

import numpy as np
import pytest

from placerank.operators import evaluation
from placerank.operators.selection import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns():
    rng = np.random.default_rng(1)
    n = 1001
    return {
        "even": rng.normal(size=n).tolist()[:-1] + [None],
        "heavy.tail": [float(x) for x in np.exp(rng.normal(size=n) * 20)],
        "huge": [(-1) ** i * 10.0 ** (i % 308) for i in range(n)],
        "tied": [float(x) for x in rng.integers(0, 3, n)],
        "one": [7.0] * n,
        "tiny steps": [1.0 + i * 2.0**-52 for i in range(n)],
        "none": [None] * n,
        "odd": [float("nan") if i % 3 == 0 else float(i) for i in range(n)],
    }


@pytest.mark.parametrize("bins", [2, 64])
def test_equals_numpy(spark, bins):
    data = columns()
    schema = ", ".join(f"`{c}` double" for c in data)
    df = spark.createDataFrame(list(zip(*data.values())), schema).repartition(4)
    if bins == 2:
        df, data = df.select("even", "tied"), {c: data[c] for c in ("even", "tied")}
    got = exact_quantiles(df, list(data), SHARES, bins=bins)
    low = exact_quantiles(df, list(data), SHARES, interpolated=False, bins=bins)
    for c, values in data.items():
        kept = [v for v in values if v is not None and not math.isnan(v)]
        if not kept:
            assert got[c] == low[c] == [None] * len(SHARES)
            continue
        assert got[c] == pytest.approx(np.quantile(kept, SHARES).tolist(), rel=1e-12)
        assert low[c] == [sorted(kept)[max(math.ceil(len(kept) * q) - 1, 0)] for q in SHARES]


def test_whole_numbers_and_infinite_ones(spark):
    df = spark.createDataFrame([(i, float("inf") if i > 7 else 1.0 * i) for i in range(10)], "a int, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [4.5], "b": [4.5]}
    assert exact_quantiles(df.limit(0), ["a", "b"], [0.5]) == {"a": [None], "b": [None]}


def test_median_table_has_no_median_of_all(spark):
    rows = [(t, c, 0.1 * t + 0.01 * i) for t in range(4) for i, c in enumerate(["FR", "DE", "FR"])]
    results = spark.createDataFrame(rows, "target_id int, cand_cc string, cosine_similarity double")
    titles = spark.createDataFrame([(t, f"title {t}") for t in range(4)], "property_id int, listing_title string")
    table = evaluation.median_table(results, titles, ["FR", "DE", "XX"])
    last = table.collect()[-1]
    assert (last["target_id"], last["FR"], last["DE"], last["XX"]) == ("country_median", 0.16, 0.16, None)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[(median|percentile)", plan)
