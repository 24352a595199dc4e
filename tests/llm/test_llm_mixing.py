"""Targets against the stepwise rule, and what rounding must keep."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from placerank.llm import mixing
from placerank.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, size string"


def stepwise_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Share the rest by weight, stop what is above, and share again until none is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped: dict = {}
    while True:
        rest = share * sum(sizes.values()) - sum(stopped.values())
        total = sum(weight[s] for s in order if s not in stopped)
        level = {s: rest * weight[s] / total for s in order if s not in stopped}
        above = [s for s in level if level[s] > most * sizes[s]]
        if not above:
            return stopped | level
        stopped |= {s: most * sizes[s] for s in above}


def test_targets_and_words_of_the_query(spark):
    rows = QUERIES["op4_mix_sources"](spark, FOLDER).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 1000
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(stepwise_targets(sizes)[r.source])
        assert abs(taken[r.source] - r.target) <= largest[r.source]


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    once = mixing.mix_sources(docs, keep=["doc_id"], block=4).orderBy("doc_id").collect()
    again = mixing.mix_sources(docs.repartition(13), keep=["doc_id"], block=4)
    assert once == again.orderBy("doc_id").collect()


def test_fractions_keep_their_expectation(spark):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', 1 + int(id % 7))").alias("text"),
        F.when(F.col("id") < 40, "a").otherwise("b").alias("source"),
    )
    means = defaultdict(float)
    for seed in range(8):
        for r in mixing.mix_sources(docs, keep=["doc_id"], block=8, seed=seed, share=0.8).collect():
            means[r.doc_id] += r.copies / 8
    rates = {
        r.doc_id: r.target / r.source_size
        for r in mixing.mix_sources(docs, keep=["doc_id"], share=0.8).collect()
    }
    for low, high in ((0, 40), (40, 60)):
        mean = sum(means[i] for i in range(low, high)) / (high - low)
        assert mean == pytest.approx(rates[low], abs=0.05)


def test_odd_rows(spark):
    rows = [
        (1, None, "a", "x"), (2, "", "a", "x"), (None, "one two", None, None), (4, "w " * 50_000, "a", "x"),
        (5, "same", "a", "x"), (5, "same", "a", "x"), (6, "a b c", "", "x"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies"]
    found = mixed.collect()
    assert len(found) == 7
    assert {(r.doc_id, r.size, r.copies) for r in found if r.size == 0} == {(1, 0, 0), (2, 0, 0)}
    assert next(r.size for r in found if r.doc_id == 6) == 2
    repeated = mixing.repeat_copies(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in found)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_repeats_keep_every_column(spark):
    """Columns named like a result of the mix keep their values in the rows that it takes."""
    rows = [(i, "word " * (i % 7 + 1), "ab"[i % 2], 777 + i, -1.5, "t", 9, "r", "k", 3) for i in range(60)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, source string, size long, target double, source_size string, copies int, "
        "row string, key string, `a.copy` int"
    )
    wanted = {r.doc_id: r.copies for r in mixing.mix_sources(docs, keep=["doc_id"]).collect()}
    repeated = mixing.repeat_copies(docs)
    assert repeated.schema == docs.schema
    found = Counter(tuple(r) for r in repeated.collect())
    assert found == Counter({r: wanted[r[0]] for r in rows if wanted[r[0]]})
