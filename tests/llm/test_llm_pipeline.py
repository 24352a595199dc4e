"""Every stage against a brute-force version on its own input, and odd rows throughout."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from placerank.llm import decontamination as d
from placerank.llm import language as la
from placerank.llm.common import table
from placerank.sources.scratch import written
from test_llm_jaccard import brute_components
from test_llm_sharding import jump_one

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    model = la.learn(docs)
    rows = docs.collect()

    stage = dict(corpus_pipeline.STAGES)
    known = written(stage["language_id"](spark, docs, FOLDER), "a")
    rejected = model.predict([r.text.encode() for r in rows])[3]
    assert known.columns == columns
    assert sorted(known.collect()) == sorted(r for r, bad in zip(rows, rejected, strict=True) if not bad)

    single = written(stage["jaccard_join"](spark, known, FOLDER), "b")
    group = brute_components([(r.doc_id, r.text) for r in known.collect()])
    assert single.columns == columns
    assert sorted(single.collect()) == sorted(r for r in known.collect() if group[r.doc_id, r.text] == r.doc_id)

    clean = written(stage["decontamination"](spark, single, FOLDER), "c")
    windows = {w for r in table(spark, FOLDER, "benchmark").collect() for w in d.windows(d.words_of(r.text.encode()))}

    def dirty(text):
        words = d.words_of(text.encode())
        return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words)))

    assert clean.columns == columns
    assert sorted(clean.collect()) == sorted(r for r in single.collect() if not dirty(r.text))

    mixed = written(stage["mixing"](spark, clean, FOLDER), "d")
    assert mixed.columns == columns
    copies: dict = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    kept = {r.doc_id for r in clean.collect()}
    words = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    assert set(copies) <= kept and max(copies.values()) <= 2
    taken, whole = sum(words[i] * n for i, n in copies.items()), sum(words.values())
    assert abs(taken - 1.5 * whole) < 20 * max(words.values())

    shards = stage["sharding"](spark, mixed, FOLDER).collect()
    assert len(shards) == sum(copies.values())
    places = {(r.shard, r.slot) for r in shards}
    assert len(places) == len(shards) and all(0 <= r.shard < 40 for r in shards)
    by_shard: dict = {}
    for s, slot in places:
        by_shard.setdefault(s, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    once = {r.doc_id: r.shard for r in shards}
    assert all(once[r.doc_id] == r.shard for r in shards)
    assert jump_one(5, 40) in range(40) and np.unique([r.shard for r in shards]).size > 20


def test_odd_rows(spark):
    r = random.Random(3)
    prose = " ".join(r.choice(["the", "house", "is", "red", "and", "warm"]) + str(r.randrange(3)) for _ in range(90))
    extra = ["size", "target", "copies", "shard_rows", "row"]
    rows = [(i, f"{prose[:20 + 7 * i]} here", "en", ["a", "b", None][i % 3], 5, "x") for i in range(20)]
    rows += [(50, None, None, None, None, None), (51, "", "en", "a", 0, "x"), (None, "some text here", None, "b", 3, "x"),
             (60, "long words " * 20_000, "en", "a", 9, "x"), (60, "long words " * 20_000, "en", "a", 9, "x")]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    )
    docs = docs.select("*", *[F.lit(777).alias(c) for c in extra])
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, now, FOLDER), name)
            assert not empty or out.count() == 0
            if name == corpus_pipeline.STAGES[-1][0]:  # its results take the place of columns of their names
                assert set(docs.columns) <= set(out.columns)
                break
            assert out.columns == docs.columns
            now = out
            assert all(v == 777 for r in now.select(*extra).distinct().collect() for v in r)
        assert empty or now.count() > 10
