"""Counts against a plain reading of their definition; thresholds against exact ones."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placerank.llm import quality as q
from placerank.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(hit))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\t"]), max_size=150).map(" ".join)))
def test_counts(text):
    assert q.count_text(text.encode()) == plain_counts(text)


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op1_quality_rules"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    counts = {r.doc_id: plain_counts(docs[r.doc_id].text) for r in rows}
    groups, langs = defaultdict(list), defaultdict(list)

    def measures(c):
        return {"word_length": 1000 * c[1] // max(c[0], 1), "symbols": 1000 * c[2] // max(c[0], 1),
                "duplicate_lines": 1000 * c[4] // max(c[3], 1), "repeated_words": 1000 * c[5] // max(c[0], 1)}

    def leading(v):
        shift = max(0, len(f"{v:b}") - 6)
        return v >> shift << shift

    failed = {i: c[0] < 20 or 100 * c[5] > 30 * c[0] for i, c in counts.items()}
    every = []
    for i, c in counts.items():
        if not failed[i]:
            for found in (groups[docs[i].lang, docs[i].source], langs[docs[i].lang], every):
                found.append(measures(c))
    for r in rows:
        c = counts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (c[0], c[1], c[2], c[4], c[5])
        assert r.base_failed == failed[r.doc_id]
        own, lang = groups[docs[r.doc_id].lang, docs[r.doc_id].source], langs[docs[r.doc_id].lang]
        group = own if len(own) >= 100 else lang if len(lang) >= 100 else every
        wrong = []
        for m in q.MEASURES:
            values = sorted(leading(x[m.name]) for x in group)
            q1, q3 = (values[int(np.ceil(p * len(values))) - 1] for p in (0.25, 0.75))
            spread, value = 4 * max(q3 - q1, m.least), measures(c)[m.name]
            if value > q3 + spread or (m.low and value < q1 - spread):
                wrong.append(m.name)
        assert r.kept == (not r.base_failed and not wrong)


def test_sketches_merge(spark):
    counted = spark.range(500).select(
        F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source"),
        *[(F.col("id") % (7 + i)).alias(c) for i, c in enumerate(q.COUNTS.fieldNames())],
    )
    whole = q._quartiles(q.sketches(counted))
    parts = q.sketches(counted.where("id < 100")).union(q.sketches(counted.where("id >= 100")))
    assert sorted(whole.collect()) == sorted(q._quartiles(parts).collect())


def test_odd_rows(spark):
    good = "plain words of some length that say nothing in particular but are many enough to pass here today again"
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, good, None, None), (4, "w " * 100_000, "en", None),
            (5, good, "en", "a"), (5, good, "en", "a"), (6, good.replace(" ", " ### "), "en", "a")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, KEPT int")
    found = q.judge(docs)
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_words"] and "KEPT" not in found.columns
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in found.collect()}
    assert got == {(1, 0, True, False), (2, 0, True, False), (None, 19, True, False), (4, 100_000, True, False),
                   (5, 19, True, False), (6, 37, False, True)}
    assert q.judge(docs.limit(0)).count() == 0
