"""Kneser-Ney probabilities by brute force, held-out accuracy, rejection, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from placerank.llm import language as la
from placerank.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_probabilities_sum_to_one():
    grams, _ = la.sequences([b"the cat sat on the mat", b"a bat and a hat"])
    model = la.Model.fit(*(x.astype(t) for x, t in zip(np.unique(grams, return_counts=True), (np.uint64, float))))
    letters = [int(k) for k in model.grams[0][0]]
    for context in ("the", " ca", "zzz", "at "):
        base = np.uint64(0)
        for c in context:
            base = np.uint64((int(base) << 16) | ord(c))
        asked = np.array([(int(base) << 16) | x for x in letters], dtype=np.uint64)
        total = np.exp(model.log_p(asked)).sum()
        assert 0.85 < total < 1.0 + 1e-6  # the rest is for letters never seen


def test_counts_of_short_continuations_are_of_distinct_sequences():
    grams, _ = la.sequences([b"aaaa aaaa aaaa ab"])
    keys, n = np.unique(grams, return_counts=True)
    model = la.Model.fit(keys, n.astype(float))
    types = {tuple((int(k) >> (16 * i)) & 0xFFFF for i in (3, 2, 1, 0)) for k in keys}
    triples = Counter(t[1:] for t in types)
    assert dict(zip(map(int, model.grams[2][0]), [1] * len(model.grams[2][0]))).keys() == {
        (a << 32) | (b << 16) | c for a, b, c in triples
    }


def test_letters():
    assert "".join(map(chr, la.letters_of("  Äb1c\n\nÉ!! ".encode()))) == "äb c é"
    grams, sizes = la.sequences([b"ab", None, b"1", b"c"])
    assert sizes.tolist() == [3, 0, 0, 2] and len(grams) == 5


def test_tables_of_letters_are_small():
    assert sum(table.nbytes for table in la._letters()) < 4_000_000
    assert la.letters_of("\U00010400 \uffdc".encode()).dtype == np.uint64


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op6_language"](spark, FOLDER).collect()
    assert len(rows) == len(labels)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    asked = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == labels[r.doc_id].lang for r in asked)
    assert right >= 0.99 * len(asked)
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows)


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(i, f"the {w} is in the house and the {w} was here", "en") for i, w in enumerate(["dog", "cat"] * 20)]
    rows += [(i + 100, f"der {w} ist in dem haus und war hier nicht", "de") for i, w in enumerate(["hund", "tag"] * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_rejection_and_odd_rows(spark, taught):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (None, "the house"), (5, "qxzjkv " * 40),
            (6, "the cat was here " * 9_000), (6, "the cat was here " * 9_000), (7, "x")]
    asked = spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, Score string")
    model = la.learn(taught)
    found = la.identify(asked, model).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 8 and found[0].__fields__ == ["doc_id", "text", "lang_pred", "score", "cross_entropy", "rejected"]
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected for i in (1, 2, 3))
    assert by_id[None].lang_pred == "en" and by_id[6].lang_pred == "en" and not by_id[6].rejected
    assert by_id[5].rejected and by_id[5].lang_pred in ("en", "de")
    extra = taught.selectExpr("*", "lang AS rejected")
    assert la.keep_identified(extra).columns == extra.columns
    assert la.keep_identified(extra).count() == 80
    assert la.identify(asked.limit(0), model).count() == 0
    nothing = la.learn(taught.limit(0))
    assert {r.lang_pred for r in la.identify(asked, nothing).collect()} == {"und"}


def test_letters_beyond_the_first_plane_and_marks():
    for letter in ("\U00020020", "\U00010020", "\U00010400", "\U0001d552"):
        found = la.letters_of(letter.encode())
        assert len(found) == 1 and found[0] != 32 and 0xE000 <= found[0] < 0xF900
    assert len(la.letters_of("\u0301\u0300 \u0302".encode())) == 0
    assert la.letters_of("e\u0301".encode()).tolist() == [0x65, 0x301]
    assert la.letters_of("\u0130 \u00c4".encode()).tolist() == [0x130, 32, 0xE4]
    assert (la.letters_of("\U00010400".encode()) == la.letters_of("\U00010428".encode())).all()


def test_model_keeps_every_sequence(spark):
    """Also beyond 200,000 of a language, some of them more frequent than others."""
    codes = np.random.default_rng(3).integers(0x4E00, 0x5E00, 210_000)
    text = "".join(map(chr, codes))
    docs = spark.createDataFrame([(1, text, "zh"), (2, "aaaa aaaa", "zh")], "doc_id long, text string, lang string")
    taught = docs.where(~la.held_out("doc_id"))
    assert taught.count() == 2
    grams, _ = la.sequences([text.encode(), b"aaaa aaaa"])
    assert len(la.learn(docs).models[0].grams[3][0]) == len(np.unique(grams)) > 200_000
