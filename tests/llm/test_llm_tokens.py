"""Counts against the tokenizer library, for whole texts and for every prefix."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placerank.llm import tokens
from placerank.llm.queries import QUERIES, VOCABULARY

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FOLDER = "/root/testdata/sf0.01"
PARTS = [
    "'", "r", "e", "s", "l", " ", "  ", "\n", "\t", "a", "é", "1", "<|endoftext|>", "<|", "!", "the",
    "\x1c", "\x85", "日本", "²", "ǅ", "́", "🙂", "'ll", "'re", "\r\n", "_", "\xa0",
]


def library_count(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=30)))
def test_every_prefix(text):
    counter = tokens.counter_of(VOCABULARY)
    expected = [library_count(text[:i]) for i in range(len(text) + 1)]
    assert counter.prefixes(text).tolist() == expected
    assert counter.count(text) == expected[-1]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op3_token_counts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library_count(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_prefix_tables_answer_budgets_and_odd_rows(spark):
    long = "word " * 30_000 + "x" * 3_000
    rows = [(1, None, 5), (2, "", 5), (None, "one two three", 5), (4, long, 5), (4, long, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = tokens.count_tokens(docs, VOCABULARY, prefixes=True)
    assert found.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit", "prefix_tokens"]
    asked = found.select(
        "doc_id", "n_tokens", "over_limit",
        tokens.tokens_before(F.lit(3)).alias("three"),
        tokens.fitting_prefix(F.lit(2)).alias("two"),
    ).collect()
    assert [tuple(r) for r in asked[:3]] == [
        (1, 0, False, None, 0), (2, 0, False, None, 0), (None, 3, False, 1, 7),
    ]
    assert asked[3] == asked[4] and asked[3].n_tokens == library_count(long) and asked[3].over_limit
    assert tokens.count_tokens(docs.limit(0), VOCABULARY).count() == 0
