"""Wu-Manber search against comparison at every position, and odd rows."""

from hypothesis import given, settings
from hypothesis import strategies as st

from placerank.llm import decontamination as d

LETTERS = st.lists(st.sampled_from(["a", "b", "c"]), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(LETTERS, st.lists(LETTERS, max_size=4))
def test_search_finds_what_comparison_finds(text, items):
    words = d.words_of(text.encode())
    search = d.Search(enumerate(i.encode() for i in items))
    spans, found = search.hits(words)
    expected, which = set(), set()
    for number, item in enumerate(items):
        for pattern in d.windows(d.words_of(item.encode())):
            for i in range(len(words) - len(pattern) + 1):
                if tuple(words[i : i + len(pattern)]) == pattern:
                    expected |= set(range(i, i + len(pattern)))
                    which.add(number)
    assert {i for s in d.covered(spans) for i in range(*s)} == expected and found == which


def test_words():
    assert d.words_of("It's ÉTÉ, 3×Äb_c\x00d".encode()) == [
        w.encode() for w in ["it", "s", "ÉtÉ", "3×Äb", "c", "d"]
    ]


def test_odd_rows_and_groups_of_items(spark):
    long = "filler " * 40_000 + "one two three four five six seven eight nine ten eleven"
    rows = [(1, None), (2, ""), (None, "x one Two three four five six seven eight nine ten y"),
            (4, long), (4, long), (5, "alone"), (6, "nothing here")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, N_WORDS string")
    items = [(7, "one two three four five six seven eight nine ten eleven"), (7, "alone"), (10, "ALONE"),
             (None, "nothing"), (8, None), (9, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (2_000_000, 1):
        found = d.find_benchmark(docs, benchmark, keep=["doc_id", "N_WORDS"], most_bytes=most)
        assert found.columns == ["doc_id", "n_words", "hit_spans", "item_ids"]
        got = [(r.doc_id, r.n_words, r.n, r.item_ids) for r in
               found.select("*", d.hit_words().alias("n")).collect()]
        assert sorted(got, key=str) == sorted(
            [(1, 0, 0, []), (2, 0, 0, []), (None, 12, 10, ["7"]), (4, 40_011, 11, ["7"]),
             (4, 40_011, 11, ["7"]), (5, 1, 1, ["10", "7"]), (6, 2, 1, [])], key=str)
    assert {r.doc_id for r in d.drop_contaminated(docs, benchmark).collect()} == {1, 2}
    assert d.drop_contaminated(docs, benchmark.limit(0)).count() == 7
    assert d.find_benchmark(docs.limit(0), benchmark).count() == 0
