"""Benchmark decontamination by Wu-Manber search for many word sequences at once.

Every ten-word window of a benchmark item is a pattern.  Words take the place of
letters: a table gives for each block of two words how far the search may move on
because no pattern can end sooner, so most of a clean document is never looked at.
Where the shift is 0, patterns with that ending block wait in a bucket, divided by
their first block, and direct comparison decides.  Shorter items have a search of
their own, as the shortest pattern bounds the shift.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerank.llm.common import Texts, column, map_texts
from placerank.sources.scratch import written

WINDOW = 10
_BLOCK = 2
#: Lower case for A to Z, a blank for what is not part of a word, other bytes as they are.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)

Words = list[bytes]


def words_of(text: bytes | None) -> Words:
    return (text or b"").translate(_FOLD).split()


def windows(words: Words, width: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``width`` words; a shorter text is one run, an empty one none."""
    if words:
        for i in range(max(1, len(words) - width + 1)):
            yield tuple(words[i : i + width])


class WuManber:
    """Search for word sequences of one length of at least two words."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]], length: int):
        self.length = length
        self.furthest = length - _BLOCK + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            for end in range(_BLOCK, length + 1):
                block = pattern[end - _BLOCK : end]
                self.shift[block] = min(self.shift.get(block, self.furthest), length - end)
            self.buckets[pattern[-_BLOCK:]][pattern[:_BLOCK]].append(pattern)

    def occurrences(self, words: Words) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and pattern of every occurrence."""
        shift, furthest, length = self.shift.get, self.furthest, self.length
        end, n = length, len(words)
        while end <= n:
            block = (words[end - 2], words[end - 1])
            move = shift(block, furthest)
            if move:
                end += move
                continue
            start = end - length
            for pattern in self.buckets[block].get((words[start], words[start + 1]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, pattern
            end += 1


class Search:
    """Patterns of all lengths with the items they come from."""

    def __init__(self, items: Iterable[tuple[int, bytes | None]]):
        self.items: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for number, text in items:
            for pattern in windows(words_of(text)):
                self.items[pattern].add(number)
        by_length = defaultdict(list)
        for pattern in self.items:
            by_length[len(pattern)].append(pattern)
        self.single = {p[0]: p for p in by_length.pop(1, [])}
        self.searches = [WuManber(found, n) for n, found in sorted(by_length.items())]

    def hits(self, words: Words) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words that patterns cover, and the numbers of the items found."""
        spans, found = [], set()
        if self.single:
            for i, word in enumerate(words):
                if word in self.single:
                    spans.append((i, i + 1))
                    found |= self.items[self.single[word]]
        for search in self.searches:
            for start, pattern in search.occurrences(words):
                spans.append((start, start + search.length))
                found |= self.items[pattern]
        return spans, found


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


RESULTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def _blocks(benchmark: DataFrame, item: str, text: str, most_bytes: int) -> Iterator[list]:
    """Items in groups of at most ``most_bytes`` of text, a longer item alone."""
    rows = benchmark.select(
        column(item).cast("string").alias("item"), column(text).cast("binary").alias("text")
    ).where(F.col("text").isNotNull())
    group, size = [], 0
    for row in rows.toLocalIterator():
        if group and size + len(row.text) > most_bytes:
            yield group
            group, size = [], 0
        group.append((row.item, bytes(row.text)))
        size += len(row.text)
    yield group


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    most_bytes: int = 2_000_000,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` of words and the ``item_ids`` that occur.

    One pass over the documents searches for one group of items, of at most
    ``most_bytes`` of text (or one longer item), which is broadcast.  A usual
    benchmark is one group; each further group is searched in the result of the
    pass before, so a benchmark of any size is found whole.

    Null texts have no words.  An item without an id marks words but is not listed;
    repeated ids are one item.  Columns of the input with a result's name are replaced.
    """
    kept = docs.columns if keep is None else keep
    names = {f.name for f in RESULTS}
    kept = [c for c in kept if c.lower() not in names]
    found = docs.select(*[column(c) for c in dict.fromkeys([*kept, text])])
    spark = docs.sparkSession
    for number, group in enumerate(_blocks(benchmark, item, item_text, most_bytes)):
        if number:
            found = written(found, "searched")
        carried = [f for f in found.columns if f not in RESULTS.fieldNames()]
        earlier = [F.col(f.name).alias(f"__{f.name}") for f in RESULTS] if number else []
        before = found.select(*[column(c) for c in carried], *earlier)
        shared = spark.sparkContext.broadcast(group)

        def factory(shared=shared):
            items = shared.value
            search = Search((i, t) for i, (_, t) in enumerate(items))

            def work(texts: Texts):
                counts, spans, ids = [], [], []
                for raw in texts:
                    words = words_of(raw)
                    hit, which = search.hits(words)
                    counts.append(len(words))
                    spans.append([list(s) for s in covered(hit)])
                    ids.append(sorted({items[i][0] for i in which} - {None}))
                return counts, spans, ids

            return work

        found = map_texts(before, text, before.columns, RESULTS, factory)
        if number:
            found = found.select(
                *[column(c) for c in carried],
                "n_words",
                F.concat("__hit_spans", "hit_spans").alias("hit_spans"),
                F.array_sort(F.array_union("__item_ids", "item_ids")).alias("item_ids"),
            )
    return found.select(*[column(c) for c in kept], *RESULTS.fieldNames())


def hit_words(spans: str = "hit_spans") -> Column:
    """Words inside any span; spans of several groups may overlap, so ends only move on."""
    counted = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["words"] + F.greatest(F.lit(0), x[1] - F.greatest(x[0], s["end"]))).alias("words"),
            F.greatest(s["end"], x[1]).alias("end"),
        ),
    )
    return counted["words"].cast("long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those in which a window of the benchmark occurs."""
    names = {f.lower() for f in RESULTS.fieldNames()}
    aside = {c: f"__kept_{c}" for c in docs.columns if c.lower() in names}
    found = find_benchmark(docs.withColumnsRenamed(aside), benchmark, **options)
    kept = found.where(F.size("hit_spans") == 0).drop(*RESULTS.fieldNames())
    return kept.withColumnsRenamed({new: old for old, new in aside.items()}).select(
        *[column(c) for c in docs.columns]
    )
