"""Quality rules with thresholds that follow each language and source.

A quantile sketch is a count of values by their six leading binary digits.  Sketches
of any parts of the data merge by adding counts, in any order, with the same result,
and a quantile is off by less than one part in 32.  Every language and source has a
sketch of each measure; small groups use the merged sketch of their language, small
languages that of all.  A document fails if a measure lies far outside the middle
half of its group: more than ``fence`` times the group's spread beyond a quartile,
where the spread counts as at least the measure's least one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerank.llm.common import Texts, column, map_texts, others
from placerank.sources.scratch import written

REPEAT_WINDOW = 8
_DIGITS = 6
_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Measure:
    """A number per document in thousandths; ``least`` bounds its spread from below."""

    name: str
    over: str
    per: str
    least: int
    low: bool = False


MEASURES = (
    Measure("word_length", "word_chars", "n_words", least=750, low=True),
    Measure("symbols", "n_symbols", "n_words", least=50),
    Measure("duplicate_lines", "n_dup_lines", "n_lines", least=100),
    Measure("repeated_words", "n_repeat_words", "n_words", least=75),
)


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Words become numbers; numbers of neighbouring runs of 1, 2 and 4 words pair up to
    numbers of runs twice as long, so equal numbers are equal windows.
    """
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    runs = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    step = 1
    while step < width:
        pairs = runs[:-step] * (int(runs.max()) + 1) + runs[step:]
        _, runs, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(runs):
            return 0
        step *= 2
    starts = np.flatnonzero(counts[runs] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def count_text(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``."""
    text = text or b""
    words = text.split()
    bare = text.translate(None, _BLANKS)
    chars = len(bare) - len(bare.translate(None, bytes(b for b in range(256) if b & 0xC0 == 0x80)))
    symbols = len(bare) - len(bare.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    return (
        len(words), len(bare) - chars, symbols, len(lines), len(lines) - len(set(lines)),
        repeated_words(words),
    )


COUNTS = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    ]
)


def count_documents(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def factory():
        def work(texts: Texts):
            return np.array([count_text(t) for t in texts], dtype=np.int64).T

        return work

    return map_texts(docs, text, keep, COUNTS, factory)


def _leading(value: Column) -> Column:
    """The value with all but its leading binary digits set to 0."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - _DIGITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _thousandths(m: Measure) -> Column:
    return F.expr(f"1000 * {m.over} div greatest({m.per}, 1)")


def sketches(counted: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``measure``, ``value`` and ``n``: one sketch per group and measure.

    Rows are aggregated before the shuffle; a sketch has at most 32 values per power
    of two, so the table grows with the groups and not with the documents.
    """
    measures = F.explode(
        F.array(
            *[F.struct(F.lit(m.name).alias("measure"), _leading(_thousandths(m)).alias("value")) for m in MEASURES]
        )
    )
    return (
        counted.select("lang", "source", measures.alias("m"))
        .groupBy("lang", "source", "m.measure", "m.value")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Documents and quartiles of the sketches merged within ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    passed = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select(
        *keys, "measure", "value", F.sum("n").over(passed).alias("upto"), F.sum("n").over(group).alias("total")
    )

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("value")))

    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("documents"), at(0.25).alias("q1"), at(0.75).alias("q3")
    )


def thresholds(sketch: DataFrame, fence: int, least_documents: int) -> DataFrame:
    """``low`` and ``high`` of every measure, one row per language and source."""
    own = _quartiles(sketch, "lang", "source").alias("own")
    lang = _quartiles(sketch, "lang").alias("lang")
    every = _quartiles(sketch).alias("every")
    joined = own.join(
        lang, F.col("own.lang").eqNullSafe(F.col("lang.lang")) & (F.col("own.measure") == F.col("lang.measure"))
    ).join(every, F.col("own.measure") == F.col("every.measure"))

    def chosen(name: str) -> Column:
        return (
            F.when(F.col("own.documents") >= least_documents, F.col(f"own.{name}"))
            .when(F.col("lang.documents") >= least_documents, F.col(f"lang.{name}"))
            .otherwise(F.col(f"every.{name}"))
        )

    picked = joined.select("own.lang", "own.source", "own.measure", chosen("q1").alias("q1"), chosen("q3").alias("q3"))
    bounds = []
    for m in MEASURES:
        spread = fence * F.greatest(F.col("q3") - F.col("q1"), F.lit(m.least))
        mine = F.col("measure") == m.name
        bounds.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"{m.name}_high"))
        if m.low:
            bounds.append(F.max(F.when(mine, F.col("q1") - spread)).alias(f"{m.name}_low"))
    return picked.groupBy("lang", "source").agg(*bounds)


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    fence: int = 4,
    least_documents: int = 100,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with their counts, ``base_failed``, ``kept`` and the measure that failed.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated
    windows.  ``kept`` is false for these, and else says whether all measures lie
    within the thresholds of the document's language and source, which are learned
    from all documents that pass the base rule.  Runs jobs: counts and sketches are
    written to the shared folder.

    Null text counts as empty and fails.  A null language or source is a group like any
    other.  Repeated rows count as often as they occur and are judged alike.  Columns
    of the input with a result's name are replaced.
    """
    results = [*COUNTS.fieldNames(), "base_failed", "kept", "failed_measures"]
    kept = [c for c in others(docs, *results) if keep is None or c in keep]
    row = F.struct(*[column(c) for c in kept]).alias("row")
    asked = docs.select(
        row, column(lang).alias("lang"), column(source).alias("source"), column(text).alias("text")
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = written(
        count_documents(asked, "text", ["row", "lang", "source"]).withColumn("base_failed", base), "counts"
    )
    sketch = written(sketches(counted.where(~F.col("base_failed"))), "sketch")
    bounds = written(thresholds(sketch, fence, least_documents), "bounds")
    failed = []
    for m in MEASURES:
        value = _thousandths(m)
        outside = value > F.col(f"{m.name}_high")
        if m.low:
            outside |= value < F.col(f"{m.name}_low")
        failed.append(F.when(~F.col("base_failed") & outside, F.lit(m.name)))
    judged = counted.alias("c").join(
        bounds.alias("b"),
        F.col("c.lang").eqNullSafe(F.col("b.lang")) & F.col("c.source").eqNullSafe(F.col("b.source")),
        "left",
    )
    return judged.select(
        *[F.col("row")[c].alias(c) for c in kept],
        *COUNTS.fieldNames(),
        "base_failed",
        (~F.col("base_failed") & (F.size(F.array_compact(F.array(*failed))) == 0)).alias("kept"),
        F.array_compact(F.array(*failed)).alias("failed_measures"),
    )
