"""Passages repeated across documents, by content-defined chunks.

A gear hash rolls over the bytes of a text: every byte shifts the hash and adds its own
number, so a value depends on the last 16 bytes alone.  Low values end a chunk.  An
insertion therefore moves chunk ends but changes none outside its neighbourhood, and
equal passages hold equal chunks wherever they stand.  Digests of pairs of neighbouring
chunks are counted over all documents.  A stretch of words that holds a pair no other
document has cannot be repeated itself; the stretches left are compared by digests of
their own, among all documents that have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import column, pieces, small_batches
from placerank.sources.scratch import written

MIN_WORDS = 50
_AVERAGE = 20
_LEAST = 8
_MOST = 1024
_WINDOW = 16
# Bytes before the end of a chunk on which it depends.
_LEAD = _WINDOW + _LEAST
# One number per byte value, drawn from a hash.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) & 0xFFFF for b in range(256)], dtype=np.uint16)


def _marks(data: np.ndarray) -> np.ndarray:
    """Ends of chunks that the bytes before them decide, ``_LEAD`` of them.

    Sums over 2, 4, 8 and 16 bytes are made by doubling.  A low value that follows
    another within a few bytes does not count.
    """
    rolled = _GEAR[data]
    step = 1
    while step < _WINDOW:
        rolled[step:] += rolled[:-step] << np.uint16(step)
        step *= 2
    low = rolled < (1 << 16) // _AVERAGE
    low[: _WINDOW - 1] = False
    places = np.flatnonzero(low)
    if len(places):
        places = places[np.diff(places, prepend=-_MOST) > _LEAST]
    return places + 1


def chunk_ends(data: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Ends of the chunks of a text's bytes, the last one at its end.

    A stretch without any is cut at fixed steps.
    """
    ends = np.unique(np.concatenate([_marks(data) if marks is None else marks, [len(data)]]))
    gaps = np.diff(ends, prepend=0)
    if (gaps > _MOST).any():
        starts = ends - gaps
        steps = [np.arange(a + _MOST, b, _MOST) for a, b in zip(starts, ends, strict=True) if b - a > _MOST]
        ends = np.unique(np.concatenate([ends, *steps]))
    return ends


class Line:
    """The words of a text joined by one blank, so that equal words are equal bytes."""

    def __init__(self, text: bytes):
        self.text = b" ".join(text.split())
        self.data = np.frombuffer(self.text, dtype=np.uint8)
        blanks = np.flatnonzero(self.data == ord(" "))
        some = [0] if len(self.data) else []
        #: First byte of every word and the byte after its last.
        self.starts = np.concatenate([some, blanks + 1]).astype(np.int64)
        self.ends = np.concatenate([blanks, [len(self.data)] if some else []]).astype(np.int64)

    def chunk_pairs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests of pairs of neighbouring chunks, and the first and last stretch that decides each.

        A stretch is ``least`` words from a word on.  It decides a pair if it covers the
        pair and the bytes before it on which its first end depends: then every
        text with the stretch has the pair.  Pairs that no stretch decides are left out.
        """
        none = np.zeros(0, dtype=np.int64)
        stretches = len(self.starts) - least + 1
        marks = _marks(self.data)
        ends = chunk_ends(self.data, marks)[:-1]
        if stretches < 1 or not len(marks):
            return none.astype(np.uint64), none, none
        ends = ends[ends >= marks[0]]
        begun, done = ends[:-2], ends[2:]
        origin = marks[np.searchsorted(marks, begun, side="right") - 1]
        last = np.searchsorted(self.starts, origin - _LEAD, side="right") - 1
        first = np.searchsorted(self.ends, done) - least + 1
        first, last = np.maximum(first, 0), np.minimum(last, stretches - 1)
        use = first <= last
        digests = [xxhash.xxh3_64_intdigest(self.text[a:b]) for a, b in zip(begun[use].tolist(), done[use].tolist(), strict=True)]
        return np.array(digests, dtype=np.uint64), first[use], last[use]

    def stretches(self, least: int, shared: np.ndarray) -> tuple[list[int], list[int]]:
        """First words and digests of all stretches without a pair that is not ``shared``."""
        count = len(self.starts) - least + 1
        if count < 1:
            return [], []
        digests, first, last = self.chunk_pairs(least)
        alone = ~np.isin(digests, shared)
        edges = np.zeros(count + 1, dtype=np.int64)
        np.add.at(edges, first[alone], 1)
        np.add.at(edges, last[alone] + 1, -1)
        at = np.flatnonzero(np.cumsum(edges)[:-1] == 0)
        begun, done = self.starts[at].tolist(), self.ends[at + least - 1].tolist()
        return at.tolist(), [xxhash.xxh3_64_intdigest(self.text[a:b]) for a, b in zip(begun, done, strict=True)]


def _signed(digests) -> pa.Array:
    return pa.array(np.array(digests, dtype=np.uint64).view(np.int64))


def _all_pairs(texts: DataFrame, least: int) -> DataFrame:
    """``doc_id``, ``part`` (a text's own digest) and ``digest`` of the pairs of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                found = [np.unique(Line(raw).chunk_pairs(least)[0]) for raw in piece.column(2).to_pylist()]
                sizes = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(piece.column(0).to_numpy(), sizes)),
                        pa.array(np.repeat(piece.column(1).to_numpy(), sizes)),
                        _signed(np.concatenate(found)),
                    ],
                    names=["doc_id", "part", "digest"],
                )

    return small_batches(texts).mapInArrow(run, "doc_id long, part long, digest long")


def _all_stretches(texts: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """``doc_id``, ``start`` and ``digest`` of every stretch that may be repeated."""
    asked = texts.join(shared, ["doc_id", "part"], "left").select("doc_id", "digests", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2, 1 << 17):
                ids, places, digests = [], [], []
                for doc, known, raw in zip(
                    piece.column(0).to_pylist(), piece.column(1), piece.column(2).to_pylist(), strict=True
                ):
                    known = known.values.to_numpy() if known.is_valid else np.zeros(0, np.int64)
                    at, found = Line(raw).stretches(least, known.view(np.uint64))
                    ids += [doc] * len(at)
                    places += at
                    digests += found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(places, pa.int32()), _signed(digests)],
                    names=["doc_id", "start", "digest"],
                )

    return small_batches(asked).mapInArrow(run, "doc_id long, start int, digest long")


def _held(df: DataFrame) -> DataFrame:
    """Rows whose digest several documents have, with the ``first`` and ``last`` of these."""
    same = Window.partitionBy("digest")
    return (
        df.withColumn("first", F.min("doc_id").over(same))
        .withColumn("last", F.max("doc_id").over(same))
        .where("first < last")
    )


def _decided(doc: int, spans: list[dict]) -> list[tuple[int, int, int, bool]]:
    """``start``, ``end``, other document and keeper of stretches of words that are decided alike.

    A word goes if a smaller document has any of the spans around it, and names the smallest
    of these; else it stays, and names one of the other documents.
    """
    spans = sorted(spans, key=lambda s: s["start"])
    out: list[tuple[int, int, int, bool]] = []
    k = 0
    while k < len(spans):
        start, end, stop = spans[k]["start"], spans[k]["end"], k + 1
        while stop < len(spans) and spans[stop]["start"] <= end:
            end = max(end, spans[stop]["end"])
            stop += 1
        # Smaller documents sort before larger ones, so the least number decides a word.
        least = np.full(end - start, np.iinfo(np.int64).max)
        for s in spans[k:stop]:
            part = least[s["start"] - start : s["end"] - start]
            np.minimum(part, s["low"], out=part)
        cuts = [0, *(np.flatnonzero(np.diff(least)) + 1).tolist(), end - start]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            low = int(least[x])
            out.append((start + x, start + y, low, low > doc))
        k = stop
    return out


def _stretches_decided(found: DataFrame, least: int) -> DataFrame:
    """Rows per document and stretch of words with one other document and one decision."""
    order = Window.partitionBy("doc_id").orderBy("start")
    new = F.coalesce(
        (F.col("start") > F.lag("start").over(order) + 1) | (F.col("low") != F.lag("low").over(order)), F.lit(True)
    )
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        found.withColumn("__new", new.cast("int"))
        .withColumn("__run", F.sum("__new").over(upto))
        .groupBy("doc_id", "__run")
        .agg(F.min("start").alias("start"), (F.max("start") + least).alias("end"), F.min("low").alias("low"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "end", "low")).alias("spans"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, *row)
                for doc, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for row in _decided(doc, spans)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "end", "low", "keeper"],
            )

    return small_batches(spans).mapInArrow(run, "doc_id long, start int, end int, low long, keeper boolean")


def repeated_passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = MIN_WORDS,
) -> DataFrame:
    """Passages of ``least`` words or more that occur in several documents, a row for each.

    ``doc_id``, ``start_word`` and ``end_word`` (exclusive), ``n_words``, ``other_doc_id``
    (one other document with it) and ``keeper``: whether no document with a smaller id
    has it, so that it stays when repeats are removed.  Where the documents that have a
    passage change within it, it is cut into several rows, which may be shorter than
    ``least``; a word for which documents differ goes if any smaller one has ``least`` words
    around it.  Documents without a repeated passage have no row.

    A word is in a row if and only if it lies in ``least`` words that another document has as
    well, whatever their blanks; words are compared by digests of 64 bits.  Every
    document with a stretch of words meets its digest, so no partner is left out, and a
    passage in a third of all documents costs a row per word and document and never a pair of
    documents.  A stretch with no chunk pair of its own is compared like those
    with shared ones, so chunks decide what is compared and never what is found.

    All places of a passage in a text are given.  Rows without id or
    text, and empty texts, take no part.  Repeated ids count as one
    document.  Empty input gives no rows.  Other columns are not read.  Runs jobs;
    intermediate tables go to the shared folder.
    """
    texts = docs.where(column(key).isNotNull() & column(text).isNotNull()).select(
        column(key).cast("long").alias("doc_id"), F.xxhash64(column(text)).alias("part"),
        column(text).cast("binary").alias("text"),
    )
    shared = written(
        _held(_all_pairs(texts, least)).groupBy("doc_id", "part").agg(F.collect_list("digest").alias("digests")),
        "shared",
    )
    found = _held(_all_stretches(texts, shared, least)).select(
        "doc_id", "start",
        F.when(F.col("first") < F.col("doc_id"), F.col("first")).otherwise(F.col("last")).alias("low"),
    )
    spans = _stretches_decided(found, least)
    return spans.select(
        "doc_id",
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("n_words"),
        F.col("low").alias("other_doc_id"),
        "keeper",
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages cut from all texts but the first document's.

    Words that remain are joined by one blank where a passage was cut; other texts are
    as they were.
    """
    cut = (
        repeated_passages(docs, key, text, **options)
        .where("NOT keeper")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("__cut"))
    )
    pattern = r"[^\x20\x09-\x0D]+"
    words = F.regexp_extract_all(column(text), F.lit(pattern), F.lit(0))
    left = F.filter(
        words, lambda w, i: ~F.exists("__cut", lambda c: (i >= c["start_word"]) & (i < c["end_word"]))
    )
    joined = docs.join(cut, column(key) == F.col("__id"), "left")
    shorter = F.when(F.col("__cut").isNotNull(), F.array_join(left, " ")).otherwise(column(text))
    return joined.select(*[shorter.alias(c) if c == text else column(c) for c in docs.columns])
