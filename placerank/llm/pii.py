"""Personal data: fixed patterns, and contexts learned from what they find.

Fixed patterns give the base spans.  Their surroundings, the two words before and the
words on both sides, are lexical patterns.  Base finds are seeds of a graph of
patterns and instances that Spark scores in turns: a pattern is trusted for a kind if
nearly all of its distinct instances are known to be of that kind, and an instance
that trusted patterns surround becomes known.  Identifiers in trusted contexts that no
fixed pattern matches are added as spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerank.llm.common import Texts, column, map_texts, others
from placerank.sources.scratch import written

KINDS = ("email", "ip", "card", "phone")

# The agreed patterns.  Those of addresses are written so that long runs without an
# end take linear time: a run is entered at its start only.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SIGN = re.compile(r"[0-9@]")
_BREAK = " \t\n\x0b\x0c\r"
_EDGE = ".,;:!?()[]{}<>\"'"
_CONTEXT = 80


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        if found:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost spans of each kind that hold, by start and then kind as listed."""
    out = [("email", *span) for span in _emails(text)]
    if _SIGN.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the two words before, and the words on both sides."""

    def plain(words: list[str]) -> list[str]:
        return [re.sub(r"[0-9]+", "0", w.lower()) for w in words]

    before = plain(text[max(0, start - _CONTEXT) : start].split()[-2:])
    after = plain(text[end : end + _CONTEXT].split()[:1]) or ["$"]
    found = [f"{before[-1]} _ {after[0]}"] if before else []
    return found + ([" ".join(before) + " _"] if len(before) == 2 else [])


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens outside ``taken`` that may name someone: an ``@`` or three digits or more."""
    place, spans, k = 0, [(s, e) for _, s, e in taken], 0
    while found := _SIGN.search(text, place):
        start = max(text.rfind(b, 0, found.start()) for b in _BREAK) + 1 if found.start() else 0
        start = max(start, place)
        ends = [x for x in (text.find(b, found.start()) for b in _BREAK) if x >= 0]
        place = min(ends, default=len(text))
        end = place
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        token = text[start:end]
        free = k == len(spans) or spans[k][0] >= end
        if free and 5 <= len(token) <= 64 and ("@" in token or sum(c.isdigit() for c in token) >= 3):
            yield start, end


_SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("instance", T.StringType()),
        T.StructField("patterns", T.ArrayType(T.StringType())),
    ]
)
_FOUND = T.StructType([T.StructField("__spans", T.ArrayType(_SPAN))])


def _spans(text: str) -> list[dict]:
    base = base_spans(text)
    rows = [(kind, s, e) for kind, s, e in base] + [(None, s, e) for s, e in candidates(text, base)]
    return [
        {"kind": kind, "start": s, "end": e, "instance": text[s:e].lower(), "patterns": contexts(text, s, e)}
        for kind, s, e in rows
    ]


def learn_contexts(
    edges: DataFrame, seeds: DataFrame, turns: int, trust: float, support: int
) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns and known instances of the graph ``edges`` (``pattern``, ``instance``).

    ``seeds`` are known instances with their ``kind``.  A pattern's trust for a kind is the
    confidence of its instances of that kind over all its distinct instances; it
    needs ``support`` known ones.  An instance's confidence is that at least one of its
    patterns is right.  Every turn ends in written tables.
    """
    degree = edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= support)
    known = written(seeds.select("instance", "kind", F.lit(1.0).alias("confidence")), "known")
    trusted = None
    for _ in range(turns):
        scored = (
            edges.join(known, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("confidence").alias("sure"), F.count("*").alias("met"))
            .where(F.col("met") >= support)
            .join(degree, "pattern")
            .select("pattern", "kind", (F.col("sure") / F.col("instances")).alias("trust"))
        )
        trusted = written(scored.where(F.col("trust") >= trust), "patterns")
        reached = (
            edges.join(trusted, "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(1.000001 - F.col("trust"))))).alias("confidence"))
            .groupBy("instance")
            .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
            .where(F.col("confidence") >= trust)
        )
        fresh = reached.join(seeds.select("instance").distinct(), "instance", "left_anti")
        known = written(
            seeds.select("instance", "kind", F.lit(1.0).alias("confidence")).unionByName(
                fresh.select("instance", "kind", "confidence")
            ),
            "known",
        )
    return trusted, known


def find_personal_data(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    turns: int = 3,
    trust: float = 0.8,
    support: int = 5,
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, arrays of ``kind``, ``start`` and ``end``.

    ``spans`` holds the base spans and those the method adds, in the order of start and
    then kind as listed; positions are code points, ends exclusive.  Added spans never
    overlap base ones.  An occurrence is added if a trusted pattern surrounds it or its
    instance became known elsewhere.

    Null text counts as empty.  Repeated rows get equal spans; repeats of a context
    with the same instance count once, so copies of a document teach nothing more.
    Columns of the input with a result's name are replaced.  Runs jobs; intermediate
    tables go to the shared folder.
    """
    kept = [c for c in others(docs, "base_spans", "spans") if keep is None or c in keep]
    row = F.struct(*[column(c) for c in kept]).alias("row")

    def factory():
        def work(texts: Texts):
            return [[_spans((t or b"").decode("utf-8", "replace")) for t in texts]]

        return work

    asked = docs.select(row, column(text).alias("text"))
    passed = written(
        map_texts(asked, "text", ["row"], _FOUND, factory).withColumn("__n", F.monotonically_increasing_id()),
        "spans",
    )
    met = passed.select("__n", F.explode("__spans").alias("s")).select("__n", "s.*")
    edges = written(
        met.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "contexts"
    )
    seeds = written(
        met.where("kind IS NOT NULL").select("instance", "kind").distinct()
        .groupBy("instance").agg(F.min("kind").alias("kind")),
        "seeds",
    )
    trusted, known = learn_contexts(edges, seeds, turns, trust, support)
    unnamed = met.where("kind IS NULL").select("__n", "start", "end", "instance", "patterns")
    by_pattern = (
        unnamed.select("__n", "start", "end", F.explode("patterns").alias("pattern"))
        .join(trusted.withColumnRenamed("kind", "found"), "pattern")
        .select("__n", "start", "end", "found", "trust")
    )
    by_instance = unnamed.join(known.withColumnRenamed("kind", "found"), "instance").select(
        "__n", "start", "end", "found", F.col("confidence").alias("trust")
    )
    added = (
        by_pattern.union(by_instance)
        .groupBy("__n", "start", "end")
        .agg(F.max_by("found", F.struct("trust", "found")).alias("kind"))
        .groupBy("__n")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("__added"))
    )
    base = F.transform(
        F.filter("__spans", lambda s: s["kind"].isNotNull()),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    joined = passed.join(added, "__n", "left")
    every = F.concat(base, F.coalesce("__added", F.slice(base, 1, 0)))
    return joined.select(
        *[F.col("row")[c].alias(c) for c in kept],
        base.alias("base_spans"),
        F.array_sort(every, _by_place).alias("spans"),
    )


def _by_place(a: Column, b: Column) -> Column:
    def rank(s: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])

    return (
        F.when(a["start"] != b["start"], a["start"] - b["start"])
        .otherwise(rank(a) - rank(b))
        .cast("int")
    )


def written_spans(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(kind: str, spans: str = "base_spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
