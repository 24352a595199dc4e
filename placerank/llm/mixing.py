"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source would have to be taken ``target / source size``
times.  The whole part of that number is taken outright.  The fractions are
settled in pairs: words of probability mass move from one document of a pair to
the other, in a random direction chosen so that expectations stay, until one of
the two is 0 or 1.  The other goes on to the next pair.  Mass is measured in
words, so a source's expected words never change and the words taken differ from
the target by less than one document.

Blocks of documents are settled independently; each leaves at most one fraction,
and these are settled in blocks again, up a reduction tree of depth
``log(documents) / log(block)``.  Built-in functions do all the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import column, others, uniform, word_count
from placerank.sources.scratch import written


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source``, ``source_size``, ``documents`` and ``target`` of every source.

    Sources in code point order, null last, weigh ``weights`` in turn.  They share
    ``share`` of all words by weight; targets stop at ``most`` times the source's
    size.  Sources reach that limit in the order of size to weight, so with the
    sources sorted that way a prefix is at the limit and the others share the rest:
    the level at which no other source would pass its limit is the highest one.
    The window runs over one row per source, never over documents.
    """
    totals = written(
        sizes.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count("*").alias("documents")
        ),
        "sources",
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")),
    )
    order = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    limit = most * F.col("source_size")
    total = share * F.sum("source_size").over(Window.partitionBy())
    rest = total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    leveled = weighed.withColumn("level", rest / F.sum("weight").over(after)).withColumn(
        "place", F.row_number().over(order)
    )
    # The first source below its limit; all before it are at theirs.
    below = F.when(F.col("level") * F.col("weight") < limit, F.struct("place", "level"))
    free = F.min(below).over(Window.partitionBy())
    target = F.when(free.isNull() | (F.col("place") < free["place"]), limit).otherwise(
        F.least(free["level"] * F.col("weight"), limit)
    )
    return leveled.select(
        "source", "source_size", "documents", F.coalesce(target, F.lit(0.0)).alias("target")
    )


def _pair(state: Column, item: Column, level: int) -> Column:
    """One step of a block: the waiting fraction against the next."""
    waiting = state["waiting"]

    def settle(s: Column) -> Column:
        p, a, q, b = s["p"], s["a"], s["q"], s["b"]
        up, down = F.least((1 - p) * a, q * b), F.least(p * a, (1 - q) * b)
        first = uniform(item["key"], waiting["key"], F.lit(level)) * (up + down) < down
        return _let(
            F.struct(
                first.alias("first"),
                F.when(first, (1 - p) * a <= q * b).otherwise(p * a <= (1 - q) * b).alias("p_done"),
                F.when(first, q * b <= (1 - p) * a).otherwise((1 - q) * b <= p * a).alias("q_done"),
                F.when(first, p + up / a).otherwise(p - down / a).alias("p"),
                F.when(first, q - up / b).otherwise(q + down / b).alias("q"),
            ),
            lambda r: F.struct(
                F.when(
                    r["p_done"] & ~r["q_done"], item.withField("part", r["q"])
                ).when(~r["p_done"], waiting.withField("part", r["p"])).alias("waiting"),
                F.concat(
                    state["out"],
                    F.when(
                        r["p_done"], F.array(_decided(waiting, r["first"].cast("int")))
                    ).otherwise(F.slice(state["out"], 1, 0)),
                    F.when(
                        r["q_done"], F.array(_decided(item, (~r["first"]).cast("int")))
                    ).otherwise(F.slice(state["out"], 1, 0)),
                ).alias("out"),
            ),
        )

    both = F.struct(
        waiting["part"].alias("p"), waiting["size"].cast("double").alias("a"),
        item["part"].alias("q"), item["size"].cast("double").alias("b"),
    )
    return F.when(
        waiting.isNull(), F.struct(item.alias("waiting"), state["out"].alias("out"))
    ).otherwise(_let(both, settle))


def _decided(item: Column, up: Column) -> Column:
    return F.struct(item.alias("item"), up.alias("up"))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 32,
    seed: int = 11,
    keep: list[str] | None = None,
    size: str | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` is how often the mix takes the document, at most ``ceil(most)``
    times.  A document is known by ``key`` and its size, whose hash places and
    pairs it, so reruns agree.  Sizes are words; a column named by ``size`` is used
    instead if given.  Runs jobs: the source table and each level of the tree are
    written to the shared folder.

    Null or empty text has size 0 and no copies.  A null source is a source, the
    last one.  Repeated rows are documents of their own.  Empty input gives no rows.
    Columns of the input that have a result's name are replaced.  A source with a
    third of all rows is dealt over its own blocks like any other.
    """
    names = ["size", "source_size", "target", "copies"]
    words = column(size).cast("long") if size else word_count(text)
    kept = [c for c in others(docs, *names) if keep is None or c in keep]
    sized = docs.select(
        column(source).alias("source"),
        words.alias("size"),
        F.xxhash64(column(key), words, F.lit(seed)).alias("key"),
        F.struct(*[column(c) for c in kept]).alias("row"),
    )
    targets = written(source_targets(sized, weights, share, most), "targets")
    depth = targets.agg(F.max("documents")).first()[0]
    joined = (
        sized.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select(
            "d.source", "d.size", "d.key", "d.row", "t.source_size", "t.target", "t.documents",
            F.least(F.try_divide(F.col("t.target"), F.col("t.source_size")), F.lit(most)).alias("rate"),
        )
        .withColumn("whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("int"))
        .withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
    )
    fixed = joined.where(F.col("part") <= 0).select(
        "row", "size", "source_size", "target", F.col("whole").alias("copies")
    )
    fields = ["key", "size", "part", "whole", "source", "source_size", "target", "documents", "row"]
    item = F.struct(*fields)
    level, waiting = 0, joined.where(F.col("part") > 0).select(item.alias("item"))
    settled = [fixed]
    while True:
        width = block ** (level + 1)
        last = depth is None or width >= depth
        done = written(_level(waiting, level, width, last), "mix")
        out = done.select(F.explode("out").alias("o")).select("o.item.*", "o.up")
        settled.append(
            out.select(
                "row", "size", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies")
            )
        )
        if last:
            break
        waiting = done.where(F.col("waiting").isNotNull()).select(F.col("waiting").alias("item"))
        level += 1
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    return whole.select(*[F.col("row")[c].alias(c) for c in kept], *names)


def _level(waiting: DataFrame, level: int, width: int, last: bool) -> DataFrame:
    """One level of the tree: ``out`` settled documents and one ``waiting`` per block."""
    blocks = F.ceil(F.col("item.documents") / float(width))
    placed = waiting.select(
        "item",
        F.col("item.source").alias("source"),
        F.pmod(F.xxhash64("item.key", F.lit(level)), blocks).alias("block"),
    )
    lists = placed.groupBy("source", "block").agg(F.collect_list("item").alias("items"))

    def compare(x: Column, y: Column) -> Column:
        return F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)

    ordered = lists.select(F.array_sort("items", compare).alias("items"))
    first = F.struct(
        F.element_at("items", 1).alias("waiting"),
        F.slice(F.transform("items", lambda x: _decided(x, F.lit(0))), 1, 0).alias("out"),
    )
    rest = F.slice(F.col("items"), F.lit(2), F.size("items"))
    state = ordered.select(
        F.aggregate(rest, first, lambda s, x: _pair(s, x, level)).alias("state")
    ).select("state.*")
    if not last:
        return state
    draw = (uniform(F.col("waiting.key"), F.lit(-1)) < F.col("waiting.part")).cast("int")
    closing = F.when(
        F.col("waiting").isNotNull(), F.array(_decided(F.col("waiting"), draw))
    ).otherwise(F.slice("out", 1, 0))
    return state.select(F.concat("out", closing).alias("out"), "waiting")


def repeat_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **mix) -> DataFrame:
    """Every row of ``docs`` as many times as ``mix_sources`` with the arguments ``mix`` takes it.

    All columns keep their names and values, also those with the name of a result of the mix.
    """
    names = {"key": key, "text": text, "source": source}
    aside = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"), *[column(c).alias(n) for n, c in names.items()]
    )
    taken = mix_sources(aside, **{n: n for n in names}, keep=["row"], **mix).where(F.col("copies") > 0)
    repeats = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return taken.select("row", repeats).select(*[F.col("row")[c].alias(c) for c in docs.columns])
