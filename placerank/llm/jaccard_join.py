"""Exact Jaccard self-join of word shingles with adaptive multi-match prefixes.

Documents link when their sets of five-word shingles have a Jaccard similarity of
0.8 or more.  Shingles have one global order, frequent ones last.  Two documents
that link share at least ``l`` shingles among the first ``n - ceil(0.8 n) + l`` of
each, for every ``l``.  A document whose prefix meets frequent shingles takes a longer
prefix and asks for more matches, by estimated cost (Wang, Li and Feng, 2012).

Only components are wanted, so not every pair is measured.  Equal sets are one
class.  In each list of documents that share a prefix shingle, all are first compared
with one pivot.  What the pivot links is one component, and pairs within a
component are settled.  The last join pairs what is left, documents of different
components, and misses no link.  A group of thousands of near copies costs about
one comparison per copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from placerank.llm.common import column, others, pieces, small_batches
from placerank.llm.graph import components
from placerank.sources.scratch import shuffles_dropped, written

SHINGLE = 5
SKETCH_BITS = 20
FILTER_BITS = 24
_CHUNK = 4096
_MOST_MATCHES = 8
_STAR_ROUNDS = 2
# A word takes some 250 bytes, and every Python worker of an executor has a table of its own.
_KEPT_WORDS = 1 << 15
# Odd multipliers that give each place in a shingle its own weight.
_WEIGHTS = [np.uint64(xxhash.xxh64_intdigest(bytes([k])) | 1) for k in range(SHINGLE)]
_MIX = np.uint64(xxhash.xxh64_intdigest(b"mix") | 1)


class _WordHashes(dict):
    """64-bit hashes of words; frequent words stay while the table is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; fewer words are one."""
    words = (text or b"").lower().split()
    n = len(words)
    if n < SHINGLE:
        if not n:
            return np.zeros(0, dtype=np.uint64)
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    hashed = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    mixed = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
    for k, weight in enumerate(_WEIGHTS):
        mixed += hashed[k : n - SHINGLE + 1 + k] * weight
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def digest(tokens: np.ndarray) -> int | None:
    """One number for a set; classes are told apart by it and by the size of the set."""
    if not len(tokens):
        return None
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def _narrow(counts: np.ndarray) -> bytes:
    """A chunk of counts in the fewest bytes a count that hold them all."""
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"u{len(raw) // _CHUNK}").astype(np.int64)


def _sets_and_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the texts that gives two kinds of rows.

    A row per document: its id, the hash of its text, and the size and digest of
    its set.  At the end of each task, rows with the task's counts of shingles by
    hash bucket, in chunks.
    """
    source = docs.select(
        column(key).cast("long").alias("doc_id"),
        F.xxhash64(column(text)).alias("text_hash"),
        column(text).cast("binary").alias("text"),
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text_hash", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("digest", T.LongType()),
            T.StructField("chunk", T.IntegerType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        part = 0
        for batch in batches:
            for piece in pieces(batch, 2):
                sizes, digests = [], []
                found = [shingles(t) for t in piece.column(2).to_pylist()]
                for tokens in found:
                    sizes.append(len(tokens))
                    digests.append(digest(tokens))
                part = (part + sum(d or 0 for d in digests)) % 64
                np.add.at(counts, _bucket(np.concatenate(found)), 1)
                none = [None] * piece.num_rows
                columns = [piece.column(0), piece.column(1), sizes, digests, none, none, none]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=schema.names,
                )
        if counts.any():
            chunks = counts.reshape(-1, _CHUNK)
            none = [None] * len(chunks)
            columns = [none, none, none, none, range(len(chunks)), [part] * len(chunks), [*map(_narrow, chunks)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names
            )

    return small_batches(source).mapInArrow(run, schema)


def _add_up(counted: DataFrame, *keys: str) -> DataFrame:
    """Chunks of counts added within ``keys``."""

    def add(found: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, dtype=np.int64)
        for raw in found.column("counts"):
            total += _wide(raw.as_py())
        first = found.slice(0, 1)
        return first.set_column(
            first.schema.get_field_index("counts"), "counts", pa.array([_narrow(total)], pa.binary())
        )

    return counted.groupBy(*keys).applyInArrow(add, counted.schema)


def frequency_levels(counted: DataFrame) -> np.ndarray:
    """Base-two logarithm of every bucket's count, one byte each.

    The sketch has a fixed size, ``2 ** SKETCH_BITS`` counts, whatever the data, so it
    may pass through the driver and be broadcast.  Tasks' chunks are added in two
    steps, so that no group holds more than a 64th of the tasks.
    """
    chunks = counted.where("chunk IS NOT NULL").select("chunk", "part", "counts")
    total = np.zeros((1 << SKETCH_BITS) // _CHUNK * _CHUNK, dtype=np.int64).reshape(-1, _CHUNK)
    for row in _add_up(_add_up(chunks, "chunk", "part"), "chunk").collect():
        total[row["chunk"]] = _wide(bytes(row["counts"]))
    return np.log2(total.reshape(-1) + 1).astype(np.uint8)


def prefix_length(n: int, matches: int, percent: int) -> int:
    """Length of the prefix in which a linked document shares ``matches`` shingles."""
    return n - -(-percent * n // 100) + matches


def adaptive_prefix(tokens: np.ndarray, levels: np.ndarray, usual: int, percent: int):
    """The prefix in global order, the matches it asks for, and how rare its shingles are.

    Shingles beyond the usual level stand for lists as long as their count.  One
    more match costs one more posting and divides the candidates that
    these lists bring; the number of matches with the least cost is taken.
    """
    level = levels[_bucket(tokens)]
    order = np.lexsort((tokens, level))
    n = len(tokens)
    most = max(1, min(_MOST_MATCHES, -(-percent * n // 100)))
    lists = np.where(level[order] > usual + 1, np.exp2(np.minimum(level[order], 40.0)), 1.0)
    asked = np.arange(1, most + 1)
    lengths = np.minimum(n, prefix_length(n, asked, percent))
    cost = lengths + np.cumsum(lists)[lengths - 1] / asked
    matches = int(np.argmin(cost)) + 1
    frequent = int((level > usual + 1).sum())
    return tokens[order[: lengths[matches - 1]]], matches, n - frequent


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A number for every row, which rows of the same id and text share, and its text."""
    named = docs.select(
        column(key).cast("long").alias("doc_id"),
        F.xxhash64(column(text)).alias("text_hash"),
        column(text).cast("binary").alias("text"),
    )
    return small_batches(named.select(_mark(), "text"))


def _mark() -> Column:
    return F.xxhash64("doc_id", "text_hash").alias("mark")


def _filter_places(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _hold(bits: np.ndarray, hashes: np.ndarray) -> None:
    places = _filter_places(hashes)
    np.bitwise_or.at(bits, places >> 3, (1 << (7 - (places & 7))).astype(np.uint8))


def _may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _filter_places(hashes)
    return (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1


def _hash_filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each leading part of the hashes in the only column of ``wanted``.

    It has ``2 ** FILTER_BITS`` bits whatever the data, so it may be broadcast.  When very
    many hashes are wanted it lets more pass; the join that follows decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
        for batch in batches:
            _hold(held, batch.column(0).to_numpy())
        chunks = held.reshape(-1, _CHUNK)
        full = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([chunks[k].tobytes() for k in full], pa.binary())],
            names=["chunk", "bits"],
        )

    def either(found: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, dtype=np.uint8)
        for raw in found.column("bits"):
            total |= np.frombuffer(raw.as_py(), dtype=np.uint8)
        return pa.table({"chunk": found.column("chunk").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, bits binary"
    found = wanted.mapInArrow(run, schema).groupBy("chunk").applyInArrow(either, schema)
    bits = np.zeros(((1 << FILTER_BITS) // 8 // _CHUNK, _CHUNK), dtype=np.uint8)
    for row in found.collect():
        bits[row["chunk"]] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return bits.reshape(-1)


_PREFIX = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("matches", T.IntegerType()),
        T.StructField("rare", T.IntegerType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("copied", T.BooleanType()),
    ]
)


def _prefixes(docs: DataFrame, classes: DataFrame, levels, usual: int, key: str, text: str, percent: int) -> DataFrame:
    """One row for every class with its prefix.

    Only rows of classes that may have several rows are dealt out to find one of each.
    Of most of these, filters of fixed size let only the class's first document pass.
    As a place of a filter may hold several digests, all classes of a place go the same way.
    """
    spark = docs.sparkSession
    placed = classes.withColumn("place", F.shiftrightunsigned("digest", 64 - FILTER_BITS))
    repeated = placed.join(placed.where("copies > 1").select("place").distinct(), "place", "left_semi")
    filters = spark.sparkContext.broadcast(
        (_hash_filter(repeated.select("digest")), _hash_filter(repeated.select("first.*").select(_mark())))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        digests, firsts = filters.value
        for batch in batches:
            for piece in pieces(batch, 1):
                first = _may_hold(firsts, piece.column(0).to_numpy())
                rows = []
                for raw, one in zip(piece.column(1).to_pylist(), first, strict=True):
                    tokens = shingles(raw)
                    if not len(tokens):
                        continue
                    name = digest(tokens)
                    copied = bool(_may_hold(digests, np.array([name]))[0])
                    if one or not copied:
                        prefix, matches, rare = adaptive_prefix(tokens, table, usual, percent)
                        rows.append((len(tokens), name, matches, rare, prefix.view(np.int64), copied))
                if rows:
                    kinds = [to_arrow_type(f.dataType) for f in _PREFIX]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, zip(*rows, strict=True), kinds)], names=_PREFIX.fieldNames()
                    )

    found = written(
        _marked(docs, key, text)
        .mapInArrow(run, _PREFIX)
        .select(
            F.xxhash64("digest", "n").alias("node"), F.col("n").cast("int").alias("n"),
            "matches", "rare", (F.col("n") - F.size("prefix")).cast("int").alias("rest"), "prefix", "copied",
        ),
        "prefixes",
    )
    facts = ["n", "matches", "rare", "rest", "prefix"]
    one = found.where("copied").groupBy("node").agg(F.first(F.struct(*facts)).alias("p")).select("node", "p.*")
    return found.where("not copied").drop("copied").union(written(one, "copied"))


_SET = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.LongType())),
    ]
)


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``node`` and ``tokens`` of the ``wanted`` first documents of classes, and of few others.

    A filter of fixed size keeps most other texts from being cut up and dealt out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_hash_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            asked = _may_hold(bits, batch.column(0).to_numpy())
            for piece in pieces(batch.filter(pa.array(asked)), 1):
                found = [shingles(t) for t in piece.column(1).to_pylist()]
                columns = [[len(f) for f in found], [digest(f) for f in found], [f.view(np.int64) for f in found]]
                kinds = [to_arrow_type(f.dataType) for f in _SET]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], names=_SET.fieldNames())

    found = _marked(docs, key, text).mapInArrow(run, _SET)
    return (
        found.select(F.xxhash64("digest", "n").alias("node"), "tokens")
        .groupBy("node")
        .agg(F.first("tokens").alias("tokens"))
    )


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _verified(
    pairs: DataFrame, tried: DataFrame | None, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int
) -> DataFrame:
    """Pairs ``u``, ``v`` not ``tried`` before, and whether their whole sets are similar enough."""
    pairs = written(_untried(pairs, tried), "pairs")
    wanted = _nodes(pairs).join(classes, "node").select("first.*").select(_mark())
    sets = _sets(docs, wanted, key, text)
    left = sets.select(F.col("node").alias("u"), F.col("tokens").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("tokens").alias("b"))
    both = pairs.join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    similar = 100 * shared >= percent * (F.size("a") + F.size("b") - shared)
    return written(both.select("u", "v", similar.alias("linked")), "links")


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """``pairs`` without those that were measured before, in either order."""
    if tried is None:
        return pairs
    either = tried.select("u", "v").union(tried.select("v", "u"))
    return pairs.join(either, ["u", "v"], "left_anti").select("u", "v")


def _lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """``node``, ``token`` and ``place`` of shingles that documents of similar sizes have in their prefixes.

    Most shingles are in one document only.  They are dealt out with nothing but its
    number, and one more for its size and the place; in the order of the sizes of a list,
    a document with one of similar size in it has such a one beside it.
    """
    sized = Window.partitionBy("token").orderBy("spot")
    spots = prefixes.select(
        "node", F.shiftleft(F.col("n").cast("long"), 32).alias("n"), F.posexplode("prefix").alias("place", "token")
    ).select("node", "token", (F.col("n") + F.col("place")).alias("spot"))
    n, before, after = (
        F.shiftright(c, 32) for c in (F.col("spot"), F.lag("spot").over(sized), F.lead("spot").over(sized))
    )
    beside = spots.withColumns({"n": n, "before": before, "after": after})
    return beside.where(
        _similar_sizes(F.col("before"), F.col("n"), percent) & F.col("before").isNotNull()
        | _similar_sizes(F.col("n"), F.col("after"), percent) & F.col("after").isNotNull()
    ).select("node", "token", (F.col("spot") - F.shiftleft("n", 32)).cast("int").alias("place"))


def _may_link(shared: Column, a: str, b: str, percent: int) -> Column:
    """Whether so many shared prefix shingles leave a pair the chance to be similar.

    At least as many are asked for as the less demanding of the two asks.  And what
    the prefix that ends first does not hold is all that may be shared besides, while
    similar sets share ``percent / (100 + percent)`` of their sizes' sum.
    """
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    rest = F.greatest(f"{a}.rest", f"{b}.rest")
    return (shared >= F.least(f"{a}.matches", f"{b}.matches")) & (
        (100 + percent) * (shared + rest) >= percent * total
    )


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pivot_pairs(posts: DataFrame, percent: int, again: bool) -> DataFrame:
    """Every document of a list against the list's pivot, where components differ.

    Pairs that share too few of their pivot's lists are left to the last join.  The pivot
    has the fewest rare shingles, as the common origin of near copies has none of their
    changes; ``again`` takes the best one outside its component.  It is found by an
    aggregate, not by gathering the list.
    """
    facts = F.struct("rare", "node", "n", "rest", "matches", "component")
    whole = Window.partitionBy("token")
    seen = posts.select("token", facts.alias("own"), F.min(facts).over(whole).alias("pivot"))
    if again:
        other = F.when(F.col("own.component") != F.col("pivot.component"), F.col("own"))
        seen = seen.withColumn("pivot", F.min(other).over(whole))
    return (
        seen.where(
            (F.col("own.component") != F.col("pivot.component"))
            & _similar_sizes(F.col("own.n"), F.col("pivot.n"), percent)
        )
        .groupBy("own", "pivot")
        .agg(F.count("*").alias("shared"))
        .where(_may_link(F.col("shared"), "own", "pivot", percent))
        .select(F.col("own.node").alias("u"), F.col("pivot.node").alias("v"))
    )


def _labels(links: DataFrame) -> DataFrame:
    """Documents with the smallest pivot that links them.

    Documents with one label are in one component, which is all that pruning needs;
    components proper are found once, at the end.
    """
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _mixed(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists that hold documents of several components, labelled anew."""
    now = posts.drop("component").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    whole = Window.partitionBy("token")
    return (
        now.withColumn("low", F.min("component").over(whole))
        .withColumn("high", F.max("component").over(whole))
        .where("low <> high")
        .drop("low", "high")
    )


def _shortened(prefixes: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Leading halves of the shingles' hashes, and how many in a prefix repeat another one.

    Halves that two prefixes share, and the lost ones of either, are at least as many
    as the shingles that they share.
    """
    lists = [(tokens >> 32).astype(np.int32) for tokens in map(np.asarray, prefixes.to_numpy(zero_copy_only=False))]
    lost = [len(halves) - len(np.unique(halves)) for halves in lists]
    return pa.array(lists, pa.list_(pa.int32())), pa.array(lost, pa.int32())


def _left_over(posts: DataFrame, prefixes: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of documents of different components that may link.

    A pair is met at the first shingle it shares.  From there on both must hold enough
    shingles for two similar sets, so in the smaller one this shingle stands among the first
    ``n - 2 percent / (100 + percent) n``.  Documents whose frequent shingles come later do
    not meet in the long lists of these at all.  What a pair shares is then
    counted over both prefixes, of which a filter of fixed size keeps most others at home.
    """
    enough = f"{100 + percent}L * ({{0}}_n - {{0}}_place) >= {percent}L * ({{1}})"
    a = posts.select("token", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "place", "component")])
    b = posts.select("token", *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "place", "component")])
    pairs = (
        a.where(enough.format("a", "2 * a_n"))
        .withColumnRenamed("token", "a_token")
        .join(
            b,
            (F.col("a_token") == F.col("token"))
            & F.expr("a_n < b_n or (a_n = b_n and a_node < b_node)")
            & (F.col("a_component") != F.col("b_component"))
            & _similar_sizes(F.col("a_n"), F.col("b_n"), percent)
            & F.expr(enough.format("a", "a_n + b_n"))
            & F.expr(enough.format("b", "a_n + b_n")),
        )
        .select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))
        .distinct()
    )
    pairs = written(_untried(pairs, tried), "met")
    bits = posts.sparkSession.sparkContext.broadcast(_hash_filter(_nodes(pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_may_hold(bits.value, batch.column(0).to_numpy())))
            short, lost = _shortened(kept.column(4))
            yield pa.RecordBatch.from_arrays([*kept.columns[:4], short, lost], names=schema.names)

    needed = prefixes.select("node", "n", "rest", "matches", "prefix")
    schema = T.StructType(
        [*needed.schema.fields[:4], T.StructField("prefix", T.ArrayType(T.IntegerType())),
         T.StructField("lost", T.IntegerType())]
    )
    needed = written(small_batches(needed).mapInArrow(run, schema), "needed")
    facts = F.struct(*schema.names)
    left = needed.select(F.col("node").alias("u"), facts.alias("a"))
    right = needed.select(F.col("node").alias("v"), facts.alias("b"))
    shared = F.size(F.array_intersect("a.prefix", "b.prefix")) + F.col("a.lost")
    return pairs.join(left, "u").join(right, "v").where(_may_link(shared, "a", "b", percent)).select("u", "v")


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Null and empty texts, and texts without words, have no shingles and are their own
    component.  Repeated rows and equal sets are one component, named by its smallest
    id.  A row without an id takes part and gets the smallest id it reaches, null if
    there is none.  Empty input gives no rows; other columns of ``docs`` are not read.
    Runs jobs; intermediate tables go to the shared folder.
    """
    with shuffles_dropped(docs.sparkSession):
        rows, of_class = _named_classes(docs, key, text, percent)
    return rows.join(of_class, ["digest", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _named_classes(docs: DataFrame, key: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows by ``digest`` and ``n``, and the name of each class's component."""
    spark = docs.sparkSession
    passed = written(_sets_and_counts(docs, key, text), "sets")
    rows = passed.where("chunk IS NULL")
    levels = frequency_levels(passed)
    usual = int(np.median(levels))
    shared = spark.sparkContext.broadcast(levels)

    classes = written(
        rows.where("digest IS NOT NULL")
        .groupBy("digest", "n")
        .agg(
            F.min("doc_id").alias("smallest"),
            F.min(F.struct("doc_id", "text_hash")).alias("first"),
            F.count("*").alias("copies"),
        )
        .withColumn("node", F.xxhash64("digest", "n")),
        "classes",
    )
    prefixes = _prefixes(docs, classes, shared, usual, key, text, percent)
    lists = _lists(prefixes, percent)
    posts = written(
        lists.join(prefixes.drop("prefix"), "node").withColumn("component", F.col("node")), "posts"
    )

    tried = None
    left = posts
    for turn in range(_STAR_ROUNDS):
        pairs = _pivot_pairs(left, percent, turn > 0)
        found = _verified(pairs, tried, classes, docs, key, text, percent)
        tried = found if tried is None else tried.union(found)
        left = _mixed(posts, _labels(tried.where("linked")))
    pairs = _left_over(written(left, "mixed"), prefixes, tried, percent)
    found = _verified(pairs, None, classes, docs, key, text, percent)
    tried = found if tried is None else tried.union(found)
    edges = tried.where("linked").select("u", "v")
    labels = components(edges)

    named = (
        labels.join(classes.select("node", "smallest"), "node")
        .groupBy("component")
        .agg(F.min("smallest").alias("component_id"))
    )
    linked = labels.join(named, "component").select("node", "component_id")
    of_class = written(
        classes.join(linked, "node", "left").select(
            "digest", "n", F.coalesce("component_id", "smallest").alias("component_id")
        ),
        "named",
    )
    return rows, of_class


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the first of its smallest id.

    Rows without an id stay, as nothing names them.
    """
    found = jaccard_components(docs, key, text, percent)
    dropped = written(
        found.where("component_id < doc_id").select(F.col("doc_id").alias("__dropped")).distinct(), "dropped"
    )
    stay = docs.join(dropped, column(key) == F.col("__dropped"), "left_anti")
    repeated = Window.partitionBy(column(key)).orderBy(F.xxhash64(column(text)))
    numbered = stay.withColumn("__row", F.row_number().over(repeated))
    return numbered.where((F.col("__row") == 1) | column(key).isNull()).select(
        *[column(c) for c in others(docs, "__row")]
    )
