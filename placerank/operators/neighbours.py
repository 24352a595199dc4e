"""Nearest listings in embedding space, within one country.

The search is exact.  Requests and candidates of a country are cut by a hash of their
ids into blocks of bounded bytes, and each pair of blocks of one country is searched in a
task of its own; countries nobody asks for are not looked at.  One listing's request is
a single vector, which is sent to the candidates instead.  With an index, listings that
share a hash bucket are paired by an equi-join on the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.ml.linalg import VectorUDT

from placerank.constants import N_CANDIDATES
from placerank.functions.expressions import cosine_from_l2, present
from placerank.functions.nearest_kernel import (
    Block,
    Sources,
    as_ids,
    block_of,
    nearest_in_batches,
    total_distances,
)
from placerank.sources.scratch import written

SOURCE_ROWS = 4096
CANDIDATE_ROWS = 50_000
BLOCK_BYTES = 32 << 20
_MERGE_PARTS = 64


def _as_vectors(df: DataFrame, vector: str, shared_buckets: bool) -> tuple[DataFrame, bool]:
    """Ids, countries and plain arrays of a vector column; and whether it is sparse."""
    columns: list[Column] = [F.col("property_id"), F.col("addr_cc")]
    sparse = isinstance(df.schema[vector].dataType, VectorUDT)
    if sparse:
        parts = F.unwrap_udt(vector)
        values = parts["values"]
        places = F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(values) - 1))
        columns += [places.cast("array<bigint>").alias("indices"), values.alias("values")]
    elif "indices" in df.columns:
        sparse = True
        columns += [F.col("indices"), F.col(vector).cast("array<double>").alias("values")]
    else:
        columns.append(F.col(vector).cast("array<double>").alias("values"))
    if shared_buckets:
        hashes = F.transform("hashes", lambda h: F.unwrap_udt(h)["values"][0])
        columns.append(hashes.alias("buckets"))
    return df.select(*columns).dropna(subset=["property_id", "addr_cc", "values"]), sparse


def _sources_from(rows: Sequence, sparse: bool) -> Sources:
    ids = np.asarray([r["property_id"] for r in rows])
    return Sources(ids, block_of(rows, sparse), [[r["target_cc"]] for r in rows])


def _sources_in(rows: pa.RecordBatch) -> Sources:
    indices = rows.column("indices") if "indices" in rows.schema.names else None
    countries = [[country] for country in rows.column("target_cc").to_pylist()]
    return Sources(as_ids(rows.column("property_id")), Block.from_columns(rows.column("values"), indices), countries)


def _found(country: str, ids: np.ndarray, found, schema: pa.Schema) -> pa.RecordBatch:
    positions, neighbours, dist = found
    arrays = [ids[positions], neighbours, np.repeat(country, len(dist)), dist]
    return pa.RecordBatch.from_arrays(
        [pa.array(a.tolist(), f.type) for a, f in zip(arrays, schema)], schema=schema
    )


def _result_types(id_type: T.DataType) -> tuple[T.StructType, pa.Schema]:
    arrow_id = pa.string() if isinstance(id_type, T.StringType) else pa.int64()
    spark_id = T.StringType() if isinstance(id_type, T.StringType) else T.LongType()
    names = ["src_property_id", "neighbor_property_id", "target_cc", "l2_dist"]
    spark_types = [spark_id, spark_id, T.StringType(), T.DoubleType()]
    arrow_types = [arrow_id, arrow_id, pa.string(), pa.float64()]
    return (
        T.StructType([T.StructField(n, t) for n, t in zip(names, spark_types)]),
        pa.schema(list(zip(names, arrow_types))),
    )


def top_neighbours(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest per source and target country, ties by id, self left out."""
    return nearest_of_found(pairs.where("src_property_id <> neighbor_property_id"), n)


def nearest_of_found(found: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of every hashed part of a source's candidates, then of those.

    So no task sorts all candidates of a source.
    """
    part = F.pmod(F.xxhash64("neighbor_property_id"), F.lit(_MERGE_PARTS))
    order = ["l2_dist", "neighbor_property_id"]
    some = Window.partitionBy("src_property_id", "target_cc", part).orderBy(*order)
    every = Window.partitionBy("src_property_id", "target_cc").orderBy(*order)
    best = found.withColumn("place", F.row_number().over(some)).where(F.col("place") <= n)
    return (
        best.withColumn("place", F.row_number().over(every))
        .where(F.col("place") <= n)
        .drop("place")
    )


def nearest_neighbours(
    embedded: DataFrame,
    requests: DataFrame,
    n: int = N_CANDIDATES,
    vector: str = "features_norm",
    drop_self: bool = True,
    shared_buckets: bool = False,
    source_rows: int = SOURCE_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """The ``n`` nearest candidates for every (``property_id``, ``target_cc``) request.

    Blocks hold at most ``source_rows`` sources or ``candidate_rows`` candidates on
    average, and fewer if vectors are long.  ``shared_buckets`` admits only candidates
    that share at least one hash bucket with the source, as a locality-sensitive index
    does; ``embedded`` then carries the index's ``hashes``.  Ids without an embedding
    have no result.  Block counts are written to the shared folder when it is called.
    """
    prepared, sparse = _as_vectors(embedded, vector, shared_buckets)
    asked = requests.select("property_id", "target_cc").dropna().distinct()
    sources = prepared.drop("addr_cc").join(asked, "property_id")
    if shared_buckets:
        return _nearest_in_buckets(prepared, sources, n, drop_self)
    return _nearest_by_blocks(prepared, sources, n, sparse, drop_self, source_rows, candidate_rows)


def _blocks(df: DataFrame, country: str, rows: int, sparse: bool, name: str) -> DataFrame:
    """How many blocks every country's vectors need, by rows and by bytes."""
    size = F.sum(F.size("values")) * (16 if sparse else 8)
    counted = df.groupBy(F.col(country).alias("country")).agg(
        F.count("*").alias("rows"), size.alias("bytes")
    )
    needed = F.greatest(F.ceil(F.col("rows") / rows), F.ceil(F.col("bytes") / BLOCK_BYTES))
    return counted.select("country", F.greatest(needed, F.lit(1)).cast("int").alias(name))


def _nearest_by_blocks(
    prepared: DataFrame,
    sources: DataFrame,
    n: int,
    sparse: bool,
    drop_self: bool,
    source_rows: int,
    candidate_rows: int,
) -> DataFrame:
    """Every source block of a country meets every candidate block of it once.

    Blocks go by a hash of the id, so a country with a third of all listings has more
    blocks than others and none that is larger.
    """
    counts = written(
        _blocks(sources, "target_cc", source_rows, sparse, "s_blocks").join(
            _blocks(prepared, "addr_cc", candidate_rows, sparse, "c_blocks"), "country"
        ),
        "blocks",
    )

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("property_id"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = (
        sources.withColumn("country", F.col("target_cc")).join(counts, "country")
        .withColumn("s", block("s_blocks")).withColumn("c", every("c_blocks"))
        .drop("s_blocks", "c_blocks")
    )
    # Both sides stem from one table, so the left one's columns get their own names.
    names = left.columns
    left = left.toDF(*[f"source_{name}" for name in names])
    right = (
        prepared.withColumn("country", F.col("addr_cc")).join(counts, "country")
        .withColumn("c", block("c_blocks")).withColumn("s", every("s_blocks"))
        .drop("s_blocks", "c_blocks")
    )
    found = search_blocks(left, right, names, ["s", "c"], n, drop_self)
    return nearest_of_found(found, n)


def search_blocks(
    left: DataFrame, right: DataFrame, names: Sequence[str], blocks: Sequence[str], n: int, drop_self: bool
) -> DataFrame:
    """The ``n`` nearest candidates of every source within each pair of blocks.

    Both sides have ``country`` and ``blocks``; columns of ``left`` are called ``source_`` and
    their name of ``names``.  If ``right`` has ``sources``, a candidate meets those ids alone.
    """
    spark_schema, arrow_schema = _result_types(right.schema["property_id"].dataType)

    def search(some: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and rows.num_rows:
            block_ = _sources_in(some.rename_columns(list(names)).combine_chunks().to_batches()[0])
            for country, *found in nearest_in_batches(rows.to_batches(), block_, n, drop_self):
                out.append(_found(country, block_.ids, found, arrow_schema))
        return pa.Table.from_batches(out, schema=arrow_schema)

    keys = ["country", *blocks]
    return (
        left.groupBy(*[f"source_{k}" for k in keys])
        .cogroup(right.groupBy(*keys))
        .applyInArrow(search, spark_schema)
    )


def _nearest_in_buckets(
    prepared: DataFrame, sources: DataFrame, n: int, drop_self: bool
) -> DataFrame:
    """The ``n`` nearest of the candidates that share a bucket of any table of the index."""

    def bucketed(df: DataFrame, country: str, name: str) -> DataFrame:
        return df.select(
            F.col("property_id").alias(name), F.col(country).alias("target_cc"),
            F.posexplode("buckets").alias("place", "bucket"),
        )

    met = met_in_buckets(
        bucketed(sources, "target_cc", "src_property_id"), bucketed(prepared, "addr_cc", "neighbor_property_id"),
        drop_self,
    )
    asked = sources.select(F.col("property_id").alias("src_property_id"), "target_cc")
    return nearest_of_met(prepared.drop("buckets"), asked, met, n)


def _by_source_block(sources: DataFrame) -> DataFrame:
    """``sources`` with their block ``s`` of ``s_blocks``, of ``SOURCE_ROWS`` on average; counted now."""
    blocks = max(1, -(-sources.select("src_property_id").distinct().count() // SOURCE_ROWS))
    return sources.withColumns({"s": _source_block(blocks), "s_blocks": F.lit(blocks)})


def _source_block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("src_property_id"), F.lit(blocks)).cast("int")


def met_in_buckets(looked: DataFrame, buckets: DataFrame, drop_self: bool = True) -> DataFrame:
    """The ``sources`` that every candidate of a country meets, by blocks ``s`` of ``s_blocks``.

    ``looked`` has the buckets in which a ``src_property_id`` looks (``target_cc``, ``place``,
    ``bucket``), ``buckets`` those in which a ``neighbor_property_id`` lies.  Sources of one bucket
    are a list that meets the candidates whole, so pairs are never rows.
    """
    keys = ["target_cc", "place", "bucket"]
    lists = _by_source_block(looked).groupBy(*keys, "s", "s_blocks").agg(
        F.collect_set("src_property_id").alias("sources")
    )
    found = F.array_distinct(F.flatten(F.collect_list("sources")))
    if drop_self:
        found = F.array_remove(found, F.col("neighbor_property_id"))
    return (
        buckets.join(lists, keys).groupBy("neighbor_property_id", "target_cc", "s", "s_blocks")
        .agg(found.alias("sources")).where(F.size("sources") > 0)
    )


def as_vectors(embedded: DataFrame, vector: str = "features_norm") -> DataFrame:
    """``property_id``, ``addr_cc``, ``values`` and, if vectors are sparse, ``indices``."""
    return _as_vectors(embedded, vector, False)[0]


def nearest_of_pairs(vectors: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest among ``pairs`` of ids, from plain vectors as ``as_vectors`` gives them."""
    met = _by_source_block(pairs).groupBy("neighbor_property_id", "target_cc", "s", "s_blocks").agg(
        F.collect_set("src_property_id").alias("sources")
    )
    return nearest_of_met(vectors, pairs.select("src_property_id", "target_cc").distinct(), met, n)


def nearest_of_met(vectors: DataFrame, asked: DataFrame, met: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest of the candidates that each source meets.

    ``asked`` has the sources and their countries, ``met`` the candidates of ``met_in_buckets``.
    A candidate's vector is dealt out once for each block of sources with the list of those
    it meets; a block of sources goes to every block of the candidates.
    """
    one = vectors.drop("addr_cc").dropDuplicates(["property_id"])
    sparse = "indices" in vectors.columns
    right = met.join(one, F.col("neighbor_property_id") == F.col("property_id")).drop("neighbor_property_id")
    right = written(right.withColumns({"addr_cc": F.col("target_cc"), "country": F.col("target_cc")}), "met")
    size = F.sum(F.size("values")) * (16 if sparse else 8) + F.sum(F.size("sources")) * 8
    needed = F.greatest(F.ceil(F.count("*") / CANDIDATE_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1))
    counts = written(right.groupBy("country", "s", "s_blocks").agg(needed.cast("int").alias("c_blocks")), "blocks")
    some = counts.first()
    left = (
        asked.dropna().distinct()
        .withColumns({"s": _source_block(some["s_blocks"] if some else 1), "country": F.col("target_cc")})
        .join(counts.drop("s_blocks"), ["country", "s"])
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        .join(one, F.col("src_property_id") == F.col("property_id"))
        .drop("src_property_id", "c_blocks")
    )
    names = left.columns
    right = (
        right.drop("s_blocks").join(counts.drop("s_blocks"), ["country", "s"])
        .withColumn("c", F.pmod(F.xxhash64("property_id"), F.col("c_blocks")).cast("int"))
        .drop("target_cc", "c_blocks")
    )
    found = search_blocks(left.toDF(*[f"source_{c}" for c in names]), right, names, ["s", "c"], n, False)
    return nearest_of_found(found, n)


def retrieve(
    embedded: DataFrame,
    target_id,
    country: str,
    n: int = N_CANDIDATES,
    vector: str = "features_norm",
) -> DataFrame:
    """The ``n`` nearest listings to one listing in one country, with ``l2_dist``.

    The listing is looked up by its id, which prunes a stored table, when this is
    called.  Its one vector is sent to the candidates, and each task keeps its ``n``
    best.  The listing itself never takes one of the ``n`` places; an unknown listing
    has no neighbours.
    """
    prepared, sparse = _as_vectors(embedded, vector, False)
    found = prepared.where(F.col("property_id") == F.lit(target_id)).limit(1).collect()
    rows = [r.asDict() | {"target_cc": country} for r in found]
    spark_schema, arrow_schema = _result_types(prepared.schema["property_id"].dataType)
    sent = embedded.sparkSession.sparkContext.broadcast(_sources_from(rows, sparse))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        if not len(block.ids):
            return
        for country, *best in nearest_in_batches(batches, block, n, True):
            yield _found(country, block.ids, best, arrow_schema)

    candidates = prepared.where(F.col("addr_cc") == country)
    return nearest_of_found(candidates.mapInArrow(search, spark_schema), n).select(
        F.col("neighbor_property_id").alias("property_id"),
        F.col("target_cc").alias("addr_cc"),
        "l2_dist",
    )


def every_country(sources: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Requests for each source in each of a fixed list of countries."""
    return sources.select(
        "property_id",
        F.explode(F.array(*[F.lit(c) for c in countries])).alias("target_cc"),
    )


def attach_candidates(
    neighbours: DataFrame, listings: DataFrame, columns: Sequence[str] = ()
) -> DataFrame:
    """Listing columns beside every neighbour; columns already there are not repeated."""
    taken = set(neighbours.columns)
    wanted = [
        c
        for c in (present(listings, columns) if columns else listings.columns)
        if c not in taken and c != "property_id"
    ]
    facts = listings.select(F.col("property_id").alias("neighbor_property_id"), *wanted)
    return neighbours.join(facts, "neighbor_property_id", "left").select(
        *neighbours.columns, *wanted
    )


def with_cosine(df: DataFrame) -> DataFrame:
    return df.withColumn("cosine_similarity", cosine_from_l2(F.col("l2_dist")))


def farthest(
    embedded: DataFrame, country: str, picks: Sequence, vector: str = "features_norm"
) -> tuple | None:
    """The listing of a country with the largest summed distance to all picks.

    ``picks`` are rows of ``pick_rows``.  Each task reports its one best row.
    """
    prepared, sparse = _as_vectors(embedded, vector, False)
    schema, arrow_schema = _farthest_types(prepared.schema["property_id"].dataType)
    sent = embedded.sparkSession.sparkContext.broadcast(block_of(picks, sparse))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            total = total_distances(batch, sent.value)
            ids = as_ids(batch.column("property_id"))
            at = np.lexsort((ids, -total))[0]
            found = (-total[at], ids[at].item())
            best = found if best is None else min(best, found)
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([best[1]], arrow_schema[0].type), pa.array([-best[0]], pa.float64())],
                schema=arrow_schema,
            )

    found = (
        prepared.where(F.upper("addr_cc") == country.upper())
        .mapInArrow(search, schema)
        .orderBy(F.desc("total_dist"), "property_id")
        .limit(1)
        .collect()
    )
    return (found[0]["property_id"], found[0]["total_dist"]) if found else None


def _farthest_types(id_type: T.DataType) -> tuple[T.StructType, pa.Schema]:
    pairs, arrow = _result_types(id_type)
    spark_schema = T.StructType(
        [
            T.StructField("property_id", pairs[0].dataType),
            T.StructField("total_dist", T.DoubleType()),
        ]
    )
    return spark_schema, pa.schema([("property_id", arrow[0].type), ("total_dist", pa.float64())])


def pick_rows(embedded: DataFrame, ids: Sequence, vector: str = "features_norm") -> list:
    """The vectors of a handful of listings."""
    prepared, _ = _as_vectors(embedded, vector, False)
    found = prepared.where(F.col("property_id").isin(list(ids))).collect()
    return list({r["property_id"]: r for r in found}.values())
