"""Exact nearest listings that skips what cannot be near, by the triangle inequality.

Candidates of a country are cut in blocks by their nearest of some pivots.  A source's
distance to a pivot, less the block's radius, is a bound for its whole block.  In a first
round every source meets the blocks of its nearest pivots until they hold enough candidates;
the ``n``-th distance found is its limit.  In a second round it meets the other blocks whose
bound does not exceed the limit.  No other block can hold one of its nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerank.constants import N_CANDIDATES
from placerank.functions.nearest_kernel import Block, block_of, distances
from placerank.operators.neighbours import as_vectors, nearest_of_found, search_blocks
from placerank.sources.scratch import written

#: Pivots of a country at most, and candidates and sources of a block.
PIVOTS = 64
BLOCK_ROWS = 50_000
SOURCE_ROWS = 4096
#: Distances are rounded, so bounds give way by this much.
_SLACK = 1e-5


def _pivots(vectors: DataFrame, countries: DataFrame, most: int) -> tuple[dict[str, Block], bool]:
    """Some vectors of every country asked for, taken by a hash of their ids; ``most`` of each."""
    order = Window.partitionBy("addr_cc").orderBy(F.xxhash64("property_id"), "property_id")
    picked = (
        vectors.join(countries, "addr_cc").withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= most).drop("place").collect()
    )
    sparse = "indices" in vectors.columns
    by_country: dict[str, list] = {}
    for row in picked:
        by_country.setdefault(row["addr_cc"], []).append(row)
    return {c: block_of(rows, sparse) for c, rows in by_country.items()}, sparse


def _to_pivots(df: DataFrame, country: str, sent, sparse: bool) -> DataFrame:
    """``df`` with ``far``, the distances to all pivots of its ``country``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indices = batch.column("indices") if sparse else None
            of = np.array(batch.column(country).to_pylist(), dtype=object)
            far: list = [None] * batch.num_rows
            for name in set(of):
                at = np.flatnonzero(of == name)
                if name not in sent.value:
                    continue
                rows = pa.array(at)
                some = Block.from_columns(
                    batch.column("values").take(rows), None if indices is None else indices.take(rows)
                )
                for i, found in zip(at, distances(some, sent.value[name])):
                    far[i] = found
            yield batch.append_column("far", pa.array(far, pa.list_(pa.float64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, far array<double>").where("far is not null")


def pivot_blocks(
    embedded: DataFrame,
    requests: DataFrame,
    n: int = N_CANDIDATES,
    vector: str = "features_norm",
    pivots: int = PIVOTS,
) -> tuple[DataFrame, DataFrame]:
    """The ``n`` nearest found for each request, and the blocks that each source met.

    The second has a row per ``property_id``, ``target_cc`` and block (``pivot``) with its
    ``rows`` and ``round`` (1 or 2, or 0 if it was skipped).
    """
    vectors = as_vectors(embedded, vector)
    asked = requests.select("property_id", "target_cc").dropna().distinct()
    countries = asked.select(F.col("target_cc").alias("addr_cc")).distinct()
    found, sparse = _pivots(vectors, countries, pivots)
    sent = embedded.sparkSession.sparkContext.broadcast(found)

    placed = _to_pivots(vectors.join(countries, "addr_cc", "left_semi"), "addr_cc", sent, sparse)
    near = F.array_min("far")
    candidates = written(
        placed.withColumns({"pivot": F.array_position("far", near).cast("int") - 1, "near": near}).drop("far"),
        "candidates",
    )
    blocks = written(
        candidates.groupBy(F.col("addr_cc").alias("country"), "pivot").agg(
            F.count("*").alias("rows"), F.min("near").alias("least"), F.max("near").alias("most")
        ),
        "blocks",
    )
    sources = written(
        _to_pivots(vectors.drop("addr_cc").join(asked, "property_id"), "target_cc", sent, sparse), "sources"
    )

    # Blocks of a source's country, the nearest first: as many rows as there are pivots.
    far = sources.select("property_id", F.col("target_cc").alias("country"), F.posexplode("far").alias("pivot", "d"))
    own = Window.partitionBy("property_id", "country")
    by_distance = own.orderBy("d", "pivot").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.greatest(
        F.lit(0.0), F.col("d") - F.col("most"), F.col("least") - F.col("d"),
        (F.col("d") - F.min("d").over(own)) / 2,  # a candidate is no nearer to another pivot
    )
    seen = written(
        far.join(blocks, ["country", "pivot"]).withColumns(
            {"gap": gap, "held": F.coalesce(F.sum("rows").over(by_distance), F.lit(0))}
        ).drop("least", "most", "d"),
        "seen",
    )

    parts = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    asking = sources.groupBy(F.col("target_cc").alias("country")).agg(F.count("*").alias("n_sources"))
    turns = F.ceil(F.col("n_sources") / SOURCE_ROWS).cast("int")

    def met(pairs: DataFrame) -> DataFrame:
        """Sources and candidates of the pairs' blocks, large ones in parts."""
        sides = pairs.select("property_id", "country", "pivot", parts.alias("parts")).join(asking, "country")
        left = (
            sources.drop("far").withColumn("country", F.col("target_cc"))
            .join(sides, ["property_id", "country"])
            .withColumn("s", F.pmod(F.xxhash64("property_id"), turns).cast("int"))
            .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .drop("parts", "n_sources")
        )
        names = left.columns
        right = (
            candidates.drop("near").withColumn("country", F.col("addr_cc"))
            .join(blocks.select("country", "pivot", "rows"), ["country", "pivot"])
            .join(asking, "country")
            .withColumn("c", F.pmod(F.xxhash64("property_id"), parts).cast("int"))
            .withColumn("s", F.explode(F.sequence(F.lit(0), turns - 1)))
            .drop("rows", "n_sources")
        )
        left = left.toDF(*[f"source_{name}" for name in names])
        return search_blocks(left, right, names, ["pivot", "s", "c"], n, True)

    first_pairs = F.col("held") <= n
    first = written(met(seen.where(first_pairs)), "first")
    kept = nearest_of_found(first, n)
    limits = kept.groupBy(F.col("src_property_id").alias("property_id"), F.col("target_cc").alias("country")).agg(
        F.when(F.count("*") >= n, F.max("l2_dist")).alias("limit")
    )
    reached = written(
        seen.join(limits, ["property_id", "country"], "left").withColumn(
            "round",
            F.when(first_pairs, 1)
            .when(F.col("gap") <= F.coalesce("limit", F.lit(float("inf"))) + _SLACK, 2).otherwise(0),
        ),
        "reached",
    )
    second = met(reached.where(F.col("round") == 2))
    best = nearest_of_found(kept.unionByName(second), n)
    shown = reached.select("property_id", F.col("country").alias("target_cc"), "pivot", "rows", "round")
    return best, shown


def pivot_neighbours(
    embedded: DataFrame,
    requests: DataFrame,
    n: int = N_CANDIDATES,
    vector: str = "features_norm",
    pivots: int = PIVOTS,
) -> DataFrame:
    """The ``n`` nearest candidates for every (``property_id``, ``target_cc``) request, exactly.

    As ``nearest_neighbours``, for vectors that lie in clusters; where they do not, few blocks
    can be skipped.  Pivots are the only vectors that are sent around, ``pivots`` for a country.
    """
    return pivot_blocks(embedded, requests, n, vector, pivots)[0]
