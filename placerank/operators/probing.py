"""An index of narrow buckets in which a query looks at several buckets, the likeliest first.

Vectors lie in one bucket of each table, by the steps of several random projections.  Narrow
buckets hold few vectors, so a query also looks into neighbouring ones, in the order of how
near their boundaries are.  Buckets looked at are rows and meet the candidates in an
equi-join.  How many are needed for a wanted recall is measured on a bounded number of
sources against the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.constants import N_CANDIDATES
from placerank.functions.nearest_kernel import Block
from placerank.functions.probe_kernel import Projections, keys, places, probes
from placerank.operators.neighbours import as_vectors, met_in_buckets, nearest_neighbours, nearest_of_met
from placerank.sources.scratch import written

#: Requests that the number of buckets is measured with, and buckets of one request at most.
ASKED = 64
MOST = 4096


@dataclass
class ProbeIndex:
    """``vectors`` and the ``buckets`` (``id``, ``addr_cc``, ``place``, ``bucket``) they lie in."""

    vectors: DataFrame
    buckets: DataFrame
    shape: Projections
    embedded: DataFrame
    vector: str


def _block(batch: pa.RecordBatch) -> Block:
    sparse = batch.column("indices") if "indices" in batch.schema.names else None
    return Block.from_columns(batch.column("values"), sparse)


def build_probe_index(
    embedded: DataFrame,
    width: float,
    tables: int = 4,
    functions: int = 4,
    seed: int = 11,
    vector: str = "features_norm",
) -> ProbeIndex:
    """Buckets of all vectors, as a written table; ``width`` is a step along a projection.

    A unit vector has a projection of about 1, so widths below 1 make narrow buckets.
    """
    shape = Projections(tables, functions, width, seed)
    vectors = as_vectors(embedded, vector)
    kind = vectors.schema["property_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = keys(np.floor(places(_block(batch), shape)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("property_id"), batch.column("addr_cc"), pa.array(list(found), pa.list_(pa.int64()))],
                names=["id", "addr_cc", "keys"],
            )

    buckets = vectors.mapInArrow(run, f"id {kind}, addr_cc string, keys array<long>").select(
        "id", "addr_cc", F.posexplode("keys").alias("place", "bucket")
    )
    return ProbeIndex(vectors, written(buckets, "buckets"), shape, embedded, vector)


def _probed(index: ProbeIndex, requests: DataFrame, most: int) -> DataFrame:
    """``most`` buckets of each requested source and country, numbered by ``turn``."""
    shape = index.shape
    asked = requests.select(F.col("property_id").alias("asked_id"), "target_cc").dropna().distinct()
    one = index.vectors.join(
        asked.select("asked_id").distinct(), F.col("property_id") == F.col("asked_id"), "left_semi"
    )
    kind = index.vectors.schema["property_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at in enumerate(places(_block(batch), shape)):
                tables, found = probes(at, most)
                rows = pa.array([i] * len(found), pa.int64())
                columns = [batch.column("property_id").take(rows), pa.array(tables), pa.array(found)]
                turns = pa.array(np.arange(len(found)), pa.int32())
                yield pa.RecordBatch.from_arrays([*columns, turns], names=["src", "place", "bucket", "turn"])

    looked = one.mapInArrow(run, f"src {kind}, place int, bucket long, turn int")
    return looked.join(asked, F.col("src") == F.col("asked_id")).drop("asked_id")


def _met(index: ProbeIndex, looked: DataFrame) -> DataFrame:
    buckets = index.buckets.withColumnsRenamed({"addr_cc": "target_cc"})
    return looked.join(buckets, ["target_cc", "place", "bucket"]).where("src <> id")


def measured_probes(
    index: ProbeIndex, requests: DataFrame, n: int, recall: float, asked: int = ASKED
) -> int | None:
    """Buckets a request must look at to meet ``recall`` of its ``n`` nearest; None beyond ``MOST``.

    Measured on at most ``asked`` requests, taken by a hash, against the exact search.
    """
    order = F.xxhash64("property_id", "target_cc")
    few = written(
        requests.select("property_id", "target_cc").dropna().distinct().orderBy(order).limit(asked), "asked"
    )
    true = written(
        nearest_neighbours(index.embedded, few, n, index.vector).select(
            F.col("src_property_id").alias("src"), F.col("neighbor_property_id").alias("id"), "target_cc"
        ),
        "true",
    )
    wanted = _met(index, _probed(index, few, MOST)).join(true, ["src", "id", "target_cc"], "left_semi")
    first = wanted.groupBy("src", "id", "target_cc").agg(F.min("turn").alias("turn"))
    rows = true.join(first, ["src", "id", "target_cc"], "left").select("turn").collect()
    turns = sorted(MOST if r["turn"] is None else r["turn"] for r in rows)
    if not turns:
        return 1
    needed = turns[min(int(np.ceil(recall * len(turns))), len(turns)) - 1] + 1
    return needed if needed <= MOST else None


def probed_pairs(index: ProbeIndex, requests: DataFrame, looked_at: int) -> DataFrame:
    """Distinct pairs of a source and a candidate in one of the buckets looked at."""
    met = _met(index, _probed(index, requests, looked_at))
    return met.select(
        F.col("src").alias("src_property_id"), F.col("id").alias("neighbor_property_id"), "target_cc"
    ).distinct()


def probed_lists(index: ProbeIndex, requests: DataFrame, looked_at: int) -> DataFrame:
    """The same pairs as lists: the ``sources`` that each ``neighbor_property_id`` meets."""
    looked = _probed(index, requests, looked_at).withColumnsRenamed({"src": "src_property_id"}).drop("turn")
    buckets = index.buckets.withColumnsRenamed({"id": "neighbor_property_id", "addr_cc": "target_cc"})
    return met_in_buckets(looked, buckets)


def nearest_of_lists(index: ProbeIndex, requests: DataFrame, lists: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest of ``probed_lists``, with exact distances."""
    asked = requests.select(F.col("property_id").alias("src_property_id"), "target_cc")
    return nearest_of_met(index.vectors, asked, lists, n)


def probe_neighbours(
    index: ProbeIndex,
    requests: DataFrame,
    n: int = N_CANDIDATES,
    recall: float = 0.95,
    looked_at: int | None = None,
) -> DataFrame:
    """The ``n`` nearest of the candidates each request meets, with exact distances.

    Without ``looked_at``, the number of buckets is the least that meets ``recall`` of the true
    neighbours of some requests; where ``MOST`` do not suffice, the exact search answers.
    """
    looked_at = looked_at or measured_probes(index, requests, n, recall)
    if looked_at is None:
        return nearest_neighbours(index.embedded, requests, n, index.vector)
    return nearest_of_lists(index, requests, probed_lists(index, requests, looked_at), n)
