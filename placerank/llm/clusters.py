"""Centroid clustering of integer vectors, over dictionaries of their subvectors.

Vectors are read once and stored in chunks of bounded size.  A chunk cuts the dimensions
into blocks and keeps, for every block, a dictionary of its distinct subvectors and one
code per vector; nothing is lost.  A round sends the centroids to all chunks.  A chunk
measures each dictionary entry against each centroid once, and the distance of a vector is
the sum of what its codes stand for.  Only sums per cluster leave a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from placerank.llm.common import column
from placerank.sources.scratch import written

#: Vectors of a chunk; codes of two bytes suffice.
CHUNK_ROWS = 8192
#: Dimensions of the widest block that is tried; blocks are halved from there.
WIDEST = 8
#: A block of several dimensions is kept while this many vectors share an entry on average.
SHARED = 4
#: Components beyond this would give squared distances that a long cannot hold.
MOST = 1 << 27

_BLOCK = T.StructType(
    [
        T.StructField("first", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("entries", T.ArrayType(T.LongType())),
        T.StructField("codes", T.BinaryType()),
    ]
)


def integer_vectors(
    df: DataFrame, key: str, vector: str, dimensions: int, scale: int
) -> DataFrame:
    """``key`` and ``whole``, the components times ``scale`` rounded down.

    Vectors that are null, of another length, or with a component that is null, not finite
    or beyond ``MOST`` after scaling are left out.
    """
    x = column(vector)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    usable = (F.size(x) == dimensions) & F.forall(
        x, lambda v: F.coalesce(F.abs(v.cast("double") * scale) <= float(MOST), F.lit(False))
    )
    return df.where(usable).select(column(key).alias("key"), whole.alias("whole"))


# --- chunks -------------------------------------------------------------------------
@dataclass
class Block:
    """Distinct subvectors of some dimensions, and the one each vector has."""

    first: int
    entries: np.ndarray
    codes: np.ndarray

    @property
    def dims(self) -> slice:
        return slice(self.first, self.first + self.entries.shape[1])


def _distinct(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the place of each row among them."""
    whole = np.ascontiguousarray(part)
    rows = whole.view([("", whole.dtype)] * whole.shape[1]).ravel()
    _, at, codes = np.unique(rows, return_index=True, return_inverse=True)
    return whole[at], codes.reshape(-1)


def encode(vectors: np.ndarray, first: int = 0, width: int | None = None) -> list[Block]:
    """Blocks of ``vectors``, as wide as leaves ``SHARED`` vectors for each entry."""
    if width is None:
        n = vectors.shape[1]
        return [b for f in range(0, n, WIDEST) for b in encode(vectors, f, min(WIDEST, n - f))]
    entries, codes = _distinct(vectors[:, first : first + width])
    if width == 1 or len(entries) * SHARED <= len(vectors):
        return [Block(first, entries, codes.astype("<u2"))]
    half = width // 2
    return encode(vectors, first, half) + encode(vectors, first + half, width - half)


def distances(blocks: Sequence[Block], centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors by centroids, as sums of those of dictionary entries."""
    total = np.zeros((len(blocks[0].codes), len(centroids)), dtype=np.int64)
    for block in blocks:
        gaps = block.entries[:, None, :] - centroids[None, :, block.dims]
        total += (gaps * gaps).sum(axis=2)[block.codes]
    return total


def sums(blocks: Sequence[Block], clusters: np.ndarray, k: int, dimensions: int) -> np.ndarray:
    """Sums of the vectors of each cluster: entries times how often the cluster has them."""
    out = np.zeros((k, dimensions), dtype=np.int64)
    for block in blocks:
        n = len(block.entries)
        found = np.bincount(clusters * n + block.codes, minlength=k * n).reshape(k, n)
        out[:, block.dims] = found @ block.entries
    return out


def _packed(ids: pa.Array, vectors: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    blocks = [
        {
            "first": b.first, "width": b.entries.shape[1],
            "entries": b.entries.ravel(), "codes": b.codes.tobytes(),
        }
        for b in encode(vectors)
    ]
    keys = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays(
        [keys.cast(schema.field(0).type), pa.array([blocks], schema.field(1).type)], schema=schema
    )


def _unpacked(row: dict) -> list[Block]:
    return [
        Block(
            b["first"],
            np.asarray(b["entries"], dtype=np.int64).reshape(-1, b["width"]),
            np.frombuffer(b["codes"], dtype="<u2"),
        )
        for b in row["blocks"]
    ]


def dictionary_chunks(vectors: DataFrame, dimensions: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of ``integer_vectors``: ``keys`` and ``blocks``, one row per chunk."""
    if not 0 < chunk_rows <= 1 << 16:
        raise ValueError("codes are of two bytes: a chunk has 1 to 65,536 vectors")
    schema = T.StructType(
        [
            T.StructField("keys", T.ArrayType(vectors.schema["key"].dataType)),
            T.StructField("blocks", T.ArrayType(_BLOCK)),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            flat = pc.list_flatten(table.column(1)).to_numpy()
            keys = table.column(0).combine_chunks()
            keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
            return _packed(keys, flat.reshape(-1, dimensions), arrow)

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, chunk_rows - rows)
                held.append(some)
                rows += some.num_rows
                batch = batch.slice(some.num_rows)
                if rows == chunk_rows:
                    yield chunk()
                    held, rows = [], 0
        if rows:
            yield chunk()

    return vectors.mapInArrow(run, schema)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# --- rounds --------------------------------------------------------------------------
def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and key, in the order of the hash."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.where("key is not null").orderBy(order, "whole").limit(k)
    return [row["whole"] for row in rows.select("whole").collect()]


def moved(chunks: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """Every centroid as the mean, rounded down, of the vectors nearest to it.

    A centroid without vectors stays.  Sums are exact and as many as the centroids.
    """
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.asarray(centroids, dtype=np.int64)
        counts, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for row in _chunk_rows(batches):
            blocks = _unpacked(row)
            nearest = distances(blocks, at).argmin(axis=1)
            counts += np.bincount(nearest, minlength=k)
            total += sums(blocks, nearest, k, dimensions)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k)), pa.array(counts), pa.array(list(total), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    def all_of(name: str) -> Column:
        parts = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")) for d in range(dimensions)]
        return F.array(*parts).alias(name)

    found = (
        chunks.select("blocks")
        .mapInArrow(run, "cluster long, n long, sums array<long>")
        .groupBy("cluster")
        .agg(F.sum("n").alias("n"), all_of("sums"))
    )
    now = list(centroids)
    for row in found.collect():
        if row["n"]:
            now[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    return now


def assigned(chunks: DataFrame, centroids: list[list[int]], key: T.DataType) -> DataFrame:
    """``key``, ``cluster`` and squared ``distance`` of every vector; ties to the smaller cluster."""
    schema = T.StructType(
        [
            T.StructField("key", key),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.asarray(centroids, dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = distances(_unpacked(row.to_pylist()[0]), at)
                columns = [
                    pc.list_flatten(row.column(0)).cast(arrow[0].type),
                    pa.array(found.argmin(axis=1), pa.int32()), pa.array(found.min(axis=1)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return chunks.mapInArrow(run, schema)


def cluster_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    seed: str = "3",
    dimensions: int = 64,
    scale: int = 1024,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Nearest of ``k`` centroids for every usable vector, after ``rounds`` moves of these.

    ``key``, ``cluster``, ``distance`` (squared, of the scaled integer vectors),
    ``cluster_inertia``, ``inertia`` and ``centroid``.  One row per usable row of ``df``;
    ``integer_vectors`` says which are.  Repeated keys and vectors each have a row.  A row
    with a null key is assigned but never a first centroid.  Fewer than ``k`` usable keys
    give as many centroids; none give no rows.  Other columns of ``df`` are not read.  Each
    round reads the stored chunks once; centroids are the only thing that is sent around.
    """
    vectors = integer_vectors(df, key, vector, dimensions, scale)
    kind = vectors.schema["key"].dataType
    chunks = written(dictionary_chunks(vectors, dimensions, chunk_rows), "chunks")
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(chunks, centroids, dimensions)
    schema = T.StructType(
        [T.StructField("cluster", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.LongType()))]
    )
    final = df.sparkSession.createDataFrame(list(enumerate(centroids)), schema)
    if not centroids:
        chunks = chunks.limit(0)
    found = written(assigned(chunks, centroids, kind), "assigned")
    spread = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = spread.agg(F.sum("cluster_inertia")).scalar()
    facts = written(spread.join(final, "cluster").withColumn("inertia", whole), "clusters")
    # As many rows as there are centroids.
    return found.join(F.broadcast(facts), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
