"""What the operators of this folder share: reading, naming, and texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words are separated by these ASCII characters, those at which ``bytes.split()`` cuts.
WORD = r"[^\x20\x09-\x0D]+"
_PIECE_BYTES = 1 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

Texts = list[bytes | None]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of ``df`` whose names, without regard to case, are not ``taken``."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*keys: Column) -> Column:
    """A repeatable number in [0, 1) from the hash of ``keys``."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to 1,000 rows.

    Spark cuts batches for Python by rows alone.  Texts of a hundred kilobytes would make
    batches of the usual 10,000 rows larger than a worker's memory.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_ROWS)) <= 1000:
        conf.set(_BATCH_ROWS, "1000")
    return df


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, Arrow batches for Python are cut when they have ``most`` bytes."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, most)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def pieces(batch: pa.RecordBatch, text: int, most: int = _PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of text each, a long row alone."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    results: T.StructType,
    factory: Callable[[], Callable[[Texts], Sequence]],
    select: bool = False,
    piece_bytes: int = _PIECE_BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``df`` and ``results`` computed from its whole texts.

    ``factory`` runs once per task and gives a function from a list of UTF-8
    texts to one array per result.  A kept column with the name of a result
    gives way to the result.  With ``select`` the last array is a mask of the rows
    to keep.  Texts come to the function in lists of about ``piece_bytes``.
    """
    names = {f.name.lower() for f in results}
    kept = [c for c in keep if c.lower() not in names]
    source = df.select(*[column(c) for c in kept], column(text).cast("binary").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *results.fields])
    labels = [f.name for f in schema]
    kinds = [to_arrow_type(f.dataType) for f in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for piece in pieces(batch, len(kept), piece_bytes):
                found = list(work(piece.column(len(kept)).to_pylist()))
                mask = found.pop() if select else None
                columns = [*piece.columns[: len(kept)], *map(pa.array, found, kinds)]
                out = pa.RecordBatch.from_arrays(columns, names=labels)
                yield out if mask is None else out.filter(pa.array(mask))

    return small_batches(source).mapInArrow(run, schema)


def batch_iterator(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` with the annotations by which ``applyInArrow`` hands it a group batch by batch."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    call.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return call
