"""Projection, typing, de-duplication and defaults of raw listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerank.constants import (
    FINAL_COLUMNS,
    LOGGED_COLUMNS,
    NO_DESCRIPTION,
    PRICE_CAP,
    RAW_COLUMNS,
    REQUIRED_COLUMNS,
    SIMPLE_DEFAULTS,
)
from placerank.functions.expressions import present

_DOUBLES = ["lat", "long", "ratings", "host_rating", "host_response_rate", "total_price"]
_INTEGERS = ["property_number_of_reviews", "host_number_of_reviews", "hosts_year", "guests"]
_FLAGS = {
    "is_supperhost": "is_supperhost",
    "is_guest_favorite": "is_guest_favorite",
    "is_available": "availability",
}


def select_raw_columns(df: DataFrame) -> DataFrame:
    return df.select(*RAW_COLUMNS)


def cast_types(df: DataFrame) -> DataFrame:
    """Text to numbers and 0/1 flags; rows without usable coordinates are dropped.

    Text that is not a number becomes null.  A flag is 1 for ``"true"``, 0 for
    any other text and null for null.
    """
    typed = {name: F.col(name).try_cast("double") for name in _DOUBLES}
    typed |= {name: F.col(name).try_cast("int") for name in _INTEGERS}
    typed |= {
        name: (F.col(source).cast("string") == "true").cast("int")
        for name, source in _FLAGS.items()
    }
    return df.withColumns(typed).where(F.col("lat").isNotNull() & F.col("long").isNotNull())


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_orderable(field.dataType) for field in data_type)
    return isinstance(data_type, T.AtomicType)


def one_per_key(
    df: DataFrame, key: str = "property_id", order_by: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the smallest by ``order_by``, then by all other columns.

    Written as an aggregate rather than a window, so that copies of one key are
    combined before the shuffle and a key with very many rows is no hot task.
    """
    rest = [c for c in df.columns if c != key]
    sortable = [f.name for f in df.schema if f.name in rest and _orderable(f.dataType)]
    order = list(order_by) + [c for c in sortable if c not in order_by]
    if set(order) == set(rest):
        kept = F.min(F.struct(*order)).alias("kept")
    else:  # columns without an order are carried beside those that have one
        kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("kept")
    return df.groupBy(key).agg(kept).select(key, "kept.*").select(*df.columns)


def drop_incomplete(
    df: DataFrame, required: Sequence[str] = tuple(REQUIRED_COLUMNS)
) -> DataFrame:
    return df.dropna(subset=list(required))


def incomplete_count(
    df: DataFrame, required: Sequence[str] = tuple(REQUIRED_COLUMNS)
) -> DataFrame:
    """Rows kept and rows dropped by ``drop_incomplete``, in one pass."""
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    return df.agg(
        F.count_if(complete).alias("kept"),
        F.count_if(~complete).alias("dropped"),
    )


def fill_defaults(
    df: DataFrame, defaults: Mapping[str, int | float] = SIMPLE_DEFAULTS
) -> DataFrame:
    return df.fillna({name: defaults[name] for name in present(df, defaults)})


def fill_description(df: DataFrame) -> DataFrame:
    text = F.coalesce("description", "listing_title", "listing_name", F.lit(NO_DESCRIPTION))
    return df.withColumn("description", text)


def cap_price(df: DataFrame, max_price: float = PRICE_CAP) -> DataFrame:
    """Rows at or below the cap; a null price does not pass."""
    return df.where(F.col("price_per_night") <= max_price)


def add_logs(df: DataFrame, columns: Sequence[str] = tuple(LOGGED_COLUMNS)) -> DataFrame:
    """``log_1p_<column>`` for the columns that exist."""
    return df.withColumns({f"log_1p_{c}": F.log1p(c) for c in present(df, columns)})


def select_final_columns(df: DataFrame) -> DataFrame:
    logs = [c for c in df.columns if c.startswith("log_1p_")]
    return df.select(*FINAL_COLUMNS, *logs)
