"""Reading and writing the tables of the model.

Paths are plain arguments; credentials belong in the Spark configuration.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerank.constants import EUROPE_CODES, PICKER_COLUMNS
from placerank.operators.nested import neighbour_lists


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Listings, cities or any other Parquet table."""
    return spark.read.parquet(path)


def read_countries(
    spark: SparkSession,
    path: str,
    countries: Sequence[str],
    partition_column: str = "addr_cc",
) -> DataFrame:
    """Some countries of a dataset written by ``write_by_country``.

    The filter is on the partition column, so other folders are not listed.
    """
    return spark.read.parquet(path).where(F.col(partition_column).isin(list(countries)))


def path_prefix(path: str) -> str:
    """A pattern of the files at ``path``: the whole path, ended by a slash or the end.

    The scheme that Spark puts before a path is not part of the comparison, and
    blanks are compared in the escaped form that Spark gives them.
    """
    place = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    whole = re.sub("/+", "/", place)
    start = "" if whole.startswith("/") else "/"
    return rf"^[^:/]*:(//[^/]*)?{'.*' if start else '/*'}{start}{re.escape(quote(whole, safe='/=+,@~'))}(/|$)"


def read_by_continent(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """All continents' files in one scan, with the continent each row came from."""
    frames = spark.read.parquet(*paths.values())
    origin = F.col("_metadata.file_path")
    continent = F.lit(None).cast("string")
    for name, path in paths.items():
        inside = path_prefix(path)
        continent = F.when(origin.rlike(inside), F.lit(name)).otherwise(continent)
    return frames.select("*", continent.alias("continent"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_by_country(
    df: DataFrame,
    path: str,
    partition_column: str = "addr_cc",
    files_per_country: int | None = None,
    mode: str = "overwrite",
) -> None:
    """One folder per country.

    A hash repartition on the country alone would put the largest country in
    one task.  By default tasks write what they hold; ``files_per_country``
    gathers each country in that many salted tasks instead.
    """
    if files_per_country:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != partition_column]),
                      F.lit(files_per_country))
        df = df.repartition(partition_column, salt)
    df.write.mode(mode).partitionBy(partition_column).parquet(path)


def write_lookup(
    df: DataFrame,
    path: str,
    key: str,
    row_group_bytes: int = 8 << 20,
    expected_ids: int = 1_000_000,
    mode: str = "overwrite",
) -> None:
    """A table from which rows of one ``key`` are read without looking at the others.

    Files hold ranges of keys in order, so their statistics, and those of their row groups and
    pages, name few places for a key; a bloom filter in each row group settles keys
    that are not there.  Smaller row groups read less for a key and cost more for a whole scan.
    """
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    options = {
        f"parquet.bloom.filter.enabled#{key}": "true",
        f"parquet.bloom.filter.expected.ndv#{key}": str(expected_ids),
        "parquet.block.size": str(row_group_bytes),
    }
    ordered.write.mode(mode).options(**options).parquet(path)


def look_up(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """Rows of one key of a table written by ``write_lookup``; none if it has no such key."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value))


def write_neighbours(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_by_country(df, path, "target_cc", mode=mode)


def write_neighbours_json(neighbours: DataFrame, path: str, n: int) -> None:
    """One JSON record per source and target country, neighbours nested by distance."""
    nested = neighbour_lists(neighbours, n)
    nested.write.mode("overwrite").partitionBy("target_cc").json(path)


def read_neighbours_json(
    spark: SparkSession,
    path: str,
    neighbour_schema: T.StructType,
    source_id: str,
    country: str,
) -> DataFrame:
    """The stored neighbours of one listing in one country; none if unknown."""
    schema = T.StructType(
        [
            T.StructField("src_property_id", T.StringType()),
            T.StructField("results", T.ArrayType(neighbour_schema)),
            T.StructField("target_cc", T.StringType()),
        ]
    )
    return (
        spark.read.schema(schema)
        .json(path)
        .where(F.col("target_cc") == country.strip().upper())
        .where(F.col("src_property_id") == str(source_id).strip())
        .select("src_property_id", "target_cc", F.inline("results"))
    )


def read_neighbour_payloads(
    spark: SparkSession, path: str, neighbour_schema: T.StructType
) -> DataFrame:
    """Neighbour rows of JSON payloads that are ``{"results": [...]}`` or a bare list."""
    rows = T.ArrayType(neighbour_schema)
    wrapped = T.StructType([T.StructField("results", rows)])
    text = F.col("value")
    listed = F.coalesce(
        F.when(F.ltrim(text).startswith("["), F.from_json(text, rows)),
        F.from_json(text, wrapped)["results"],
    )
    return spark.read.text(path, wholetext=True).select(F.inline(listed))


def clean_picker_sample(df: DataFrame, codes: Iterable[str] = tuple(EUROPE_CODES)) -> DataFrame:
    """The picker's sample: known countries, text ids, numbers where they parse."""
    country = F.upper(F.trim(F.col("addr_cc")))
    numbers = {
        name: F.col(name).try_cast("double") for name in ("price_per_night", "ratings")
    }
    have = set(df.columns)
    missing = {name: F.lit(None).cast("string") for name in PICKER_COLUMNS if name not in have}
    return (
        df.withColumns(missing)
        .select(*PICKER_COLUMNS)
        .withColumns(numbers | {
            "addr_cc": country,
            "property_id": F.col("property_id").cast("string"),
        })
        .where(F.col("addr_cc").isin(list(codes)) & F.col("property_id").isNotNull())
    )


def read_picker_sample(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """The stored sample, every field read as text first.

    A sample written here is one record per line; ``one_array`` reads a file that
    is a single JSON array instead, which only suits a small sample.
    """
    fields = T.StructType([T.StructField(c, T.StringType()) for c in PICKER_COLUMNS])
    return clean_picker_sample(spark.read.schema(fields).json(path, multiLine=one_array))


def write_picker_sample(df: DataFrame, path: str) -> None:
    df.select(*PICKER_COLUMNS).write.mode("overwrite").json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A small report as a single CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def from_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table from rows held on the driver, such as ids or a suite."""
    return spark.createDataFrame(list(rows), schema)
