"""Column expressions used by more than one operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that are columns of ``df``, in the order given."""
    have = set(df.columns)
    return [name for name in names if name in have]


def as_double(name: str) -> Column:
    """A column as double; text that is not a number becomes null."""
    return F.col(name).try_cast("double")


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Quotient, or ``default`` where either side is null or the divisor is 0."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(float(default)))


def cosine_from_l2(distance: Column) -> Column:
    """Cosine similarity of two unit vectors from their Euclidean distance."""
    return 1 - distance * distance / 2


def seeded_order(seed: int | str, *columns: Column | str) -> Column:
    """A repeatable shuffle key: the same seed gives the same order everywhere."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))


def seeded_share(fraction: float, seed: int | str, *columns: Column | str) -> Column:
    """Whether a row is in a sample of that fraction: the same rows for the same seed."""
    limit = min(max(int(fraction * 2**32), 0), 2**32)
    place = F.conv(F.substring(seeded_order(seed, *columns), 1, 8), 16, 10).cast("bigint")
    return place < F.lit(limit)


def truncated(label: Column, max_length: int = 15) -> Column:
    """Label cut to ``max_length`` characters, the last three being dots."""
    text = F.coalesce(label.cast("string"), F.lit(""))
    short = F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(text) > max_length, short).otherwise(text)


def column_safe(name: str) -> str:
    """A name with every character but letters and digits replaced by ``_``."""
    return "".join(ch if ch.isalnum() else "_" for ch in name)


def environment_columns(names: Iterable[str]) -> list[str]:
    """Environment features among ``names``: the normalised ones if there are any."""
    env = sorted(n for n in names if n.startswith("env_"))
    normalised = [n for n in env if n.endswith("_norm")]
    return normalised or [n for n in env if not n.endswith("_max")]
