"""Preference-weighted ranking of candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.constants import (
    BUDGET_ALIASES,
    ENV_COLUMNS,
    TARGET_COUNTRIES,
    TEMPERATURE_TOLERANCE,
)
from placerank.operators.scoring import budget_rank


def normalise_weights(weights: Mapping[str, float | None]) -> dict[str, float]:
    """Positive weights scaled to sum to 1; others are dropped."""
    positive = {k: float(w) for k, w in weights.items() if w is not None and w > 0}
    total = sum(positive.values())
    return {k: w / total for k, w in positive.items()}


def _environment_name(name: str) -> str:
    return name if name.endswith("_norm") else f"{name}_norm"


@dataclass(frozen=True)
class Preferences:
    """What a user asks for.

    Environment weights may name ``env_food`` or ``env_food_norm``.  The weather
    term needs a weight, a temperature and a month from 1 to 12; without all
    three it is left out, though its weight still takes part in normalisation.
    """

    price: float = 0.0
    property: float = 0.0
    host: float = 0.0
    temp: float = 0.0
    budget: float = 0.0
    env: Mapping[str, float] = field(default_factory=dict)
    temp_pref: float | None = None
    travel_month: int | None = None
    budget_pref: str | None = None
    normalise: bool = True

    def weights(self) -> dict[str, float]:
        """Weight per score column and per ``temp`` and ``budget``."""
        merged: dict[str, float] = {
            "price_score": self.price,
            "property_quality": self.property,
            "host_quality": self.host,
            "temp": self.temp,
            "budget": self.budget,
        }
        for name, weight in self.env.items():
            if weight is not None and weight > 0:
                column = _environment_name(name)
                merged[column] = merged.get(column, 0.0) + weight
        if self.normalise:
            return normalise_weights(merged)
        return {k: float(w) for k, w in merged.items() if w}

    def budget_level(self) -> str | None:
        level = (self.budget_pref or "").strip()
        return BUDGET_ALIASES.get(level.lower(), level) or None

    def temperature_column(self) -> str | None:
        if self.temp_pref is None or self.travel_month is None:
            return None
        month = int(self.travel_month)
        return f"temp_avg_m{month:02d}" if 1 <= month <= 12 else None


def temperature_fit(temperature: Column, preferred: Column) -> Column:
    """1 at the preferred temperature, falling to 0 at 25 degrees away; null is 0."""
    distance = F.abs(temperature - preferred) / TEMPERATURE_TOLERANCE
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - distance), F.lit(0.0)).cast("double")


def _zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def budget_fit(level: Column, preferred: Column) -> Column:
    """1 for the same level, 0.5 one step away, else 0; an unknown level is 0."""
    distance = F.abs(budget_rank(level) - budget_rank(preferred)) / 2.0
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1.0 - distance)).otherwise(0.0)


def preference_score(columns: Sequence[str], prefs: Preferences) -> Column:
    """The weighted sum of the terms whose columns exist."""
    have = set(columns)
    terms = []
    for name, weight in prefs.weights().items():
        value = None
        if name == "temp":
            column = prefs.temperature_column()
            if column in have:
                value = temperature_fit(F.col(column), F.lit(float(prefs.temp_pref)))
                value = F.when(F.col(column).isNotNull(), value).otherwise(0.0)
        elif name == "budget":
            level = prefs.budget_level()
            if level and "budget_level" in have:
                value = budget_fit(F.col("budget_level"), F.lit(level))
        elif name in have:
            value = _zero_if_null(F.col(name))
        if value is not None:
            terms.append(value * F.lit(weight))
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def _best_first(columns: Sequence[str], score_column: str) -> list[Column]:
    """Score, then distance, then id: a total order, applied before any limit."""
    order = [F.desc(score_column)]
    if "l2_dist" in columns:
        order.append(F.asc_nulls_last("l2_dist"))
    order += [F.asc(c) for c in ("property_id", "neighbor_property_id") if c in columns]
    return order


def rank(
    df: DataFrame, prefs: Preferences, k: int, score_column: str = "final_score"
) -> DataFrame:
    """The ``k`` best candidates of one request."""
    return (
        df.withColumn(score_column, preference_score(df.columns, prefs))
        .orderBy(*_best_first(df.columns, score_column))
        .limit(max(1, int(k)))
    )


def preset_preferences(
    env: Sequence[str],
    temp_pref: float = 22,
    travel_month: int = 6,
    budget_pref: str = "Mid-range",
) -> dict[str, Preferences]:
    """Three named sets: weight on the listing, on the city, on the neighbourhood."""

    def weighted(listing: float, city: float, surroundings: float) -> Preferences:
        return Preferences(
            price=listing, property=listing, host=listing, temp=city, budget=city,
            env={c: surroundings for c in env}, temp_pref=temp_pref,
            travel_month=travel_month, budget_pref=budget_pref,
        )

    return {
        "listing": weighted(90, 10, 10),
        "city": weighted(10, 90, 10),
        "environment": weighted(10, 10, 90),
    }


def rank_under(
    df: DataFrame,
    named: Mapping[str, Preferences],
    k: int,
    within: Sequence[str] = (),
    score_column: str = "final_score",
) -> DataFrame:
    """The ``k`` best candidates per named preference set and per group of ``within``.

    Every candidate is scored under all sets where it lies and is then expanded
    to one row per set; no join is needed.
    """
    scores = F.array(
        *[
            F.struct(
                F.lit(name).alias("preset"),
                preference_score(df.columns, prefs).alias(score_column),
            )
            for name, prefs in named.items()
        ]
    )
    scored = df.select("*", F.inline(scores))
    best = Window.partitionBy("preset", *within).orderBy(
        *_best_first(df.columns, score_column)
    )
    return (
        scored.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k)
    )


_REQUEST_WEIGHTS = ["w_price", "w_property", "w_host", "w_temp", "w_budget"]


def rank_requests(
    candidates: DataFrame, requests: DataFrame, score_column: str = "final_score"
) -> DataFrame:
    """Many requests at once, each with its own weights and its own ``k``.

    A request holds ``request_id``, ``src_property_id``, ``target_cc``, the five
    weights, ``env_weights`` (a map), ``temp_pref``, ``travel_month``,
    ``budget_pref`` and ``k``.  Requests meet the stored candidates of their
    source and country.
    """
    env = [f"{c}_norm" for c in ENV_COLUMNS if f"{c}_norm" in candidates.columns]

    def positive(weight: Column) -> Column:
        return F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))

    def env_weight(column: str) -> Column:
        plain = column.removesuffix("_norm")
        weights = F.col("env_weights")
        return positive(F.try_element_at(weights, F.lit(column))) + positive(
            F.try_element_at(weights, F.lit(plain))
        )

    weights = {name: positive(F.col(name)) for name in _REQUEST_WEIGHTS}
    weights |= {f"w_{c}": env_weight(c) for c in [f"{e}_norm" for e in ENV_COLUMNS]}
    total = sum((F.col(name) for name in weights), F.lit(0.0))
    asked = requests.withColumns(weights).withColumn("w_total", total)

    joined = candidates.join(asked, ["src_property_id", "target_cc"])
    temperatures = [c for c in candidates.columns if c.startswith("temp_avg_m")]
    by_month = [
        F.when(F.col("travel_month") == int(c[-2:]), F.col(c)) for c in temperatures
    ]
    temperature = F.coalesce(*by_month) if by_month else F.lit(None).cast("double")
    terms = [
        _zero_if_null(F.col(column)) * F.col(weight)
        for column, weight in [
            ("price_score", "w_price"),
            ("property_quality", "w_property"),
            ("host_quality", "w_host"),
            *[(c, f"w_{c}") for c in env],
        ]
        if column in candidates.columns
    ]
    fit = temperature_fit(temperature, F.col("temp_pref"))
    usable = temperature.isNotNull() & F.col("temp_pref").isNotNull()
    terms.append(F.when(usable, fit).otherwise(0.0) * F.col("w_temp"))
    if "budget_level" in candidates.columns:
        level = F.col("budget_pref")
        for short, name in BUDGET_ALIASES.items():
            level = F.when(F.lower(F.trim("budget_pref")) == short, F.lit(name)).otherwise(level)
        terms.append(budget_fit(F.col("budget_level"), level) * F.col("w_budget"))
    score = F.coalesce(
        F.try_divide(sum(terms[1:], terms[0]), F.col("w_total")), F.lit(0.0)
    )
    best = Window.partitionBy("request_id").orderBy(
        *_best_first(joined.columns, score_column)
    )
    return (
        joined.withColumn(score_column, score)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= F.greatest(F.col("k"), F.lit(1)))
        .select("request_id", *candidates.columns, score_column, "place")
    )


def check_request(
    source_id: str | None, country: str | None, allowed: Sequence[str] = tuple(TARGET_COUNTRIES)
) -> tuple[str, str]:
    """The source id and country in their stored form, or a ``ValueError``."""
    source = str(source_id if source_id is not None else "").strip()
    code = (country or "").strip().upper()
    if not source:
        raise ValueError("a reference listing is needed")
    if not code:
        raise ValueError("a target country is needed")
    if allowed and code not in allowed:
        raise ValueError(f"the target country must be one of: {', '.join(allowed)}")
    return source, code
