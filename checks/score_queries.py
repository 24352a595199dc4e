"""Scores and preference ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.geography_queries import CITY_JOIN, ENVIRONMENT, PAIRS
from checks.registry import query, rounded, sql_rounded
from checks.views import view
from placerank.constants import ENV_COLUMNS, RATING_COLUMNS, SCORE_COLUMNS, TEMPERATURE_COLUMNS
from placerank.operators import geography, ranking, scoring
from placerank.operators.ranking import Preferences
from placerank.plans.offline import integrate, score
from placerank.sources.scratch import written

# --- SQL steps -----------------------------------------------------------------
_CATEGORIES = " + ".join(RATING_COLUMNS.values())
INPUTS = """SELECT *, coalesce(price_per_night / nullif(guests, 0), 0) AS ppg,
  ln(1 + coalesce(property_number_of_reviews, 0)) AS rl, ln(1 + coalesce(host_number_of_reviews, 0)) AS e,
  coalesce(host_rating, 0) / 5 AS h, coalesce(host_response_rate, 0) / 100 AS r FROM listings"""
RANGED = """SELECT *, min(ppg) OVER w AS ppg_min, max(ppg) OVER w AS ppg_max, max(rl) OVER w AS rl_max,
  max(e) OVER w AS e_max, max(hosts_year) OVER w AS t_max FROM inputs WINDOW w AS (PARTITION BY addr_cc)"""
LISTING_SCORES = f"""SELECT property_id, addr_cc,
  CASE WHEN ppg_max = ppg_min THEN 0 ELSE 1 - (ppg - ppg_min) / (ppg_max - ppg_min) END AS price_score,
  0.8e0 * ((0.6e0 * ratings / 5 + 0.4e0 * ({_CATEGORIES}) / 6 / 5) * w + 0.5e0 * (1 - w)) + 0.2e0 * is_guest_favorite
    AS property_quality,
  0.6e0 * (en * h + (1 - en) * 0.5e0) + 0.1e0 * r + 0.1e0 * is_supperhost
    + 0.2e0 * coalesce(hosts_year / nullif(t_max, 0), 0) * (h - 0.5e0) AS host_quality
FROM (SELECT *, coalesce(rl / nullif(rl_max, 0), 0) AS w, coalesce(e / nullif(e_max, 0), 0) AS en FROM ranged)"""
_NORMS = ", ".join(
    f"coalesce({c} / nullif(max({c}) OVER (PARTITION BY addr_cc), 0), 0) AS {c}_norm"
    for c in ENV_COLUMNS
)
ENV_SCORES = f"SELECT property_id, {', '.join(ENV_COLUMNS)}, {_NORMS} FROM env JOIN listings USING (property_id)"
_TEMPS = ", ".join(
    f"CAST(json_extract_string(avg_temp_monthly, '$.\"{m}\".avg') AS DOUBLE) AS temp_avg_m{m:02d}"
    for m in range(1, 13)
)
_RANK = "CASE {} WHEN 'Budget' THEN 1 WHEN 'Mid-range' THEN 2 WHEN 'Luxury' THEN 3 END"
CITY_SCORES = f"""SELECT property_id, addr_name, listing_title, room_type_text, price_per_night, ratings, final_url,
  lat, long, budget_level, {_RANK.format('budget_level')} AS budget_rank, {_TEMPS} FROM ({CITY_JOIN})"""
SCORE_STEPS = {
    "inputs": INPUTS, "ranged": RANGED, "listing_scores": LISTING_SCORES, "pairs": PAIRS,
    "env": ENVIRONMENT, "env_scores": ENV_SCORES, "city_scores": CITY_SCORES,
    "scored": """SELECT * FROM listing_scores JOIN env_scores USING (property_id)
      JOIN city_scores USING (property_id)""",
}
SCORE_VIEWS = ["listings", "pois", "cities"]


def scored(spark, folder):
    """Scoring reads the integrated listings from a written table, as the offline build does."""
    joined = integrate(
        view(spark, folder, "listings"), view(spark, folder, "cities"), view(spark, folder, "pois")
    )
    return score(written(joined, "integrated"))


# --- scores ------------------------------------------------------------------------
_LISTING_STEPS = {"inputs": INPUTS, "ranged": RANGED, "listing_scores": LISTING_SCORES}


def _register_listing_score(name: str):
    @query(
        name, ["listings"], f"SELECT property_id, addr_cc, {sql_rounded(name)} FROM listing_scores",
        _LISTING_STEPS,
    )
    def run(spark, folder):
        scores = scoring.listing_scores(view(spark, folder, "listings"))
        return rounded(scores.select("property_id", "addr_cc", name), name)


for _name in SCORE_COLUMNS:
    _register_listing_score(_name)

_NORM_COLUMNS = [f"{c}_norm" for c in ENV_COLUMNS]


@query(
    "env_norm", ["listings", "pois"], f"SELECT property_id, {sql_rounded(*_NORM_COLUMNS)} FROM env_scores",
    {"pairs": PAIRS, "env": ENVIRONMENT, "env_scores": ENV_SCORES},
)
def env_norm(spark, folder):
    wide = geography.attach_environment(view(spark, folder, "listings"), view(spark, folder, "pois"))
    normal = scoring.environment_scores(wide)
    return rounded(normal.select("property_id", *_NORM_COLUMNS), *_NORM_COLUMNS)


_CITY_COLUMNS = ["budget_level", "budget_rank", *TEMPERATURE_COLUMNS]


@query(
    "city_scores", ["listings", "cities"],
    f"SELECT property_id, {', '.join(_CITY_COLUMNS)} FROM city_scores", {"city_scores": CITY_SCORES},
)
def city_scores(spark, folder):
    joined = geography.join_cities(view(spark, folder, "listings"), view(spark, folder, "cities"))
    return scoring.city_scores(joined).select("property_id", *_CITY_COLUMNS)


_ALL = [*SCORE_COLUMNS, *_NORM_COLUMNS]


@query(
    "scored_listings", SCORE_VIEWS,
    f"SELECT property_id, addr_cc, {sql_rounded(*_ALL)}, {', '.join(_CITY_COLUMNS)} FROM scored", SCORE_STEPS,
)
def scored_listings(spark, folder):
    everything = scored(spark, folder).select("property_id", "addr_cc", *_ALL, *_CITY_COLUMNS)
    return rounded(everything, *_ALL)


# --- ranking ---------------------------------------------------------------------------
def temp_sql(month: int, preferred: float) -> str:
    return f"coalesce(greatest(0, 1 - abs(temp_avg_m{month:02d} - {preferred}) / 25), 0)"


def budget_sql(level: int) -> str:
    return f"CASE WHEN budget_rank IS NULL THEN 0 ELSE greatest(0, 1 - abs(budget_rank - {level}) / 2) END"


def score_sql(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    terms = [f"coalesce({e}, 0) * ({w}e0 / {total}e0)" for e, w in weights.items()]
    return f"round({' + '.join(terms)}, 6)"


def _ranked(name, prefs: Preferences, weights: dict[str, float], k: int):
    @query(
        name, SCORE_VIEWS,
        f"""SELECT property_id, listing_title, {score_sql(weights)} AS final_score FROM scored
ORDER BY final_score DESC, property_id LIMIT {k}""",
        SCORE_STEPS,
    )
    def run(spark, folder):
        best = ranking.rank(scored(spark, folder), prefs, k)
        return rounded(best.select("property_id", "listing_title", "final_score"), "final_score")


_ranked(
    "recommend_env",
    Preferences(price=25, property=25, host=25, env={"env_food": 20, "env_nature_norm": 10}),
    {"price_score": 25, "property_quality": 25, "host_quality": 25, "env_food_norm": 20, "env_nature_norm": 10},
    50,
)
_ranked(
    "rank_preferences", Preferences(price=1, property=3, host=2),
    {"price_score": 1, "property_quality": 3, "host_quality": 2}, 100,
)
_ranked(
    "rank_weather", Preferences(property=10, temp=30, temp_pref=22.0, travel_month=7),
    {"property_quality": 10, temp_sql(7, 22.0): 30}, 100,
)
_ranked(
    "rank_budget", Preferences(host=10, budget=30, budget_pref="mid"),
    {"host_quality": 10, budget_sql(2): 30}, 100,
)


@query(
    "rank_top", SCORE_VIEWS,
    f"SELECT property_id, {score_sql({'property_quality': 1})} AS final_score FROM scored "
    "ORDER BY property_quality DESC, property_id LIMIT 20",
    SCORE_STEPS,
)
def rank_top(spark, folder):
    best = ranking.rank(scored(spark, folder), Preferences(property=1), 20)
    return rounded(best.select("property_id", "final_score"), "final_score")


_PRESETS = {"listing": (90, 10, 10), "city": (10, 90, 10), "environment": (10, 10, 90)}


def preset_sql(name: str) -> str:
    listing, city, env = _PRESETS[name]
    weights = {c: listing for c in SCORE_COLUMNS} | {c: env for c in _NORM_COLUMNS}
    return score_sql(weights | {temp_sql(6, 22.0): city, budget_sql(2): city})


@query(
    "rank_presets", SCORE_VIEWS,
    " UNION ALL ".join(
        f"""SELECT '{name}' AS preset, property_id, addr_cc, {preset_sql(name)} AS final_score FROM scored
QUALIFY row_number() OVER (PARTITION BY addr_cc ORDER BY final_score DESC, property_id) <= 5"""
        for name in _PRESETS
    ),
    SCORE_STEPS,
)
def rank_presets(spark, folder):
    candidates = scored(spark, folder)
    presets = ranking.preset_preferences(_NORM_COLUMNS)
    best = ranking.rank_under(candidates, presets, 5, within=["addr_cc"])
    return rounded(best.select("preset", "property_id", "addr_cc", "final_score"), "final_score")
