"""Query suites, their summary tables, and the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import query, rounded
from checks.retrieval_queries import NEIGHBOUR_STEPS, sample, vec_knn_batch
from checks.score_queries import SCORE_STEPS, SCORE_VIEWS, preset_sql, scored
from checks.views import CODES, view
from placerank.constants import EUROPE_CODES, PICKER_COLUMNS
from placerank.operators import embedding, evaluation, ranking
from placerank.operators.cleaning import one_per_key
from placerank.plans.offline import build_models, load_models
from placerank.sources import tables
from placerank.sources.scratch import scratch_path, written

# --- suites ------------------------------------------------------------------------
_DESTINATIONS = ["FR", "IT", "ES"]
_EXCLUDED = ", ".join(f"'{c}'" for c in _DESTINATIONS)
_EUROPE = ", ".join(f"'{c}'" for c in EUROPE_CODES)


def _pick_steps(n: int, excluded: str = "''") -> dict[str, str]:
    """The greedy picks, one step per pick."""
    steps = {
        "pool": f"""SELECT cc, row_number() OVER (ORDER BY md5('5|' || cc), cc) AS place
FROM (SELECT DISTINCT addr_cc AS cc FROM vectors WHERE addr_cc IN ({_EUROPE}) AND addr_cc NOT IN ({excluded}))""",
        "pick1": """SELECT property_id, addr_cc, features_norm, CAST(NULL AS DOUBLE) AS total_dist FROM vectors
WHERE addr_cc = (SELECT cc FROM pool WHERE place = 1) ORDER BY md5('5|' || property_id), property_id LIMIT 1""",
    }
    for i in range(2, n + 1):
        earlier = " + ".join(
            f"round(list_distance(v.features_norm, (SELECT features_norm FROM pick{j})), 6)" for j in range(1, i)
        )
        steps[f"pick{i}"] = f"""SELECT property_id, addr_cc, features_norm, round({earlier}, 6) AS total_dist
FROM vectors v WHERE addr_cc = (SELECT cc FROM pool WHERE place = {i}) ORDER BY total_dist DESC, property_id LIMIT 1"""
    steps["picks"] = " UNION ALL ".join(
        f"SELECT property_id, addr_cc AS country_code, total_dist, {i} AS place FROM pick{i}" for i in range(1, n + 1)
    )
    return steps


@query(
    "diverse_picks", ["vectors"], "SELECT property_id, country_code, total_dist FROM picks", _pick_steps(8)
)
def diverse_picks(spark, folder):
    return evaluation.pick_diverse(view(spark, folder, "vectors"), 8, seed=5)[0]


@query(
    "suite_single", ["vectors"],
    "SELECT property_id, country_code, cc AS dest_country FROM picks JOIN pool ON pool.place = picks.place + 4",
    _pick_steps(4),
)
def suite_single(spark, folder):
    return evaluation.one_destination_suite(view(spark, folder, "vectors"), 4, seed=5)


_CROSS = f"SELECT property_id, country_code, unnest([{_EXCLUDED}]) AS dest_country FROM picks"


@query("suite_cross", ["vectors"], _CROSS, _pick_steps(5, _EXCLUDED))
def suite_cross(spark, folder):
    return evaluation.many_destination_suite(view(spark, folder, "vectors"), 5, _DESTINATIONS, seed=5)


@query(
    "suite_targets", ["vectors", "listings"],
    "SELECT property_id, listing_title FROM listings WHERE property_id IN (SELECT property_id FROM picks)",
    _pick_steps(5, _EXCLUDED),
)
def suite_targets(spark, folder):
    targets = evaluation.suite_targets(view(spark, folder, "listings"), suite_cross(spark, folder))
    return targets.select("property_id", "listing_title")


SUITE_STEPS = _pick_steps(5, _EXCLUDED) | {
    "suite": _CROSS,
    "found": """SELECT s.property_id AS target_id, s.country_code AS target_cc, c.addr_cc AS cand_cc,
  c.property_id AS cand_id, round(list_distance(t.features_norm, c.features_norm), 6) AS l2_dist
FROM suite s JOIN vectors t USING (property_id) JOIN vectors c ON c.addr_cc = s.dest_country
  AND c.property_id <> s.property_id
QUALIFY row_number() OVER (PARTITION BY s.property_id, c.addr_cc ORDER BY l2_dist, c.property_id) <= 50""",
    "results": """SELECT found.*, round(1 - power(l2_dist, 2) / 2, 6) AS cosine_similarity, listing_title, property_id
FROM found JOIN listings ON cand_id = property_id""",
}
_RESULT_COLUMNS = ["target_id", "target_cc", "cand_cc", "cand_id", "l2_dist", "cosine_similarity", "listing_title"]


def _results(spark, folder):
    found = evaluation.suite_results(
        view(spark, folder, "vectors"), view(spark, folder, "listings"), suite_cross(spark, folder)
    )
    return rounded(found, "cosine_similarity")


@query("suite_results", ["vectors", "listings"], f"SELECT {', '.join(_RESULT_COLUMNS)} FROM results", SUITE_STEPS)
def suite_results(spark, folder):
    return _results(spark, folder).select(*_RESULT_COLUMNS)


@query(
    "suite_top5", ["vectors", "listings"],
    """SELECT target_id, cand_id, l2_dist FROM results WHERE cand_cc = 'FR'
  AND target_id = (SELECT min(property_id) FROM picks) ORDER BY l2_dist, cand_id LIMIT 5""",
    SUITE_STEPS,
)
def suite_top5(spark, folder):
    results = written(_results(spark, folder), "results")
    target = results.agg(F.min("target_id")).first()[0]
    return evaluation.suite_top(results, target, "FR").select("target_id", "cand_id", "l2_dist")


_MEDIANS = ", ".join(f"median(cell) FILTER (WHERE cand_cc = '{c}') AS {c}" for c in _DESTINATIONS)
_ROUNDED = ", ".join(f"round({c}, 3) AS {c}" for c in [*_DESTINATIONS, "target_property_median"])


@query(
    "median_table", ["vectors", "listings"],
    f"""SELECT target_id, listing_title, {_ROUNDED} FROM (
  SELECT CAST(target_id AS STRING) AS target_id, l.listing_title, {_MEDIANS}, median(cell) AS target_property_median
  FROM cells LEFT JOIN listings l ON l.property_id = target_id GROUP BY target_id, l.listing_title
  UNION ALL SELECT 'country_median', 'Country Median', {_MEDIANS}, median(cell) FROM cells)""",
    SUITE_STEPS | {
        "cells": "SELECT target_id, cand_cc, median(cosine_similarity) AS cell FROM results GROUP BY 1, 2"
    },
)
def median_table(spark, folder):
    return evaluation.median_table(
        _results(spark, folder), view(spark, folder, "listings"), _DESTINATIONS
    )


@query(
    "similarity_wide", ["vectors", "listings"],
    "SELECT target_id, "
    + ", ".join(f"CASE WHEN cand_cc = '{c}' THEN cosine_similarity END AS {c}" for c in _DESTINATIONS)
    + """, CASE WHEN length(l.listing_title) > 17 THEN substr(l.listing_title, 1, 14) || '...'
  ELSE l.listing_title END AS label FROM results JOIN listings l ON l.property_id = target_id""",
    SUITE_STEPS,
)
def similarity_wide(spark, folder):
    return evaluation.similarity_by_country(
        _results(spark, folder), view(spark, folder, "listings"), _DESTINATIONS
    )


@query(
    "union_summary", ["listings"],
    """SELECT addr_cc, count(*) AS n_rows FROM listings GROUP BY 1
UNION ALL SELECT 'all' AS addr_cc, count(*) AS n_rows FROM listings""",
)
def union_summary(spark, folder):
    counts = view(spark, folder, "listings").groupBy("addr_cc").agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.lit("all").alias("addr_cc"), F.sum("n_rows").alias("n_rows"))
    return counts.unionByName(total)


@query(
    "excluded_countries", ["listings"],
    f"SELECT DISTINCT addr_cc FROM listings WHERE addr_cc NOT IN ({_EXCLUDED})",
)
def excluded_countries(spark, folder):
    countries = view(spark, folder, "listings").select("addr_cc").distinct()
    taken = tables.from_rows(spark, [(c,) for c in _DESTINATIONS], "addr_cc string")
    return countries.join(taken, "addr_cc", "left_anti")


@query(
    "suite_presets", ["vectors", *SCORE_VIEWS],
    " UNION ALL ".join(
        f"""SELECT '{name}' AS preset, target_id, cand_cc, cand_id, {preset_sql(name)} AS final_score
FROM found JOIN scored ON cand_id = property_id QUALIFY row_number() OVER
  (PARTITION BY target_id, cand_cc ORDER BY final_score DESC, l2_dist, cand_id) <= 5"""
        for name in ("listing", "city", "environment")
    ),
    {k: v for k, v in SUITE_STEPS.items() if k != "results"} | SCORE_STEPS,
)
def suite_presets(spark, folder):
    """Every suite row's candidates under the three named preference sets."""
    found = evaluation.suite_results(
        view(spark, folder, "vectors"), scored(spark, folder), suite_cross(spark, folder)
    )
    env = [c for c in found.columns if c.startswith("env_") and c.endswith("_norm")]
    best = ranking.rank_under(
        found, ranking.preset_preferences(env), 5, within=["target_id", "cand_cc"]
    )
    return rounded(best.select("preset", "target_id", "cand_cc", "cand_id", "final_score"), "final_score")


# --- sources and sinks: written to the shared folder and read back ---------------------
_SOME = ["FR", "DE", "JE"]


@query(
    "country_partitions", ["listings"],
    "SELECT property_id, addr_cc, price_per_night FROM listings WHERE addr_cc IN ('FR', 'DE', 'JE')",
)
def country_partitions(spark, folder):
    path = scratch_path(spark, "by_country")
    tables.write_by_country(view(spark, folder, "listings"), path, files_per_country=2)
    found = tables.read_countries(spark, path, _SOME)
    return found.select("property_id", "addr_cc", "price_per_night")


@query(
    "continent_paths", ["pois"],
    """SELECT osm_id, addr_cc, CASE WHEN addr_cc < 'GB' THEN 'africa' ELSE 'europe' END AS continent FROM pois""",
)
def continent_paths(spark, folder):
    base = scratch_path(spark, "continents")
    pois = view(spark, folder, "pois")
    paths = {"africa": f"{base}/africa_pois.parquet", "europe": f"{base}/europe_pois.parquet"}
    tables.write_table(pois.where("addr_cc < 'GB'"), paths["africa"])
    tables.write_table(pois.where("addr_cc >= 'GB'"), paths["europe"])
    return tables.read_by_continent(spark, paths).select("osm_id", "addr_cc", "continent")


_NEIGHBOUR = T.StructType(
    [T.StructField("neighbor_property_id", T.LongType()), T.StructField("l2_dist", T.DoubleType())]
)


@query(
    "neighbours_json", ["vectors"],
    """SELECT CAST(src_property_id AS STRING) AS src_property_id, target_cc, neighbor_property_id, l2_dist
FROM nearest WHERE src_property_id = 3 AND target_cc = 'GB'""",
    NEIGHBOUR_STEPS,
)
def neighbours_json(spark, folder):
    path = scratch_path(spark, "neighbours_json")
    tables.write_neighbours_json(vec_knn_batch(spark, folder), path, 50)
    return tables.read_neighbours_json(spark, path, _NEIGHBOUR, "3", "gb")


@query("neighbours_lookup", ["vectors"], "SELECT * FROM nearest WHERE src_property_id = 3", NEIGHBOUR_STEPS)
def neighbours_lookup(spark, folder):
    """One source's neighbours from a table kept in the order of sources."""
    path = scratch_path(spark, "lookup")
    tables.write_lookup(vec_knn_batch(spark, folder), path, "src_property_id")
    return tables.look_up(spark, path, "src_property_id", 3)


@query(
    "neighbours_parquet", ["vectors"], "SELECT * FROM nearest WHERE target_cc IN ('FR', 'ES')", NEIGHBOUR_STEPS
)
def neighbours_parquet(spark, folder):
    path = scratch_path(spark, "neighbours")
    tables.write_neighbours(vec_knn_batch(spark, folder), path)
    return tables.read_countries(spark, path, ["FR", "ES"], "target_cc")


@query(
    "picker_sample", ["listings"],
    f"""SELECT CAST(property_id AS STRING) AS property_id, {', '.join(PICKER_COLUMNS[1:])} FROM listings""",
)
def picker_sample(spark, folder):
    """Untidy codes and numbers, cleaned as the picker's sample is."""
    untidy = view(spark, folder, "listings").withColumn(
        "addr_cc", F.concat(F.lit(" "), F.lower("addr_cc"))
    )
    path = scratch_path(spark, "picker")
    tables.write_picker_sample(untidy, path)
    found = tables.read_picker_sample(spark, path)
    return found.select(*PICKER_COLUMNS)


@query("report_csv", ["listings"], "SELECT addr_cc, count(*) AS n_rows FROM listings GROUP BY 1")
def report_csv(spark, folder):
    path = scratch_path(spark, "report")
    counts = view(spark, folder, "listings").groupBy("addr_cc").agg(F.count("*").alias("n_rows"))
    tables.write_report_csv(counts, path)
    return spark.read.schema("addr_cc string, n_rows bigint").option("header", True).csv(path)


@query("table_roundtrip", ["listings"], "SELECT property_id, addr_cc, ratings FROM listings")
def table_roundtrip(spark, folder):
    path = scratch_path(spark, "table")
    tables.write_table(one_per_key(view(spark, folder, "listings")), path)
    return tables.read_table(spark, path).select("property_id", "addr_cc", "ratings")


@query(
    "known_ids", ["vectors"],
    "SELECT property_id, addr_cc FROM vectors WHERE property_id IN (SELECT property_id FROM sampled)",
    {"sampled": NEIGHBOUR_STEPS["sampled"]},
)
def known_ids(spark, folder):
    """A table built from sampled ids, joined to the vectors."""
    ids = [(row["property_id"],) for row in sample(spark, folder).collect()]
    return view(spark, folder, "vectors").join(
        tables.from_rows(spark, ids, "property_id bigint"), "property_id", "left_semi"
    ).select("property_id", "addr_cc")


assert set(CODES) <= set(EUROPE_CODES)


@query(
    "table_append", ["listings"],
    """SELECT property_id, addr_cc, count(*) AS copies FROM (
  SELECT property_id, addr_cc FROM listings UNION ALL SELECT property_id, addr_cc FROM listings WHERE addr_cc = 'FR')
GROUP BY ALL""",
)
def table_append(spark, folder):
    """A second write in append mode keeps the rows of the first."""
    path = scratch_path(spark, "append")
    listings = view(spark, folder, "listings").select("property_id", "addr_cc")
    tables.write_table(listings, path)
    tables.write_table(listings.where("addr_cc = 'FR'"), path, mode="append")
    return tables.read_table(spark, path).groupBy("property_id", "addr_cc").agg(
        F.count("*").alias("copies")
    )


@query(
    "neighbour_payloads", ["vectors"],
    "SELECT neighbor_property_id, l2_dist, count(*) AS copies FROM nearest GROUP BY ALL", NEIGHBOUR_STEPS,
)
def neighbour_payloads(spark, folder):
    """Payloads of every source, half of them bare lists, half wrapped."""
    found = vec_knn_batch(spark, folder)
    rows = F.collect_list(F.struct("neighbor_property_id", "l2_dist"))
    lists = found.groupBy("src_property_id").agg(rows.alias("results"))
    payload = F.when(
        F.col("src_property_id") % 2 == 0, F.to_json("results")
    ).otherwise(F.to_json(F.struct("results")))
    path = scratch_path(spark, "payloads")
    # A payload is a file; a partition by source gives each its own.
    lists.select(payload.alias("value"), "src_property_id").write.partitionBy("src_property_id").text(path)
    read = tables.read_neighbour_payloads(spark, f"{path}/*/*.txt", _NEIGHBOUR)
    return read.groupBy("neighbor_property_id", "l2_dist").agg(F.count("*").alias("copies"))


@query(
    "stored_models", ["text_listings"],
    "SELECT property_id, addr_cc, 262144 AS width FROM text_listings",
)
def stored_models(spark, folder):
    """Models built and saved from a stored table, loaded again and applied by both of them."""
    scored_path, embedded_path, model_path, index_path = (
        scratch_path(spark, label) for label in ("scored", "embedded", "model", "index")
    )
    listings = view(spark, folder, "text_listings").withColumnRenamed("text_all", "description")
    tables.write_table(listings, scored_path)
    build_models(scored_path, embedded_path, model_path, index_path, spark)
    model, index = load_models(model_path, index_path)
    again = index.transform(embedding.embed(tables.read_table(spark, scored_path), model))
    stored = tables.read_table(spark, embedded_path).select("property_id", "addr_cc")
    size = F.unwrap_udt("features_norm")
    # Widths are taken before the join, so that no vector is dealt out.
    widths = again.where(F.size("hashes") > 0).select(
        "property_id", "addr_cc", F.coalesce(size["size"], F.size(size["values"])).alias("width")
    )
    return widths.join(stored, ["property_id", "addr_cc"])
