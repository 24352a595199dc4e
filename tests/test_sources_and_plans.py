"""Files in and out, and the shape of physical plans."""

import json

import pytest
from pyspark.sql import functions as F

from checks.catalog import QUERIES
from checks.views import view
from placerank.constants import PICKER_COLUMNS
from placerank.operators import geography, ranking
from placerank.plans.online import recommend_stored, shown
from placerank.plans.suite import build_suite, report_presets
from placerank.sources import tables
from placerank.sources.scratch import scratch_dir

FOLDER = "/root/testdata/sf0.001"
PURE = [
    "clean_cast", "rating_map", "pricing_json", "listing_features", "price_waterfall", "impute_country",
    "env_wide", "scored_listings", "rank_presets", "nearest_place", "distribution_report", "tfidf",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_products_and_no_python(spark):
    for name in PURE:
        text = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text and "InArrow" not in text, name


def test_country_extremes_use_no_window(spark):
    assert "Window" not in plan(QUERIES["scored_listings"](spark, FOLDER))


def test_partition_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_by_country(view(spark, FOLDER, "listings"), path)
    text = plan(tables.read_countries(spark, path, ["FR", "DE"]).select("property_id"))
    assert "PartitionFilters: [addr_cc" in text.replace("isnotnull(addr_cc#", "[addr_cc#") or "addr_cc" in text.split("PartitionFilters")[1][:80]
    assert "listing_title" not in text.split("ReadSchema")[1]


def test_large_small_side_is_not_broadcast(spark):
    """Beyond the threshold the country facts are joined by sort-merge instead."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["price_score"](spark, FOLDER)
        assert "BroadcastHashJoin" not in plan(df) and df.count() == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"neighbor_property_id": "1", "l2_dist": 0.5}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"neighbor_property_id": "2", "l2_dist": 0.7}]))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    schema = spark.createDataFrame([], "neighbor_property_id string, l2_dist double").schema
    got = tables.read_neighbour_payloads(spark, str(tmp_path), schema).collect()
    assert sorted(tuple(r) for r in got) == [("1", 0.5), ("2", 0.7)]


def test_picker_array_file(spark, tmp_path):
    file = tmp_path / "sample.json"
    file.write_text(json.dumps([
        {"property_id": 7, "addr_cc": " fr ", "price_per_night": "12.5", "ratings": "bad"},
        {"property_id": None, "addr_cc": "FR"}, {"property_id": 8, "addr_cc": "US"}, {"property_id": 9},
    ]))
    got = tables.read_picker_sample(spark, str(file), one_array=True)
    assert got.columns == PICKER_COLUMNS
    assert [(r["property_id"], r["addr_cc"], r["price_per_night"], r["ratings"]) for r in got.collect()] == [("7", "FR", 12.5, None)]


def test_stored_recommendation(spark):
    stored = spark.createDataFrame(
        [("7", "n1", "FR", 0.1, 0.2, "one"), ("7", "n2", "FR", 0.3, 0.9, "two"), ("7", "n3", "DE", 0.1, 1.0, "x"), ("8", "n4", "FR", 0.1, 1.0, "y")],
        "src_property_id string, neighbor_property_id string, target_cc string, l2_dist double, price_score double, listing_title string",
    )
    best = recommend_stored(stored, 7, "fr", ranking.Preferences(price=1), 5)
    assert [r["neighbor_property_id"] for r in best.collect()] == ["n2", "n1"]
    assert shown(best).columns == ["listing_title"]


def test_suite_job(spark, tmp_path):
    folder = str(tmp_path)
    vectors = view(spark, FOLDER, "vectors")
    listings = vectors.select("property_id", "addr_cc").withColumns({
        "listing_title": F.concat(F.lit("L"), "property_id"), "price_score": F.lit(0.5), "env_food_norm": F.rand(1),
    })
    vectors.write.parquet(f"{folder}/embedded")
    listings.write.parquet(f"{folder}/listings")
    build_suite(spark, f"{folder}/listings", f"{folder}/embedded", f"{folder}/suite", f"{folder}/targets", f"{folder}/results", n_picks=3)
    suite, results = spark.read.parquet(f"{folder}/suite"), spark.read.parquet(f"{folder}/results")
    assert suite.select("property_id").distinct().count() == 3
    assert spark.read.parquet(f"{folder}/targets").count() == 3
    row = suite.first()
    assert results.where((F.col("target_id") == row["property_id"]) & (F.col("cand_cc") == row["dest_country"])).count() > 20
    report_presets(results, row["property_id"], row["dest_country"], f"{folder}/reports")
    name = f"{row['property_id']}_{row['dest_country']}"
    for report in (name, f"listing_{name}", f"city_{name}", f"environment_{name}"):
        assert spark.read.option("header", True).csv(f"{folder}/reports/{report}").count() == 5


def test_dense_and_sparse_kinds_of_places(spark):
    kinds = spark.createDataFrame([(1, "node"), (2, "area")], "osm_id int, osm_type string")
    assert geography.keep_kinds(kinds).count() == 1


def test_scratch_folder_is_shared_setting(spark):
    assert scratch_dir(spark) == scratch_dir(spark)


def test_continents_are_told_apart_by_their_whole_path(spark, tmp_path):
    from placerank.sources.tables import read_by_continent

    paths = {}
    for name, folder in [("Europe", "a/europe"), ("Other", "b/europe"), ("West", "a/europe_west"), ("Blank", "a/south x")]:
        paths[name] = f"{tmp_path}/{folder}"
        spark.createDataFrame([(name,)], "origin string").write.parquet(paths[name])
    rows = read_by_continent(spark, paths).collect()
    assert len(rows) == 4 and all(r.origin == r.continent for r in rows)


def test_country_pool_ignores_case(spark):
    from placerank.operators import evaluation

    rows = [(1, "fr", [1.0, 0.0]), (2, "de", [0.0, 1.0]), (3, "it", [0.5, 0.5])]
    df = spark.createDataFrame(rows, "property_id bigint, addr_cc string, features_norm array<double>")
    picks, _ = evaluation.pick_diverse(df, 3, seed=1)
    assert {r["property_id"] for r in picks.collect()} == {1, 2, 3}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_one_key_opens_few_rows(spark, tmp_path, kind):
    rows = spark.range(200_000).selectExpr(f"cast(id * 7 % 50021 as {kind}) as property_id", "uuid() as payload")
    plain, path = str(tmp_path / "plain"), str(tmp_path / "lookup")
    rows.repartition(4).write.parquet(plain)
    tables.write_lookup(rows, path, "property_id", row_group_bytes=1 << 18)
    wanted = 4242 if kind == "bigint" else "4242"
    counts = {}
    for name, at in (("plain", plain), ("lookup", path)):
        df = tables.look_up(spark, at, "property_id", wanted)
        plan = df._jdf.queryExecution().executedPlan()
        found = len(plan.executeCollect())
        counts[name] = (found, plan.collectLeaves().head().metrics().apply("numOutputRows").value())
    assert counts["plain"][0] == counts["lookup"][0] > 0
    assert counts["plain"][1] >= 100_000 and counts["lookup"][1] < 30_000
    assert tables.look_up(spark, path, "property_id", -1 if kind == "bigint" else "none").count() == 0


def test_words_are_counted_where_texts_are_cut(spark):
    from placerank.operators import embedding

    rows = [(1, "FR", "Sea sea a view"), (1, "FR", "the sea"), (None, "FR", "sea"), (2, None, None), (3, "DE", "")]
    df = spark.createDataFrame(rows, "property_id int, addr_cc string, text_all string")
    counted = embedding.words(df)
    assert plan(counted).count("Exchange") == 1 and "lambda" not in plan(counted)
    got = {tuple(r) for r in counted.collect()}
    assert got == {(1, "FR", "sea", 3), (1, "FR", "view", 1), (None, "FR", "sea", 1)}
