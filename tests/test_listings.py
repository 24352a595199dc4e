"""Hand-made rows for cleaning, prices, features, scores and ranking."""

import json
import math

import pytest
from pyspark.sql import functions as F

from placerank.constants import AMENITY_LIMIT, RAW_COLUMNS, SIMPLE_DEFAULTS, TEXT_ITEM_LIMIT
from placerank.operators import browsing, cleaning, coverage, nested, pricing, profiling, ranking, scoring
from placerank.operators.ranking import Preferences


def one(df):
    return df.first().asDict()


def raw(spark, **values):
    row = {c: None for c in RAW_COLUMNS} | {"property_id": "1", "lat": "48.1", "long": "2.0"} | values
    return spark.createDataFrame([tuple(row[c] for c in RAW_COLUMNS)], ", ".join(f"{c} string" for c in RAW_COLUMNS))


# --- types, duplicates, nulls --------------------------------------------------------
def test_cast(spark):
    got = one(cleaning.cast_types(raw(spark, ratings="n/a", guests="4.7", hosts_year="3", is_supperhost="True",
                                      is_guest_favorite="true", availability="false")))
    assert (got["ratings"], got["guests"], got["hosts_year"]) == (None, None, 3)
    assert (got["is_supperhost"], got["is_guest_favorite"], got["is_available"]) == (0, 1, 0)
    assert one(cleaning.cast_types(raw(spark)))["is_supperhost"] is None
    assert cleaning.cast_types(raw(spark, lat="north")).count() == 0


def test_one_per_key_is_repeatable(spark):
    data = [(1, "b", {"x": 1}), (1, "a", {"x": 2}), (2, None, None), (2, "z", None)]
    df = spark.createDataFrame(data, "property_id int, v string, m map<string,int>")
    got = {r["property_id"]: r["v"] for r in cleaning.one_per_key(df).collect()}
    assert got == {1: "a", 2: None}
    assert cleaning.one_per_key(df).columns == ["property_id", "v", "m"]


def test_defaults_keep_types(spark):
    df = spark.createDataFrame([(None, None)], "num_of_nights int, taxes double")
    got = cleaning.fill_defaults(df)
    assert one(got) == {"num_of_nights": 1, "taxes": 0.0}
    assert len(SIMPLE_DEFAULTS) == 9


# --- nested text -------------------------------------------------------------------------
def test_ratings_of_odd_json(spark):
    text = [
        json.dumps([{"name": "Value", "value": "4.5"}, {"name": "Value", "value": "2"}, {"name": "Check-in", "value": "x"}]),
        "[{broken", None, "[]",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "id int, category_rating string")
    got = [r["rating_value"] for r in nested.parse_ratings(df).orderBy("id").collect()]
    assert got == [2.0, None, None, None]
    assert one(nested.parse_ratings(df).where("id = 0"))["rating_checkin"] is None


def test_pricing_of_odd_json(spark):
    df = spark.createDataFrame([('{"num_of_nights": 2.0, "taxes": 3}',), ("oops",), (None,)], "pricing_details string")
    got = [(r["num_of_nights"], r["taxes"]) for r in nested.parse_pricing(df).collect()]
    assert got == [(2, 3.0), (None, None), (None, None)]


def features(spark, amenities=None, items=None, details=None, **limits):
    text = [json.dumps(v) if isinstance(v, list) else v for v in (amenities, items, details)]
    df = spark.createDataFrame([tuple(text)], "amenities string, description_items string, details string")
    return one(nested.extract_listing_features(df, **limits))


def test_rooms(spark):
    got = features(spark, items=["  Entire HOME ", "2 Betten", "1,5 bäder", "3 beds"], details=["3 bedrooms"])
    assert (got["room_type_text"], got["n_beds"], got["n_baths"], got["n_bedrooms"]) == ("entire home", 2.0, 1.5, 3.0)
    got = features(spark, items=["1 bed"], details=["Studio", "2 bedrooms"])
    assert (got["n_beds"], got["n_bedrooms"]) == (0.0, 0.0)
    got = features(spark, items="oops", details=None)
    assert (got["room_type_text"], got["n_beds"], got["custom_text_blob"]) == ("", 0.0, "")
    assert features(spark, items=["x", "2 bedsheets"])["n_beds"] == 0.0


def test_amenities(spark):
    groups = [
        {"group_name": "Basics", "items": [
            {"name": " Wi-Fi! ", "value": "SYSTEM_WI_FI"}, {"name": "TV", "value": "40 inch"},
            {"name": "Pool", "value": "SYSTEM_NO_POOL"}, {"name": "\t", "value": "1"}, {"name": "TV", "value": "true"}]},
        {"group_name": " NOT included ", "items": [{"name": "Heating", "value": ""}]},
        {"group_name": "Empty"},
    ]
    got = features(spark, amenities=groups)
    assert got["amenities_has_text"] == "tv | wi_fi"
    assert got["amenities_no_text"] == "no_heating | no_pool"
    assert got["amenities_text"] == "tv | wi_fi | no_heating | no_pool"
    assert got["custom_text_blob"] == " Wi-Fi! , TV: 40 inch"
    assert features(spark, amenities=[])["amenities_text"] == ""


def test_forty_amenities(spark):
    items = [{"name": f"item {i:02d}", "value": "true"} for i in range(39)]
    items += [{"name": "gone", "value": "SYSTEM_NO_X"}, {"name": "last", "value": ""}]
    late = [{"name": "late", "value": ""}, {"name": "late no", "value": "SYSTEM_NO_X"}]
    groups = [{"group_name": "a", "items": items}, {"group_name": "not included", "items": late}]
    got = features(spark, amenities=groups, amenity_limit=AMENITY_LIMIT, text_item_limit=TEXT_ITEM_LIMIT)
    assert got["amenities_no_text"] == "no_gone"
    assert len(got["amenities_has_text"].split(" | ")) == 40 and "late" not in got["amenities_text"]
    got = features(spark, amenities=groups)
    assert got["amenities_no_text"] == "no_gone | no_late | no_late_no"


def test_no_limit_drops_nothing(spark):
    amenities = [{"group_name": "a", "items": [{"name": f"item {i:03d}", "value": "1"} for i in range(300)]}]
    got = features(spark, amenities=amenities, items=[f"word {i}" for i in range(50)], details=[f"more {i}" for i in range(30)])
    assert len(got["amenities_has_text"].split(" | ")) == 300
    assert "word 49" in got["custom_text_blob"] and got["custom_text_blob"].count("more") == 30


# --- prices -----------------------------------------------------------------------------------
PRICE = "price_per_night double, initial_price_per_night double, price_without_fees double, total_price double, " \
        "airbnb_service_fee double, cleaning_fee double, taxes double, special_offer double, num_of_nights int"


@pytest.mark.parametrize(
    "row, expected",
    [
        ((12.345, 9.0, 8.0, 100.0, 0.0, 0.0, 0.0, 0.0, 2), 12.35),
        ((None, 9.0, 8.0, 100.0, 0.0, 0.0, 0.0, 0.0, 2), 9.0),
        ((None, None, 9.0, 100.0, 0.0, 0.0, 0.0, 0.0, 2), 4.5),
        ((None, None, None, 100.0, 5.0, 10.0, 5.0, -20.0, 2), 50.0),
        ((None, None, None, 100.005, 200.0, 0.0, 0.0, 0.0, 2), 100.005),
        ((None, None, None, 100.0, None, 0.0, 0.0, 0.0, 4), 25.0),
        ((None, None, None, None, 0.0, 0.0, 0.0, 0.0, 0), None),
    ],
)
def test_price_rules(spark, row, expected):
    assert one(pricing.derive_nightly_price(spark.createDataFrame([row], PRICE)))["price_per_night"] == expected


def test_currency(spark):
    df = spark.createDataFrame([("EUR", 10.0), ("USD", 10.0), ("GBP", 10.0), (None, 10.0)], "currency string, price_per_night double")
    got = [(r["currency"], r["price_per_night"]) for r in pricing.prices_to_usd(df).collect()]
    assert got == [("USD", 10.8), ("USD", 10.0), ("GBP", 10.0), (None, 10.0)]
    strict = [r["price_per_night"] for r in pricing.prices_to_usd(df, unknown="null").collect()]
    assert strict == [10.8, 10.0, None, 10.0]


def test_imputation(spark):
    df = spark.createDataFrame([("FR", 1.0), ("FR", None), ("DE", None), (None, None), (None, 4.0)], "addr_cc string, hosts_year double")
    got = sorted((r["addr_cc"] or "", r["hosts_year"]) for r in pricing.impute(df, ["hosts_year"]).collect())
    assert got == [("", 2.5), ("", 4.0), ("DE", 2.5), ("FR", 1.0), ("FR", 1.0)]


# --- scores -------------------------------------------------------------------------------------
SCORED = "property_id int, addr_cc string, price_per_night double, guests int, ratings double, property_number_of_reviews int, " \
         "rating_value double, is_guest_favorite int, host_rating double, host_number_of_reviews int, host_response_rate double, " \
         "hosts_year int, is_supperhost int"


def test_scores(spark):
    df = spark.createDataFrame(
        [
            (1, "FR", 100.0, 2, 5.0, 10, 5.0, 1, 5.0, 10, 100.0, 10, 1),
            (2, "FR", 200.0, 2, 4.0, 0, 4.0, 0, None, None, None, None, None),
            (3, "FR", 100.0, 0, None, None, None, None, 3.0, 5, 50.0, 5, 0),
            (4, None, 80.0, 2, 4.0, 3, 4.0, 0, 4.0, 3, 90.0, 2, 0),
            (5, None, 40.0, 2, 4.0, 3, 4.0, 0, 4.0, 3, 90.0, 2, 0),
            (6, "DE", 70.0, 2, 4.0, 3, 4.0, 0, 4.0, 3, 90.0, 2, 0),
        ],
        SCORED,
    )
    got = {r["property_id"]: r for r in scoring.listing_scores(df).collect()}
    assert (got[1]["price_score"], got[2]["price_score"], got[3]["price_score"]) == (0.5, 0.0, 1.0)
    assert (got[4]["price_score"], got[5]["price_score"]) == (0.0, 1.0)  # no country is one group
    assert got[6]["price_score"] == 0.0  # alone in its country
    assert got[1]["property_quality"] == pytest.approx(1.0)
    assert got[2]["property_quality"] == pytest.approx(0.4)
    assert got[1]["host_quality"] == pytest.approx(0.6 + 0.1 + 0.1 + 0.2 * 0.5)
    assert got[2]["host_quality"] == pytest.approx(0.3)
    for r in got.values():
        assert 0 <= r["price_score"] <= 1 and 0 <= r["property_quality"] <= 1 and -0.1 <= r["host_quality"] <= 0.9
    strict = {r["property_id"]: r["price_score"] for r in scoring.listing_scores(df, null_ppg=True).collect()}
    assert strict[3] == 0.0 and strict[1] == 1.0


def test_budget_rank(spark):
    df = spark.createDataFrame([("Budget",), ("Luxury",), ("odd",), (None,)], "budget_level string")
    assert [r["budget_rank"] for r in scoring.city_scores(df).collect()] == [1, 3, None, None]


# --- preferences ------------------------------------------------------------------------------------
def test_weights():
    assert ranking.normalise_weights({"a": 1, "b": 3, "c": -2, "d": None, "e": 0}) == {"a": 0.25, "b": 0.75}
    assert ranking.normalise_weights({}) == {}
    prefs = Preferences(price=1, env={"env_food": 1, "env_food_norm": 2, "env_health": -5})
    assert prefs.weights() == {"price_score": 0.25, "env_food_norm": 0.75}
    assert Preferences(budget_pref="Mid").budget_level() == "Mid-range"
    assert Preferences(temp_pref=20, travel_month=13).temperature_column() is None


def test_rank(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 20.0, "Budget", 0.3), (2, 0.5, None, None, 0.1), (3, None, 60.0, "Luxury", 0.2), (4, 0.5, 20.0, "odd", None)],
        "property_id int, price_score double, temp_avg_m07 double, budget_level string, l2_dist double",
    )
    assert [r["property_id"] for r in ranking.rank(df, Preferences(price=2), 4).collect()] == [2, 1, 4, 3]
    prefs = Preferences(temp=1, temp_pref=25.0, travel_month=7, budget=1, budget_pref="mid")
    got = {r["property_id"]: r["final_score"] for r in ranking.rank(df, prefs, 9).collect()}
    assert got == {1: pytest.approx(0.5 * 0.8 + 0.5 * 0.5), 2: 0.0, 3: pytest.approx(0.25), 4: pytest.approx(0.4)}
    assert {r["final_score"] for r in ranking.rank(df, Preferences(), 9).collect()} == {0.0}
    raw_weights = Preferences(price=4, normalise=False)
    assert ranking.rank(df, raw_weights, 1).first()["final_score"] == 2.0


def test_request_checks():
    assert ranking.check_request(" 7 ", " fr ") == ("7", "FR")
    for bad in ((None, "FR"), ("7", ""), ("7", "XX")):
        with pytest.raises(ValueError):
            ranking.check_request(*bad)


# --- browsing and reports -------------------------------------------------------------------------------
def test_filters_and_labels(spark):
    df = spark.createDataFrame(
        [(1, "FR", "Paris ", 4.0, 90.5, "A"), (2, " fr", "Lyon", None, 50.0, None), (3, "DE", "Ulm", 5.0, None, "C")],
        "property_id int, addr_cc string, addr_name string, ratings double, price_per_night double, listing_title string",
    )

    def ids(**filters):
        return sorted(r["property_id"] for r in browsing.filter_listings(df, **filters).collect())

    assert ids() == [1, 2, 3] and ids(country="fr") == [1, 2] and ids(city="Paris") == [1]
    assert ids(rating=(None, 4.5)) == [1] and ids(price=(50, None)) == [1, 2]
    assert browsing.browse(df, limit=0).count() == 1
    assert [r["property_id"] for r in browsing.search(df, "90.5").collect()] == [1]
    labels = {r["property_id"]: r["label"] for r in browsing.with_label(df).collect()}
    assert labels[3] == "C — Ulm (DE) | $None | ⭐ 5.0"
    assert [r["addr_cc"] for r in browsing.country_choices(df).collect()] == ["DE", "FR"]


def test_reports(spark):
    df = spark.createDataFrame([(float(i), None, "x" * i) for i in range(1, 9)] + [(1000.0, None, None)], "price double, empty double, note string")
    report = {r["feature"]: r for r in profiling.distribution_report(df).collect()}
    assert set(report) == {"price", "len_note"}
    assert (report["price"]["q25"], report["price"]["median"], report["price"]["outliers"]) == (3.0, 5.0, 1)
    everything = profiling.distribution_report(df, skip_all_null=False)
    assert everything.where("feature = 'empty'").first()["outliers"] == 0
    missing = profiling.missing_values(df).collect()
    assert [(r["column"], r["missing"], r["missing_pct"]) for r in missing] == [("empty", 9, 100.0), ("note", 1, 11.11)]
    same = spark.createDataFrame([(5.0,)] * 4 + [(5.02,)], "v double")
    assert one(profiling.distribution_report(same))["outliers"] == 1
    bins = profiling.histogram(df, "price", 10).collect()
    assert sum(r["n_rows"] for r in bins) == 9 and max(r["bin"] for r in bins) == 9


def test_report_has_exact_quartiles_of_many_values(spark):
    """A sketch of 400,000 values is off by some ranks."""
    df = spark.range(400_000, numPartitions=8).select((F.pmod(F.col("id") * 7919, F.lit(400_000)) + 1.0).alias("v"))
    found = one(profiling.distribution_report(df))
    assert (found["q25"], found["median"], found["q75"]) == (100_000.0, 200_000.0, 300_000.0)


def test_sizes_of_countries(spark):
    df = spark.createDataFrame([(c,) for c, n in (("A", 60), ("B", 50), ("C", 49), ("D", 70)) for _ in range(n)], "addr_cc string")
    got = {(r["size"], r["addr_cc"]) for r in coverage.smallest_and_largest(df, n=2).collect()}
    assert got == {("smallest", "B"), ("smallest", "A"), ("largest", "D"), ("largest", "A")}


def test_continents(spark):
    table = coverage.continent_table(spark, {"africa": ["EG", "MA"], "asia": ["EG", "JP"]})
    df = spark.createDataFrame([("EG",), ("JP",), ("XX",), (None,)], "addr_cc string")
    got = {r["continent"]: r["n_rows"] for r in coverage.continent_counts(df, table).collect()}
    assert got == {"africa": 1, "asia": 1, "unknown": 1}
    assert math.isclose(coverage.city_sparsity(df, table).where("continent = 'asia'").first()["coverage_pct"], 100.0)
    assert one(spark.range(1).select(coverage.canonical_continent(F.lit(" Central-America ")).alias("c"))) == {"c": "north_america"}
