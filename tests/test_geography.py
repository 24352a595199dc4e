"""Grid searches against brute force, on random and on awkward points."""

import math
import random

import numpy as np
import pytest

from placerank.constants import POI_CLASSES
from placerank.operators import geography

R, EARTH = 1000.0, 6371000.0


def metres(lat1, lon1, lat2, lon2):
    a = (
        math.sin(math.radians(lat2 - lat1) / 2) ** 2
        + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2))
        * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * EARTH * math.asin(min(1, math.sqrt(a)))


def near(listing, poi):
    lat, lon = listing[2], listing[3]
    dlat = R / 111000.0
    dlon = R / (111000.0 * math.cos(math.radians(lat)))
    return (
        lat - dlat <= poi[1] <= lat + dlat
        and lon - dlon <= poi[2] <= lon + dlon
        and metres(lat, lon, poi[1], poi[2]) <= R
    )


@pytest.mark.parametrize("base", [(0.0, 0.0), (48.0, 2.0), (-33.5, 151.0), (80.0, -179.995), (0.005, 179.999)])
def test_counts_equal_brute_force(spark, base):
    rng = random.Random(3)
    lat0, lon0 = base
    spread = 0.03 / math.cos(math.radians(lat0))

    def place():
        # A third of the coordinates are shared and some lie on cell borders.
        lat = lat0 + (rng.randrange(-30, 31) / 1000 if rng.random() < 0.4 else rng.uniform(-0.03, 0.03))
        lon = lon0 + (rng.randrange(-30, 31) / 1000 if rng.random() < 0.4 else rng.uniform(-spread, spread))
        return lat, lon

    listings = [(i, "FR" if i % 3 else "DE", *place()) for i in range(80)]
    listings += [(80 + i, "FR", lat0, lon0) for i in range(20)]
    pois = [("FR" if i % 4 else "DE", *place(), "food" if i % 2 else " Nature ") for i in range(900)]
    # Many distinct points in one small tile, so that whole tiles are counted.
    pois += [("FR", lat0 + rng.uniform(0, 4e-4), lon0 + rng.uniform(0, 4e-4), "food") for _ in range(500)]
    pois += [("FR", lat0 + 0.001, lon0 + 0.001, "food")] * 50
    pois += [("FR", None, 1.0, "food"), ("FR", lat0, lon0, ""), ("FR", lat0, lon0, None)]

    found = geography.attach_environment(
        spark.createDataFrame(listings, "property_id int, addr_cc string, lat double, long double"),
        spark.createDataFrame(pois, "addr_cc string, lat double, lon double, poi_group string"),
    )
    usable = [p for p in pois if p[1] is not None and p[3]]
    expected = {
        l[0]: tuple(
            sum(1 for p in usable if p[0] == l[1] and p[3].strip().lower() == g and near(l, p))
            for g in ("food", "nature", "health")
        )
        for l in listings
    }
    got = {
        r["property_id"]: (r["env_food"], r["env_nature"], r["env_health"])
        for r in found.select("property_id", "env_food", "env_nature", "env_health").collect()
    }
    assert got == expected
    assert sum(c[0] for c in expected.values()) > 1000


def test_listing_without_country_or_coordinates_counts_nothing(spark):
    listings = spark.createDataFrame(
        [(1, None, 48.0, 2.0), (2, "FR", None, 2.0), (3, "FR", 48.0, 2.0)],
        "property_id int, addr_cc string, lat double, long double",
    )
    pois = spark.createDataFrame([("FR", 48.0, 2.0, "food")], "addr_cc string, lat double, lon double, poi_group string")
    found = geography.attach_environment(listings, pois)
    assert {r["property_id"]: r["env_food"] for r in found.collect()} == {1: 0, 2: 0, 3: 1}
    abroad = geography.attach_environment(listings, pois, cross_border=True)
    assert {r["property_id"]: r["env_food"] for r in abroad.collect()} == {1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize("n_places", [1, 7, 300])
def test_nearest_place_equals_brute_force(spark, n_places):
    rng = np.random.default_rng(n_places)

    def points(n):
        lat = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
        return np.round(lat, 4), np.round(rng.uniform(-180, 180, n), 4)

    lat, lon = points(n_places)
    places = [(f"P{i}", "XX", "a", "b", float(lat[i]), float(lon[i])) for i in range(n_places)]
    lat, lon = points(400)
    spots = [(i, float(lat[i]), float(lon[i])) for i in range(400)]
    extremes = [(89.99, 0.0), (-90.0, 10.0), (90.0, -180.0), (0.0, 180.0), (0.0, -180.0), (85.0, 179.99)]
    spots += [(400 + i, *p) for i, p in enumerate(extremes)]
    found = geography.nearest_place(
        spark.createDataFrame(spots, "id int, lat double, long double"),
        spark.createDataFrame(places, "name string, cc string, admin1 string, admin2 string, lat double, lon double"),
    )
    for row in found.collect():
        distances = {p[0]: round(metres(row["lat"], row["long"], p[4], p[5]), 3) for p in places}
        assert row["addr_name"] is not None
        assert distances[row["addr_name"]] <= min(distances.values()) + 0.002


def test_bad_coordinates_have_no_place(spark):
    df = spark.createDataFrame([(1, "x", "2"), (2, None, "2"), (3, "95", "2"), (4, "48", "2")], "id int, lat string, long string")
    places = spark.createDataFrame(
        [("Paris", "FR", "IDF", None, 48.85, 2.35)],
        "name string, cc string, admin1 string, admin2 string, lat double, lon double",
    )
    got = {r["id"]: r["addr_cc"] for r in geography.nearest_place(df, places).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "FR"}


def test_classes_follow_group_priority_then_tag_order(spark):
    df = spark.createDataFrame(
        [
            (1, {"amenity": "cafe", "tourism": "museum"}),
            (2, {"shop": "bakery", "building": "yes"}),
            (3, {"amenity": "bench"}),
            (4, {"historic": "fort", "tourism": "viewpoint"}),
            (5, {}),
        ],
        "osm_id int, tags map<string,string>",
    )
    got = {r["osm_id"]: (r["poi_class"], r["poi_group"]) for r in geography.classify_pois(df).collect()}
    assert got[1] == ("museum", "Culture")
    assert got[2] == ("bakery", "Supplies")
    assert 3 not in got and 5 not in got
    assert got[4][1] == "Sightseeing"
    assert len(POI_CLASSES) == 72


def test_city_join_adds_no_rows(spark):
    listings = spark.createDataFrame([(1, "FR", "Paris"), (2, "FR", "Lyon"), (3, None, None)], "property_id int, addr_cc string, addr_name string")
    cities = spark.createDataFrame(
        [("FR", "Paris", "IDF", "Luxury"), ("FR", "Paris", "IDF", "Budget")],
        "addr_cc string, addr_name string, addr_admin1 string, budget_level string",
    )
    got = geography.join_cities(listings, cities)
    assert got.count() == 3
    assert {r["property_id"]: r["budget_level"] for r in got.collect()} == {1: "Budget", 2: None, 3: None}
    assert "city_addr_admin1" in got.columns


@pytest.mark.parametrize("base", [(0.0, 0.0), (52.3, 4.9), (89.99, 10.0), (-60.0, -179.999)])
def test_cover_is_the_circle(spark, base):
    """Tiles of a cover are inside, rim tiles hold the rest, and no point lies in two of them."""
    grid = geography._radius_grid(R)
    rng = random.Random(5)
    lat0, lon0 = base
    dlon = R / (111000.0 * math.cos(math.radians(lat0)))
    points = [(lat0 + rng.uniform(-0.012, 0.012), lon0 + rng.uniform(-1.3, 1.3) * min(dlon, 200)) for _ in range(2000)]
    points = [p for p in points if -90 <= p[0] <= 90]
    places = spark.createDataFrame([(lat0, lon0, R / 111000.0, dlon)], "lat double, lon double, dlat double, dlon double")
    cover = [r["at"] for r in geography._cover(places, R, grid).select("at").collect()]
    assert len(cover) == len(set(cover))
    whole = {at for at in cover if at >> 52 < geography._SINGLE}
    rim = set(cover) - whole
    if abs(lat0) < 70:
        assert 30 < len(whole) < 90 and 40 < len(rim) < 110
    tiles = [grid.tile("lat", "lon", level) for level in range(geography._FINEST + 1)]
    df = spark.createDataFrame(points, "lat double, lon double")
    rows = df.selectExpr("lat", "lon", f"array({', '.join(tiles)}) as tiles", f"{geography._single(tiles[-1])} as single").collect()
    for r in rows:
        inside = sum(at in whole for at in r["tiles"])
        assert inside + (r["single"] in rim) <= 1
        hit = near((0, "", lat0, lon0), ("", r["lat"], r["lon"]))
        assert inside <= hit and (not hit or inside or r["single"] in rim)


def test_one_join_and_nothing_written_of_what_places_meet(spark):
    listings = spark.createDataFrame([(1, "FR", 48.0, 2.0)], "property_id int, addr_cc string, lat double, long double")
    pois = spark.createDataFrame([("FR", 48.0, 2.0, "food")], "addr_cc string, lat double, lon double, poi_group string")
    plan = geography.count_nearby(listings, pois)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Generate ") == 4


@pytest.mark.parametrize("radius", [50.0, 1000.0, 25_000.0])
def test_other_radii(spark, radius):
    rng = random.Random(6)
    spread = radius / 111000 * 1.5
    pois = [("FR", 45 + rng.uniform(-spread, spread), 3 + rng.uniform(-spread, spread), "food") for _ in range(400)]
    found = geography.count_nearby(
        spark.createDataFrame([(1, "FR", 45.0, 3.0)], "property_id int, addr_cc string, lat double, long double"),
        spark.createDataFrame(pois, "addr_cc string, lat double, lon double, poi_group string"), radius_m=radius,
    ).first()
    reach = radius / (111000 * math.cos(math.radians(45)))
    expected = sum(
        abs(p[1] - 45) <= radius / 111000 and abs(p[2] - 3) <= reach and metres(45, 3, p[1], p[2]) <= radius for p in pois
    )
    assert found["env_food"] == expected > 0


def test_surroundings_are_counted_once_and_compiled(spark, capsys):
    """Counts come from a written table, and tiles of every level from compiled code."""
    listings = spark.createDataFrame([(1, "FR", 48.0, 2.0)], "property_id int, addr_cc string, lat double, long double")
    pois = spark.createDataFrame([("FR", 48.001, 2.001, "food")], "addr_cc string, lat double, lon double, poi_group string")
    found = geography.attach_environment(listings, pois)
    assert found.first()["env_food"] == 1
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    places = listings.selectExpr("addr_cc", "lat", "long as lon", "0.01D as dlat", "0.01D as dlon")
    cover = geography._cover(places, R, geography._radius_grid(R))
    cover.explain()
    steps = capsys.readouterr().out.splitlines()
    assert sum("Generate" in s for s in steps) == 4
    # Only the tiles of the first level are listed by functions of arrays, which Spark interprets.
    assert sum("Generate" in s and "lambda" not in s and "*(" in s for s in steps) == 3
