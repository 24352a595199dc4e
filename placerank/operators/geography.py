"""Where listings are and what is near them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.constants import (
    EARTH_RADIUS_M,
    ELEMENT_KINDS,
    ENV_GROUPS,
    GROUP_PRIORITY,
    METRES_PER_DEGREE,
    POI_CLASSES,
    RADIUS_M,
    SAMPLE_STEP,
)
from placerank.functions.expressions import column_safe
from placerank.functions.grid import Grid, TileGrid, haversine_sql, level_of, on_level
from placerank.sources.scratch import written

# Cells of the radius join have about half the radius; their sides are halved twice.
_STEP = 0.005
_FINEST = 2
# Single points are kept beside the tiles, one level further down.
_SINGLE = _FINEST + 1
_SLACK = 1e-9


# --- points of interest near a listing ---------------------------------------
def clean_poi_groups(pois: DataFrame) -> DataFrame:
    """Coordinates and the lower-case group of usable points of interest."""
    return (
        pois.select(
            "addr_cc",
            F.col("lat").cast("double").alias("p_lat"),
            F.col("lon").cast("double").alias("p_lon"),
            F.lower(F.trim("poi_group")).alias("poi_group"),
        )
        .dropna(subset=["p_lat", "p_lon", "poi_group"])
        .where(F.col("poi_group") != "")
    )


def _radius_grid(radius_m: float) -> TileGrid:
    """Cells between a half and the whole of the radius, and those of 0.005 degrees at least."""
    doublings = math.ceil(math.log2(max(radius_m / (2 * METRES_PER_DEGREE * _STEP), 1.0)))
    return TileGrid(_STEP * 2**doublings)


def _pyramid(
    pois: DataFrame, groups: Sequence[str], keys: Sequence[str], grid: TileGrid
) -> DataFrame:
    """Counts per group of every tile that holds points, of all levels, and of every single point.

    Points at one coordinate are one row, so copies collapse; only these rows have ``p_lat``
    and ``p_lon``.  Tiles are summed before they are dealt out.
    """
    names = [column_safe(g) for g in groups]
    counts = [f"count_if(poi_group = '{g}') as `{n}`" for g, n in zip(groups, names)]
    points = written(
        clean_poi_groups(pois)
        .where(F.col("poi_group").isin(list(groups)))
        .groupBy(*keys, "p_lat", "p_lon")
        .agg(*map(F.expr, counts)),
        "points",
    )
    tiles = ", ".join(grid.tile("p_lat", "p_lon", level) for level in range(_FINEST + 1))
    totals = (
        points.selectExpr(*keys, f"explode(array({tiles})) as at", *[f"`{n}`" for n in names])
        .groupBy(*keys, "at")
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumns({"p_lat": F.lit(None).cast("double"), "p_lon": F.lit(None).cast("double")})
    )
    single = points.withColumn("at", F.expr(_single(grid.tile("p_lat", "p_lon", _FINEST))))
    return totals.unionByName(single)


def _single(tile: str) -> str:
    """The key of the points of a finest tile, from that of the tile."""
    return f"({tile} + shiftleft(1L, 52))"


def _placed(radius_m: float, inside: str, edge: str) -> str:
    """``inside`` or ``edge`` by a tile's bounds against box and circle; an empty array outside.

    Both verdicts are conservative by a relative 1e-9, so points need no further test.  Half a
    turn away is farthest, so beyond it a tile's bounds say nothing.
    """
    limit = math.sin(radius_m / (2 * EARTH_RADIUS_M)) ** 2
    far_lon = "greatest(lon_hi - lon, lon - lon_lo)"

    def chord(dlat: str, dlon: str, beyond: str, cos_other: str) -> str:
        turn = f"if({far_lon} > 180D, {beyond}, power(sin(radians({dlon}) / 2), 2))"
        return f"(power(sin(radians({dlat}) / 2), 2) + cos_lat * cos(radians({cos_other})) * {turn})"

    least = chord(
        "greatest(0D, lat_lo - lat, lat - lat_hi)", "greatest(0D, lon_lo - lon, lon - lon_hi)",
        "0D", "least(90D, greatest(lat_hi, -lat_lo))",
    )
    most = chord(
        "greatest(lat_hi - lat, lat - lat_lo)", far_lon, "1D", "greatest(0D, lat_lo, -lat_hi)"
    )
    missed = (
        "lat_hi < lat - dlat or lat_lo > lat + dlat or lon_hi < lon - dlon or lon_lo > lon + dlon"
    )
    boxed = (
        "lat_lo >= lat - dlat and lat_hi <= lat + dlat"
        " and lon_lo >= lon - dlon and lon_hi <= lon + dlon"
    )
    return (
        f"case when {missed} then array()"
        f" when {least} > {limit * (1 + _SLACK)!r}D then array()"
        f" when {boxed} and {most} <= {limit * (1 - _SLACK)!r}D then {inside}"
        f" else {edge} end"
    )


def _cover(places: DataFrame, radius_m: float, grid: TileGrid) -> DataFrame:
    """Tiles that make up the circle around every place, large ones first, as rows of ``at``.

    Only tiles on the rim are cut in quarters.  What is still on the rim at the finest level
    stands for its single points.  Nothing is shuffled and no data looked at.  All levels but
    the first are free of ``transform``, which Spark interprets row by row.
    """
    names = places.columns

    def listed(tiles: Sequence[str], whole: str) -> str:
        return f"array({', '.join(f"named_struct('at', {t}, 'whole', {whole})" for t in tiles)})"

    rows = places.selectExpr("*", "cos(radians(lat)) as cos_lat").selectExpr(
        "*", f"explode({grid.cells('lat', 'lon', 'dlat', 'dlon')}) as at", "false as whole"
    )
    for level in range(_FINEST + 1):
        rows = rows.selectExpr(*names, "cos_lat", "at", "whole", f"{grid.width('at', level)} as width")
        bounds = [f"{sql} as {name}" for name, sql in grid.bounds("at", "width", level, _SLACK).items()]
        itself = listed(["at"], "true")
        edge = listed([_single("at")] if level == _FINEST else grid.quarters("at", level), "false")
        tiles = f"if(whole, {itself}, {_placed(radius_m, itself, edge)})"
        rows = rows.selectExpr("*", *bounds).selectExpr(*names, "cos_lat", f"explode({tiles}) as tile")
        rows = rows.selectExpr(*names, "cos_lat", "tile.at", "tile.whole")
    return rows.select(*names, "at")


def count_nearby(
    listings: DataFrame,
    pois: DataFrame,
    groups: Sequence[str] = tuple(ENV_GROUPS),
    radius_m: float = RADIUS_M,
    cross_border: bool = False,
) -> DataFrame:
    """``env_<group>`` counts per distinct place: (``addr_cc``, ``lat``, ``lon``).

    Listings at one coordinate are one place and points at one coordinate are one row with
    counts, so copies on either side are never paired.  Points are summed up in a pyramid of
    tiles.  A place's circle is made up of tiles as large as fit: a tile wholly inside adds its
    total at its own level, and only the points of the finest tiles on the rim are measured one
    by one.  So a place meets about sixty tiles and the points of as many, however many are
    near.  Tiles and points are one table and places meet it in one equi-join, which adaptive
    execution splits where it is dense; sums are begun before they are dealt out by place.
    Points and their pyramid are written once each, so it runs jobs when called; what places
    meet is not written.  Only the named groups are counted; a point of another group has no
    column.
    """
    keys = [] if cross_border else ["addr_cc"]
    grid = _radius_grid(radius_m)
    pyramid = written(_pyramid(pois, groups, keys, grid), "pyramid")
    names = [column_safe(g) for g in groups]
    place = ["addr_cc", "lat", "lon"]

    places = (
        listings.selectExpr("addr_cc", "cast(lat as double) as lat", "cast(long as double) as lon")
        .dropna(subset=["lat", "lon", *keys])
        .distinct()
        # A place becomes a hundred rows, so few places are many tasks' work.
        .repartition(int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lat", "lon")
        .selectExpr(
            "*",
            f"{radius_m / METRES_PER_DEGREE!r}D as dlat",
            f"{radius_m}D / ({METRES_PER_DEGREE}D * cos(radians(lat))) as dlon",
        )
    )
    boxed = "p_lat between lat - dlat and lat + dlat and p_lon between lon - dlon and lon + dlon"
    close = f"{haversine_sql('lat', 'lon', 'p_lat', 'p_lon', EARTH_RADIUS_M)} <= {radius_m}D"
    totals = [f"cast(sum(`{n}`) as int) as `env_{n}`" for n in names]
    return (
        _cover(places, radius_m, grid).hint("merge")
        .join(pyramid, ["at", *keys])
        .where(f"p_lat is null or ({boxed} and {close})")
        .groupBy(*place)
        .agg(*map(F.expr, totals))
    )


def count_nearby_long(
    listings: DataFrame, pois: DataFrame, groups: Sequence[str] = tuple(ENV_GROUPS), **options
) -> DataFrame:
    """(``property_id``, ``poi_group``, ``n_places``) for counts above zero."""
    wide = attach_environment(
        listings.select("property_id", "addr_cc", "lat", "long"), pois, groups, **options
    )
    pairs = ", ".join(f"'{g}', env_{column_safe(g)}" for g in groups)
    return wide.selectExpr(
        "property_id", f"stack({len(groups)}, {pairs}) as (poi_group, n_places)"
    ).where("n_places > 0")


def attach_environment(
    listings: DataFrame, pois: DataFrame, groups: Sequence[str] = tuple(ENV_GROUPS), **options
) -> DataFrame:
    """All ``env_*`` columns beside every listing; 0 where nothing is near.

    The counts, a row for each place with something near, are written, so what reads the result
    twice does not count twice.
    """
    counts = written(count_nearby(listings, pois, groups, **options), "nearby")
    env = [f"env_{column_safe(g)}" for g in groups]
    at = counts.select(
        F.col("addr_cc").alias("at_cc"), F.col("lat").alias("at_lat"),
        F.col("lon").alias("at_lon"), *env,
    )
    same = (
        F.col("addr_cc").eqNullSafe(F.col("at_cc"))
        & (F.col("lat").cast("double") == F.col("at_lat"))
        & (F.col("long").cast("double") == F.col("at_lon"))
    )
    return (
        listings.join(at, same, "left").drop("at_cc", "at_lat", "at_lon").fillna(0, subset=env)
    )


def complete_environment(df: DataFrame, groups: Sequence[str] = tuple(ENV_GROUPS)) -> DataFrame:
    """Missing environment columns added as 0 and nulls filled, so the schema is fixed."""
    env = [f"env_{column_safe(g)}" for g in groups]
    absent = {c: F.lit(0) for c in env if c not in df.columns}
    return df.withColumns(absent).fillna(0, subset=env)


# --- city facts ----------------------------------------------------------------
def join_cities(listings: DataFrame, cities: DataFrame) -> DataFrame:
    """City facts beside every listing by country and city name.

    Cities are reduced to one row per key first, so the join adds no rows.
    Catalyst broadcasts the city side when its files are small enough.
    """
    keys = ["addr_cc", "addr_name"]
    renamed = cities.withColumnsRenamed(
        {"addr_admin1": "city_addr_admin1", "addr_admin2": "city_addr_admin2"}
    )
    rest = [c for c in renamed.columns if c not in keys]
    facts = (
        renamed.groupBy(*keys)
        .agg(F.min(F.struct(*rest)).alias("facts"))
        .select(*keys, "facts.*")
    )
    return listings.join(facts, keys, "left").select(
        *listings.columns, *[c for c in rest if c not in listings.columns]
    )


# --- nearest known place ---------------------------------------------------------
# Grid sizes of the search, from a city block of degrees to the whole sphere.
_LEVELS = [0.25, 1.0, 4.0, 16.0, 64.0, 360.0]


def _level_cells(lat: str, lon: str) -> str:
    """The cell of a point on each level, as an array."""
    cells = [
        on_level(level, Grid(step).cell(lat, lon))
        for level, step in enumerate(_LEVELS)
    ]
    return f"array({', '.join(cells)})"


def _search_cells(lat: str, lon: str) -> str:
    """Cells to search once a place is known to share the point's cell on ``level``.

    A cell's diagonal bounds the distance to that place, so every nearer place
    is in the box with that reach on all sides.  Columns are at most about twice
    as wide as bands are high, except where one column is a whole polar band;
    a reach of three steps covers both.  The step is a column, so the formula is
    written once for all levels.
    """
    top = f"cos(radians(least(abs({lat}) + reach, 90D)))"
    dlon = f"if({top} > reach / 180D, reach / {top}, 180D)"
    cells = Grid("step").touching(lat, lon, "reach", dlon)
    return f"transform({cells}, q -> {on_level('level', 'q')})"


def nearest_place(df: DataFrame, gazetteer: DataFrame, lat: str = "lat", lon: str = "long") -> DataFrame:
    """``addr_name``, ``addr_cc``, ``addr_admin1`` and ``addr_admin2`` of the nearest place.

    Each distinct coordinate looks up the finest level on which its own cell
    holds a known place.  That bounds the distance to the nearest one, so one
    equi-join on the cells within reach finds it exactly.  The level is found without
    dealing coordinates out by cell.  Only coordinates far from all places, which are
    few, search coarse cells; the join is a sort-merge join, as the size of an exploded
    side is not known beforehand.  Rows without usable coordinates get nulls.
    """
    names = ["name", "cc", "admin1", "admin2"]
    placed = (
        gazetteer.selectExpr("cast(lat as double) as g_lat", "cast(lon as double) as g_lon", *names)
        .dropna(subset=["g_lat", "g_lon"])
        .selectExpr("*", f"explode({_level_cells('g_lat', 'g_lon')}) as at")
    )
    spots = (
        df.selectExpr(f"try_cast(`{lat}` as double) as near_lat", f"try_cast(`{lon}` as double) as near_lon")
        .where("near_lat between -90 and 90 and near_lon between -180 and 180")
        .distinct()
    )
    # Cells of all levels are at most about 1.1 million, whatever the gazetteer holds.
    held = F.broadcast(placed.select("at").distinct())
    steps = ", ".join(f"{step!r}D" for step in _LEVELS)
    level = (
        spots.selectExpr("*", f"explode({_level_cells('near_lat', 'near_lon')}) as at")
        .join(held, "at", "left_semi")
        .groupBy("near_lat", "near_lon")
        .agg(F.expr(f"min({level_of('at')})").alias("level"))
        .selectExpr("*", f"element_at(array({steps}), level + 1) as step")
        .selectExpr("*", "least(3D * step, 180D) as reach")
    )
    distance = haversine_sql("near_lat", "near_lon", "g_lat", "g_lon", EARTH_RADIUS_M)
    order = f"struct(round({distance}, 3) as metres, {', '.join(names)})"
    nearest = (
        level.selectExpr(
            "near_lat", "near_lon", f"explode({_search_cells('near_lat', 'near_lon')}) as at"
        )
        .hint("merge")
        .join(placed, "at")
        .groupBy("near_lat", "near_lon")
        .agg(F.expr(f"min({order})").alias("place"))
        .selectExpr(
            "near_lat", "near_lon", "place.name as addr_name", "place.cc as addr_cc",
            "place.admin1 as addr_admin1", "place.admin2 as addr_admin2",
        )
    )
    same = F.expr(
        f"try_cast(`{lat}` as double) = near_lat and try_cast(`{lon}` as double) = near_lon"
    )
    return df.join(nearest, same, "left").drop("near_lat", "near_lon")


# --- classifying tagged elements ---------------------------------------------------
def _best_class(tags: Column) -> Column:
    """The class and group of the tag whose group comes first; ties keep tag order."""
    entries = []
    for (key, value), (poi_class, group) in POI_CLASSES.items():
        entries.append(F.lit(f"{key}={value}"))
        entries.append(
            F.struct(
                F.lit(GROUP_PRIORITY[group]).alias("priority"),
                F.lit(poi_class).alias("poi_class"),
                F.lit(group).alias("poi_group"),
            )
        )
    known = F.create_map(*entries)

    def ranked(tag: Column, position: Column) -> Column:
        match = F.try_element_at(known, F.concat(tag["key"], F.lit("="), tag["value"]))
        return F.when(
            match.isNotNull(),
            F.struct(
                match["priority"].alias("priority"), position.alias("position"),
                match["poi_class"].alias("poi_class"), match["poi_group"].alias("poi_group"),
            ),
        )

    return F.array_min(F.transform(F.map_entries(tags), ranked))


def classify_pois(elements: DataFrame) -> DataFrame:
    """``poi_class`` and ``poi_group`` of tagged elements; elements of no class are dropped."""
    return (
        elements.withColumn("best", _best_class(F.col("tags")))
        .where(F.col("best").isNotNull())
        .withColumns({"poi_class": F.col("best.poi_class"), "poi_group": F.col("best.poi_group")})
        .drop("best")
    )


def sample_elements(
    elements: DataFrame, step: int = SAMPLE_STEP, max_rows: int | None = None, key: str = "osm_id"
) -> DataFrame:
    """Every ``step``-th element by id, at most ``max_rows`` of them if given."""
    kept = elements.where(F.pmod(F.col(key), F.lit(step)) == 0)
    return kept if max_rows is None else kept.orderBy(key).limit(max_rows)


def keep_kinds(elements: DataFrame, kinds: Sequence[str] = tuple(ELEMENT_KINDS)) -> DataFrame:
    return elements.where(F.col("osm_type").isin(list(kinds)))
