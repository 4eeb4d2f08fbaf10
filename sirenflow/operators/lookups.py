"""Boxes, searches, tile cover, ordered unions and run history (FLT-01..03, FLT-08, FN-03, SET-01, SET-03, SPJ-04, SPJ-15, WIN-07, JN-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenflow.functions import geo
from sirenflow.functions.text import civic_address
from sirenflow.operators.spatial import with_zone
from sirenflow.operators.streets import touched_zones

CITY = (49.20, 49.39, -122.92, -122.70)  # south, north, west, east; fixed values
FOUND, SUGGESTED = 25, 6


def in_box(box: tuple[float, float, float, float], pad: float = 0.0, lat: str = "lat", lng: str = "lng") -> Column:
    """FLT-01: inclusive test for (south, north, west, east), widened by a share of its size; a null coordinate is outside."""
    s, n, w, e = box
    dy, dx = (n - s) * pad, (e - w) * pad
    return F.coalesce(F.col(lat).between(s - dy, n + dy) & F.col(lng).between(w - dx, e + dx), F.lit(False))


def in_city(points: DataFrame, boundary: DataFrame, out: str = "in_city") -> DataFrame:
    """SPJ-04: whether a point lies strictly inside the boundary (name, rings); FLT-02's box where the boundary has no row."""
    if boundary.isEmpty():
        return points.withColumn(out, in_box(CITY))
    got = with_zone(points, boundary.select(F.col("name").alias("map_name"), "rings"), out="__b", strict=True)
    return got.withColumn(out, F.col("__b").isNotNull()).drop("__b")


def lines_in_city(lines: DataFrame, boundary: DataFrame, key: str, out: str = "in_city") -> DataFrame:
    """SPJ-04 for geometries: (key, in_city): whether any point of a line meets the boundary's area, its outline included.

    Lines: key, points (array of x, y; one point is a place). Null points are left out; a line without points is outside.
    Without a boundary row, FLT-02's box has to hold one of its points.
    """
    one = lines.select(key, F.explode_outer(F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())).alias("p"))
    if boundary.isEmpty():
        hit = one.select(key, F.col("p.y").alias("lat"), F.col("p.x").alias("lng")).withColumn("hit", in_box(CITY))
        return hit.groupBy(key).agg(F.max("hit").alias(out))
    met = touched_zones(lines.select(F.col(key).alias("closure_id"), "points"), boundary.select(F.col("name").alias("map_name"), "rings"))
    return lines.select(key).distinct().join(met.select(F.col("closure_id").alias(key), F.lit(True).alias("hit")).distinct(), key, "left").select(key, F.coalesce("hit", F.lit(False)).alias(out))


def address_search(parcels: DataFrame, text: str) -> DataFrame:
    """FLT-03: addresses that contain the text in any case, by address; 25 is the feature."""
    return parcels.where(F.contains(F.lower("address"), F.lit(text.lower()))).orderBy("address", "parcel_id").limit(FOUND)


def address_suggestions(parcels: DataFrame, text: str) -> DataFrame:
    """FLT-03: civic addresses of the found ones, each once, in order; 6 is the feature."""
    found = address_search(parcels, text).select(civic_address(F.col("address")).alias("address"))
    return found.distinct().orderBy("address").limit(SUGGESTED)


def active_closures(c: DataFrame) -> DataFrame:
    """FLT-08: active closures, newest update first, with the own zone where no affected zones are known."""
    own = F.when(F.col("zone_id").isNotNull(), F.array("zone_id"))
    return c.where("active").withColumn("affected_zones", F.coalesce(F.when(F.size("affected_zones") > 0, F.col("affected_zones")), own)).orderBy(F.desc_nulls_last("updated_at"), "closure_id")


def tile_cover(boxes: DataFrame, low: int, high: int) -> DataFrame:
    """FN-03: (name, z, x, y): tiles that cover each box (name, south, north, west, east) for the zooms low to high."""
    t = boxes.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))
    nw, se = geo.tile_of(F.col("north"), F.col("west"), F.col("z")), geo.tile_of(F.col("south"), F.col("east"), F.col("z"))
    return t.select("name", "z", F.explode(F.sequence(nw["x"], se["x"])).alias("x"), nw["y"].alias("y0"), se["y"].alias("y1")).select("name", "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def missing_tiles(required: DataFrame, present: DataFrame) -> DataFrame:
    """SET-03: required tiles (z, x, y) that are not present."""
    return required.select("z", "x", "y").distinct().join(present.select("z", "x", "y"), ["z", "x", "y"], "left_anti")


def ordered_union(*lists: DataFrame) -> DataFrame:
    """SET-01: (term, list, rank): each term of lists (term, rank) with its place in the first list that has it."""
    every = None
    for i, t in enumerate(lists):
        one = t.select("term", F.struct(F.lit(i).alias("list"), "rank").alias("p"))
        every = one if every is None else every.unionByName(one)
    return every.where("term is not null").groupBy("term").agg(F.min("p").alias("p")).select("term", "p.list", "p.rank")


def uncovered(intersections: DataFrame, zones: DataFrame, boundary: DataFrame) -> DataFrame:
    """SPJ-15: intersections inside the city that no zone holds."""
    return in_city(with_zone(intersections, zones), boundary).where("in_city and zone_id is null").drop("in_city")


def run_history(history: DataFrame, value: str = "wer") -> DataFrame:
    """WIN-07: every run with its change to the model's run before and whether it is the model's latest; ties by sample count."""
    w = Window.partitionBy("model_version").orderBy("created_at", "total_samples")
    return history.withColumns({"change": F.col(value) - F.lag(value).over(w), "latest": F.lead(F.lit(True)).over(w).isNull()})


def orphans(rows: DataFrame, main: DataFrame, key: str) -> DataFrame:
    """JN-13: rows whose key the main table lacks; rows without a key are left out."""
    return rows.where(F.col(key).isNotNull()).join(main.select(key), key, "left_anti")
