"""Geometry and tile arithmetic as column expressions. x is longitude, y latitude."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = EARTH_M * pi / 180
EDGE = 1e-9
SEGMENT = ("x1", "y1", "x2", "y2")
MERCATOR_M = pi * 6_378_137.0  # half the width of the EPSG:3857 plane


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """FN-01: great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def rounded(v: Column, digits: int) -> Column:
    """Halves away from zero at ``digits`` decimals of the double itself, as SQL engines round; Spark's own round takes the shortest decimal text that names it."""
    return F.round(v * float(10**digits), 0) / float(10**digits)


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def ring_edges(rings: Column) -> Column:
    """Edges struct(x1, y1, x2, y2) of rings given as array<array<struct<x, y>>>; open rings are closed."""
    one = lambda r: F.transform(r, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(r, (i + 1) % F.size(r))["x"].alias("x2"), F.get(r, (i + 1) % F.size(r))["y"].alias("y2")))
    return F.flatten(F.transform(rings, one))


def on_edge(x: Column, y: Column, edges: Column) -> Column:
    """Whether the point lies on an edge, within 1e-9 degrees."""
    def touches(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        inside = x.between(F.least(e["x1"], e["x2"]) - EDGE, F.greatest(e["x1"], e["x2"]) + EDGE) & y.between(F.least(e["y1"], e["y2"]) - EDGE, F.greatest(e["y1"], e["y2"]) + EDGE)
        return inside & (F.abs(dx * (y - e["y1"]) - dy * (x - e["x1"])) <= EDGE * F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(EDGE)))

    return F.exists(edges, touches)


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Crossing-count parity; holes are rings like any other."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def edge_distance_m(x: Column, y: Column, edges: Column) -> Column:
    """Metres to the nearest edge on a local equirectangular plane."""
    k = F.cos(F.radians(y)) * DEGREE_M

    def dist(e: Column) -> Column:
        ax, ay, bx, by = (e["x1"] - x) * k, (e["y1"] - y) * DEGREE_M, (e["x2"] - x) * k, (e["y2"] - y) * DEGREE_M
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / n))).otherwise(0.0)
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    return F.array_min(F.transform(edges, dist))


def with_nearest(met: DataFrame) -> DataFrame:
    """``met`` (px, py, x1..y2) with t, the closest place on the segment, and dist_m, in plain columns of a local plane.

    Coordinates are far larger than distances, so the order of the operations shows in the last decimals: it is that of the registered SQL.
    """
    k, dx, dy = F.cos(F.radians("py")), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = (dx * k) * (dx * k) + dy * dy
    along = (F.col("px") - F.col("x1")) * k * dx * k + (F.col("py") - F.col("y1")) * dy
    m = met.withColumn("t", F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / n))).otherwise(0.0))
    east, north = (F.col("x1") + F.col("t") * dx - F.col("px")) * k * DEGREE_M, (F.col("y1") + F.col("t") * dy - F.col("py")) * DEGREE_M
    return m.withColumn("dist_m", F.sqrt(east * east + north * north))


def tile_of(lat: Column, lng: Column, zoom: Column) -> Column:
    """FN-02: struct(x, y) of the XYZ tile; integer parts are truncated."""
    n = F.pow(F.lit(2.0), zoom)
    r = F.radians(lat)
    return F.struct(((lng + 180.0) / 360.0 * n).cast("long").alias("x"), ((1.0 - F.asinh(F.tan(r)) / F.lit(pi)) / 2.0 * n).cast("long").alias("y"))


def tms_row(y: Column, zoom: Column) -> Column:
    """FN-02: row counted from the south."""
    return F.pow(F.lit(2.0), zoom).cast("long") - 1 - y


def tile_corner(x: Column, y: Column, zoom: Column) -> Column:
    """FN-02, the inverse: struct(lat, lng) of a tile's north-west corner."""
    n = F.pow(F.lit(2.0), zoom)
    return F.struct(F.degrees(F.atan(F.sinh(F.lit(pi) * (1 - 2 * y / n)))).alias("lat"), (x / n * 360.0 - 180.0).alias("lng"))


def tile_box_m(x: Column, y: Column, zoom: Column) -> Column:
    """FN-02: struct(west, south, east, north) of a tile in metres of EPSG:3857."""
    size = F.lit(2 * MERCATOR_M) / F.pow(F.lit(2.0), zoom)
    west, north = x * size - MERCATOR_M, F.lit(MERCATOR_M) - y * size
    return F.struct(west.alias("west"), (north - size).alias("south"), (west + size).alias("east"), north.alias("north"))


def geometry(pairs: Column) -> Column:
    """FN-05: struct(type, coordinates) from array<struct<lat, lng>>; null pairs are dropped, none is null."""
    ok = F.transform(F.filter(pairs, lambda p: p["lat"].isNotNull() & p["lng"].isNotNull()), lambda p: F.array(p["lng"], p["lat"]))
    return F.when(F.size(ok) > 0, F.struct(F.when(F.size(ok) == 1, "Point").otherwise("LineString").alias("type"), ok.alias("coordinates")))
