"""Registered queries of geocoding steps, places, lists, checks and parses, added to the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenflow.functions import geo, text
from sirenflow.functions import transcript as tr
from sirenflow.operators import dispatch, geocode, lookups, reports, spatial, streets, transcripts, upsert, views
from sirenflow.operators import junction_lookup as jl
from sirenflow.operators.lineage import saved
from sirenflow.plans.fixtures import HALLS, load, with_sql, zone_shapes
from sirenflow.plans.reference_queries import _HAV, _XING
from sirenflow.plans.street_queries import _TYPES, ORACLE, QUERIES, _calls, query
from sirenflow.sources import sinks
from sirenflow.streaming import changes as ch

__all__ = ["ORACLE", "QUERIES"]

_IN = """(SELECT map_name FROM zones z WHERE p.lng > x0 + 1e-9 AND p.lng < x0 + 0.044 - 1e-9 AND p.lat > y0 + 1e-9 AND p.lat < y0 + 0.038 - 1e-9
  AND NOT (k IN (7, 17) AND p.lng > x0 + 0.022 - 1e-9 AND p.lat > y0 + 0.019 - 1e-9) ORDER BY map_name::INT LIMIT 1)"""


@query(with_sql("zones", "parcels") + f" SELECT parcel_id, {_IN} AS zone_id FROM parcels p")
def strict_zones(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-02: parcels on an outline are in no zone."""
    return spatial.with_zone(load(spark, d, "parcels"), zone_shapes(load(spark, d, "zones")), strict=True).select("parcel_id", "zone_id")


_GRID = "CASE WHEN parcel_id % 3 = 0 THEN concat('GRID ', parcel_id % 30) WHEN parcel_id % 3 = 1 THEN concat('zone', parcel_id % 25 + 1) END"


@query(
    with_sql("zones", "parcels")
    + f""", p AS (SELECT *, regexp_replace({_GRID}, '^(GRID|ZONE)\\s*', '', 'i') AS g FROM parcels)
SELECT parcel_id, coalesce((SELECT p.lng > x0 + 1e-9 AND p.lng < x0 + 0.044 - 1e-9 AND p.lat > y0 + 1e-9 AND p.lat < y0 + 0.038 - 1e-9 AND NOT (k IN (7, 17) AND p.lng > x0 + 0.022 - 1e-9 AND p.lat > y0 + 0.019 - 1e-9) FROM zones WHERE map_name = g), false) AS in_grid FROM p"""
)
def points_in_grid(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-03: parcels against a grid they name."""
    return spatial.in_grid(load(spark, d, "parcels").withColumn("map_grid", F.expr(_GRID)), zone_shapes(load(spark, d, "zones"))).select("parcel_id", "in_grid")


def _boundary(spark: SparkSession, d: str) -> DataFrame:
    """Zone 7, an L-shaped one's neighbour, stands for the city."""
    return zone_shapes(load(spark, d, "zones")).where("map_name = '8'").select(F.col("map_name").alias("name"), "rings")


_CITY_BOX = "x BETWEEN x0 AND x0 + 0.044 AND y BETWEEN y0 AND y0 + 0.038 AND NOT (x > x0 + 0.022 AND y > y0 + 0.019)"


@query(
    with_sql("zones", "parcels")
    + """ SELECT parcel_id, p.lng > x0 + 1e-9 AND p.lng < x0 + 0.044 - 1e-9 AND p.lat > y0 + 1e-9 AND p.lat < y0 + 0.038 - 1e-9 AND NOT (p.lng > x0 + 0.022 - 1e-9 AND p.lat > y0 + 0.019 - 1e-9) AS in_city,
 p.lat BETWEEN 49.20 AND 49.39 AND p.lng BETWEEN -122.92 AND -122.70 AS in_box FROM parcels p, zones WHERE map_name = '8'"""
)
def city_points(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-04 for points and FLT-02."""
    got = lookups.in_city(load(spark, d, "parcels"), _boundary(spark, d))
    return got.select("parcel_id", "in_city", lookups.in_box(lookups.CITY).alias("in_box"))


# a line meets an L of two rectangles if its part in one of them is not empty
_CUT = """, r AS (SELECT x0 AS xa, x0 + 0.044 AS xb, y0 AS ya, y0 + 0.019 AS yb FROM zones WHERE map_name = '8' UNION ALL SELECT x0, x0 + 0.022, y0 + 0.019, y0 + 0.038 FROM zones WHERE map_name = '8'),
s AS (SELECT road_id, x1 + 0.00137 AS x1, y1 + 0.00171 AS y1, x2 + 0.00137 AS x2, y2 + 0.00171 AS y2 FROM segments),
c AS (SELECT road_id, greatest(0.0, CASE WHEN x1 = x2 THEN CASE WHEN x1 BETWEEN xa AND xb THEN 0 ELSE 2 END ELSE least((xa - x1) / (x2 - x1), (xb - x1) / (x2 - x1)) END, least((ya - y1) / (y2 - y1), (yb - y1) / (y2 - y1))) AS ta,
 least(1.0, CASE WHEN x1 = x2 THEN 1 ELSE greatest((xa - x1) / (x2 - x1), (xb - x1) / (x2 - x1)) END, greatest((ya - y1) / (y2 - y1), (yb - y1) / (y2 - y1))) AS tb FROM s, r)"""


@query(with_sql("segments", "zones") + _CUT + " SELECT road_id, max((tb >= ta)::INT) = 1 AS in_city FROM c GROUP BY road_id")
def city_lines(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-04 for lines."""
    p = lambda n: F.struct((F.col(f"x{n}") + 0.00137).alias("x"), (F.col(f"y{n}") + 0.00171).alias("y"))
    return lookups.lines_in_city(load(spark, d, "segments").select("road_id", F.array(p(1), p(2)).alias("points")), _boundary(spark, d), "road_id")


@query(with_sql("zones", "parcels") + f", p AS (SELECT parcel_id, lat + 0.05 AS lat, lng FROM parcels), q AS (SELECT *, {_IN.replace('> x0 + 1e-9', '>= x0 - 1e-9').replace('< x0 + 0.044 - 1e-9', '<= x0 + 0.044 + 1e-9').replace('> y0 + 1e-9', '>= y0 - 1e-9').replace('< y0 + 0.038 - 1e-9', '<= y0 + 0.038 + 1e-9').replace('0.022 - 1e-9', '0.022 + 1e-9').replace('0.019 - 1e-9', '0.019 + 1e-9')} AS zone_id FROM p) SELECT parcel_id FROM q WHERE zone_id IS NULL AND lat < 49.42 - 1e-9 AND lat > 49.19 AND lng > -122.93 AND lng < -122.69")
def uncovered_points(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-15: places inside a city that is larger than its zones, which none of them holds."""
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    city = spark.range(1).select(F.lit("city").alias("name"), F.array(F.array(p(-122.93, 49.19), p(-122.69, 49.19), p(-122.69, 49.42), p(-122.93, 49.42))).alias("rings"))
    return lookups.uncovered(load(spark, d, "parcels").select("parcel_id", (F.col("lat") + 0.05).alias("lat"), "lng"), zone_shapes(load(spark, d, "zones")), city).select("parcel_id")


@query(
    with_sql("parcels", "hydrants")
    + f""", n AS (SELECT parcel_id, object_id, {_HAV.format(a="p.lat", b="h.lat", c="p.lng", d="h.lng")} AS m FROM parcels p JOIN hydrants h ON abs(p.lat - h.lat) < 0.003 AND abs(p.lng - h.lng) < 0.0045),
r AS (SELECT parcel_id, object_id, round(m)::BIGINT AS dist_m, row_number() OVER (PARTITION BY parcel_id ORDER BY round(m)::BIGINT, object_id) AS rank FROM n WHERE round(m) <= 300)
SELECT parcel_id, object_id, dist_m, rank FROM r WHERE rank <= 3"""
)
def parcel_hydrants(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-13 for parcels without a ring or a route."""
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    return streets.parcel_hydrants(load(spark, d, "parcels").select("parcel_id", "lat", "lng", none.alias("ring"), none.alias("route")), load(spark, d, "hydrants"), "parcel_id")


_HALL_SQL = ", halls(hall_id, hlat, hlng) AS (VALUES " + ", ".join(f"('{h}', {a}::DOUBLE, {o}::DOUBLE)" for h, a, o in HALLS) + ")"


@query(
    with_sql("segments") + _HALL_SQL
    + f""", e AS (SELECT road_id, unnest([{{'lat': y1, 'lng': x1}}, {{'lat': y2, 'lng': x2}}]) AS e FROM segments), m AS (SELECT road_id, hall_id, e.lat AS lat, e.lng AS lng, {_HAV.format(a="hlat", b="e.lat", c="hlng", d="e.lng")} AS m FROM e, halls)
SELECT road_id AS request_id, concat('E', hall_id) AS unit, round(arg_min(lat, (m, lat, lng)), 9) AS lat, round(arg_min(lng, (m, lat, lng)), 9) AS lng FROM m GROUP BY road_id, hall_id"""
)
def nearest_ends(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-14: the end of every road nearest to each hall."""
    s = load(spark, d, "segments")
    e = lambda n: F.struct(F.col(f"x{n}").alias("lng"), F.col(f"y{n}").alias("lat"))
    ends = s.select(F.col("road_id").alias("request_id"), F.array(e(1), e(2)).alias("endpoints"))
    halls = spark.createDataFrame(HALLS, "hall_id string, hall_lat double, hall_lng double")
    units = s.select(F.col("road_id").alias("request_id")).crossJoin(F.broadcast(halls)).withColumn("unit", F.concat(F.lit("E"), "hall_id"))  # four halls
    return streets.nearest_end(units, ends).select("request_id", "unit", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"))


# shared stretches and loose ends beside the roads themselves
_LINES = """SELECT canon, x1, y1, x2, y2 FROM segments UNION ALL
 SELECT concat('SHARED', road_id), x1 + 0.25{d} * (x2 - x1), y1 + 0.25{d} * (y2 - y1), x1 + 0.75{d} * (x2 - x1), y1 + 0.75{d} * (y2 - y1) FROM segments WHERE road_id % 9 = 0 UNION ALL
 SELECT concat('LOOSE', road_id), (x1 + x2) / 2, (y1 + y2) / 2 + 0.0000101{d}, (x1 + x2) / 2 + 0.0000001{d}, (y1 + y2) / 2 + 0.0000151{d} FROM segments WHERE road_id % 7 = 0 AND x1 <> x2"""
_K = "cos(radians({p}y1))"
_SNAP_T = "greatest(0.0, least(1.0, coalesce((({p}x{i} - {q}x1) * {k} * ({q}x2 - {q}x1) * {k} + ({p}y{i} - {q}y1) * ({q}y2 - {q}y1)) / nullif((({q}x2 - {q}x1) * {k}) ** 2 + ({q}y2 - {q}y1) ** 2, 0), 0.0)))"


def _snap(p: str, q: str, i: int) -> str:
    k = _K.format(p=p)
    t = _SNAP_T.format(p=p, q=q, i=i, k=k)
    fx, fy = f"({q}x1 + {t} * ({q}x2 - {q}x1))", f"({q}y1 + {t} * ({q}y2 - {q}y1))"
    return f"{{'m': sqrt((({p}x{i} - {fx}) * {k}) ** 2 + ({p}y{i} - {fy}) ** 2) * 6371000.0 * pi() / 180, 'x': ({p}x{i} + {fx}) / 2, 'y': ({p}y{i} + {fy}) / 2}}"


_ON = "(({b}x{i} - ax1) * (ax2 - ax1) + ({b}y{i} - ay1) * (ay2 - ay1)) / n"
_OFF = "abs((bx{i} - ax1) * (ay2 - ay1) - (by{i} - ay1) * (ax2 - ax1)) <= 1e-9 * sqrt(n)"


@query(
    with_sql("segments")
    + f""", l AS ({_LINES.format(d="::DOUBLE")}), p AS (SELECT a.canon AS canon_a, b.canon AS canon_b, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM l a JOIN l b ON a.canon < b.canon
  AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) - 0.0001 AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) - 0.0001 AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) - 0.0001 AND greatest(b.y1, b.y2) >= least(a.y1, a.y2) - 0.0001),
q AS (SELECT *, (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1) AS det, (ax2 - ax1) ** 2 + (ay2 - ay1) ** 2 AS n FROM p),
x AS (SELECT *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / det AS t, ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / det AS u FROM q WHERE abs(det) > 1e-18),
s AS (SELECT *, greatest(0.0, least({_ON.format(b="b", i=1)}, {_ON.format(b="b", i=2)})) AS lo, least(1.0, greatest({_ON.format(b="b", i=1)}, {_ON.format(b="b", i=2)})) AS hi FROM q WHERE n > 0 AND {_OFF.format(i=1)} AND {_OFF.format(i=2)}),
m AS (SELECT DISTINCT canon_a, canon_b, round(ax1 + t * (ax2 - ax1), 6) AS x, round(ay1 + t * (ay2 - ay1), 6) AS y FROM x WHERE t BETWEEN -1e-9 AND 1 + 1e-9 AND u BETWEEN -1e-9 AND 1 + 1e-9
 UNION SELECT DISTINCT canon_a, canon_b, round(ax1 + (lo + hi) / 2 * (ax2 - ax1), 6), round(ay1 + (lo + hi) / 2 * (ay2 - ay1), 6) FROM s WHERE hi - lo >= -1e-9),
e AS (SELECT canon_a, canon_b, unnest([{_snap("a", "b", 1)}, {_snap("a", "b", 2)}, {_snap("b", "a", 1)}, {_snap("b", "a", 2)}]) AS e FROM p),
g AS (SELECT canon_a, canon_b, min(e) AS e FROM e WHERE e.m <= 2.0 GROUP BY ALL)
SELECT * FROM m UNION ALL SELECT canon_a, canon_b, round(e.x, 6), round(e.y, 6) FROM g WHERE (canon_a, canon_b) NOT IN (SELECT (canon_a, canon_b) FROM m)"""
)
def street_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-09 and SET-04: crossings, middles of shared stretches, and snaps of loose ends within 2 m."""
    return spatial.street_nodes(spark.sql(_LINES.format(d="D").replace("FROM segments", "FROM {segments}"), segments=load(spark, d, "segments")))


_ROADS = "road_id, CASE WHEN road_id % 11 = 0 THEN ' ' ELSE concat(' street', road_id % 40, '.') END AS roadname, CASE road_id % 3 WHEN 0 THEN 'Avenue' WHEN 1 THEN ' slip lane' END AS roadtype, x1, y1, x2, y2"


@query(
    with_sql("segments")
    + f""", r AS (SELECT {_ROADS} FROM segments), v(term, short) AS (VALUES ('AVENUE', 'AVE'), ('SLIP LANE', 'SLIP')),
c AS (SELECT *, trim(concat('STREET', road_id % 40, ' ', coalesce(short, upper(trim(coalesce(roadtype, '')))))) AS canon FROM r LEFT JOIN v ON term = upper(trim(roadtype)) WHERE trim(roadname) <> '')
SELECT canon, road_id, 0 AS part, 0 AS seq, x1, y1, (x1 + x2) / 2 AS x2, (y1 + y2) / 2 AS y2 FROM c UNION ALL SELECT canon, road_id, 0, 1, (x1 + x2) / 2, (y1 + y2) / 2, x2, y2 FROM c UNION ALL SELECT canon, road_id, 1, 0, x2, y2, x1, y2 FROM c"""
)
def street_lines(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18 and CLN-04: roads of two parts, one with a bend, under their canonical names."""
    p = lambda x, y: F.struct(F.expr(x).alias("lng"), F.expr(y).alias("lat"))
    r = load(spark, d, "segments").selectExpr(*_ROADS.split(", ")[:1], "CASE WHEN road_id % 11 = 0 THEN ' ' ELSE concat(' street', road_id % 40, '.') END AS roadname", "CASE road_id % 3 WHEN 0 THEN 'Avenue' WHEN 1 THEN ' slip lane' END AS roadtype", "x1", "y1", "x2", "y2")
    r = r.withColumn("lines", F.array(F.array(p("x1", "y1"), p("(x1 + x2) / 2", "(y1 + y2) / 2"), p("x2", "y2")), F.array(p("x2", "y2"), p("x1", "y2"))))
    vocabulary = spark.createDataFrame([("street_suffix", "avenue", "AVE", True), ("street_suffix", "SLIP LANE", "SLIP", True), ("street_suffix", "avenue ", "OLD", False)], "category string, term string, term_normalized string, is_active boolean")
    return streets.street_segments(r, vocabulary)


_PLACES = "parcel_id, house, CASE WHEN parcel_id % 3 = 0 THEN 'QUAY' ELSE street END AS street, lat, lng"


@query(
    with_sql("parcels")
    + """, p AS (SELECT house, street, arg_min(CASE WHEN parcel_id % 2 = 0 THEN lat + 0.0001 ELSE lat END, parcel_id) AS lat, arg_min(lng, parcel_id) AS lng FROM parcels GROUP BY ALL)
SELECT parcel_id AS request_id, 0 AS step, p.lat, p.lng, 100 AS confidence, NULL::VARCHAR AS note FROM parcels r JOIN p USING (house, street) WHERE parcel_id % 3 <> 0"""
)
def exact_parcels(spark: SparkSession, d: str) -> DataFrame:
    """JN-01 with front points; every third request names a street that is not even similar to one."""
    p = load(spark, d, "parcels")
    lots = p.withColumns({"front_lat": F.when(F.col("parcel_id") % 2 == 0, F.col("lat") + 0.0001), "front_lng": F.lit(None).cast("double"), "entrance_lat": F.lit(None).cast("double"), "entrance_lng": F.lit(None).cast("double")})
    return geocode.exact_parcel(p.selectExpr(*_PLACES.split(", ")).withColumnRenamed("parcel_id", "request_id"), lots)


_TYPED = "CASE WHEN parcel_id % 5 = 0 THEN '' WHEN parcel_id % 7 = 0 THEN NULL ELSE street_type END"
_ASK = f", r AS (SELECT parcel_id AS request_id, house::INT + parcel_id % 3 * 250 AS n, street, coalesce({_TYPED}, '') AS kind FROM parcels), lots AS (SELECT parcel_id, house::INT AS pn, street, street_type, CASE WHEN parcel_id % 20 = 0 THEN ' ' ELSE unit END AS unit, lat, lng FROM parcels)"


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = load(spark, d, "parcels")
    r = p.selectExpr("parcel_id AS request_id", "concat('', cast(house as int) + parcel_id % 3 * 250) AS house", "street", f"{_TYPED} AS street_type")
    return r, p.withColumn("unit", F.expr("CASE WHEN parcel_id % 20 = 0 THEN ' ' ELSE unit END"))


@query(
    with_sql("parcels") + _ASK
    + """, j AS (SELECT request_id, abs(n - pn) AS gap, pn, parcel_id, lat, lng FROM r JOIN lots l ON r.street = l.street AND (kind = street_type OR kind = '') WHERE unit IS NULL OR trim(unit) = ''),
b AS (SELECT request_id, min((gap, pn, parcel_id)) AS k FROM j GROUP BY 1)
SELECT b.request_id, 4 AS step, lat, lng, CASE WHEN gap <= 20 THEN 70 WHEN gap <= 100 THEN 60 ELSE 55 END AS confidence, 'nearest civic number ' || pn AS note FROM b JOIN j ON b.request_id = j.request_id AND b.k = (j.gap, j.pn, j.parcel_id)"""
)
def civic_any_type(spark: SparkSession, d: str) -> DataFrame:
    """JN-04 with blank street types, blank units and numbers far away."""
    return geocode.nearest_civic(*_asked(spark, d))


@query(
    with_sql("parcels") + _ASK
    + ", m AS (SELECT request_id, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng FROM r JOIN lots l ON r.street = l.street AND (kind = street_type OR kind = '') GROUP BY 1) SELECT request_id, 5 AS step, lat, lng, 50 AS confidence FROM m"
)
def street_centroids(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05."""
    return geocode.street_centroid(*_asked(spark, d)).select("request_id", "step", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), "confidence")


_LEN = "sqrt(pow((x2 - x1) * cos(radians(y1)), 2) + pow(y2 - y1, 2))"


@query(with_sql("parcels", "segments") + f", s AS (SELECT canon, sum((y1 + y2) / 2 * {_LEN}) / sum({_LEN}) AS lat, sum((x1 + x2) / 2 * {_LEN}) / sum({_LEN}) AS lng FROM segments GROUP BY 1) SELECT parcel_id AS request_id, 6 AS step, round(s.lat, 9) AS lat, round(s.lng, 9) AS lng, 45 AS confidence FROM parcels JOIN s ON canon = street")
def road_centroids(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06."""
    r = load(spark, d, "parcels").select(F.col("parcel_id").alias("request_id"), "street")
    return geocode.road_centroid(r, load(spark, d, "segments").withColumn("roadname", F.col("canon"))).select("request_id", "step", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), "confidence")


_JUNCTION = "c_custkey AS request_id, concat('STREET', c_custkey % 40) AS s, concat('STREET', c_custkey * 7 % 40) AS c, CASE WHEN c_custkey % 5 > 1 THEN concat('', c_custkey % 5) END AS map_grid, CASE WHEN c_custkey % 4 = 0 THEN 90 END AS match_score"


@query(
    with_sql("segments") + _XING
    + f""", i AS (SELECT canon_a, canon_b, x, y, row_number() OVER (PARTITION BY canon_a, canon_b ORDER BY x, y) - 1 AS k FROM n), r AS (SELECT {_JUNCTION} FROM customer),
m AS (SELECT request_id, map_grid, match_score, k, y AS lat, x AS lng, coalesce(concat('', k % 3 + 1) = map_grid, false) AS fits FROM r JOIN i ON canon_a = least(s, c) AND canon_b = greatest(s, c)), w AS (SELECT *, bool_or(fits) OVER (PARTITION BY request_id) AS any_fit FROM m),
b AS (SELECT request_id, count(*) AS candidates, bool_or(map_grid IS NOT NULL AND NOT any_fit) AS grid_conflict, arg_min(lat, k) AS lat, arg_min(lng, k) AS lng, max(match_score) AS ms FROM w WHERE fits OR NOT any_fit GROUP BY 1)
SELECT request_id, candidates, grid_conflict, ms IS NULL AND candidates = 1 AND NOT grid_conflict AS resolved, lat, lng, coalesce(ms, 100) AS match_score,
 CASE WHEN ms IS NOT NULL THEN 'suggested street names' WHEN grid_conflict THEN 'no junction of these streets in the map grid' WHEN candidates > 1 THEN candidates || ' junctions of these streets' END AS note FROM b"""
)
def junctions_by_grid(spark: SparkSession, d: str) -> DataFrame:
    """JN-05, JN-07, JN-09."""
    n = spatial.number_candidates(spatial.line_crossings(load(spark, d, "segments")))
    i = n.select(text.intersection_key(F.col("canon_a"), F.col("canon_b")).alias("key"), "candidate_index", F.col("y").alias("lat"), F.col("x").alias("lng"), F.concat((F.col("candidate_index") % 3 + 1).cast("string")).alias("zone_id"))
    r = spark.sql(f"SELECT {_JUNCTION} FROM {{customer}}", customer=spark.read.parquet(f"{d}/customer.parquet")).withColumn("key", text.intersection_key(F.col("s"), F.col("c")))
    return geocode.intersection_lookup(r, i)


_STEPS = "SELECT parcel_id AS request_id, CASE parcel_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 6 ELSE 0 END AS step, CASE WHEN parcel_id % 6 = 0 THEN NULL ELSE lat END AS lat, lng, cast(parcel_id % 100 as int) AS confidence, cast(null as {s}) AS note FROM {p} WHERE parcel_id % {m} <> 0"


@query(
    with_sql("parcels")
    + f", e AS ({_STEPS.format(s='varchar', p='parcels', m=4)} UNION ALL SELECT request_id, 3, lat, lng, 75, 'n' FROM ({_STEPS.format(s='varchar', p='parcels', m=3)})), b AS (SELECT request_id, min((step, lat, lng, confidence)) AS b FROM e WHERE lat IS NOT NULL GROUP BY 1) SELECT parcel_id AS request_id, b[1] AS step, b[2] AS lat, b[3] AS lng, b[4] AS confidence FROM parcels LEFT JOIN b ON request_id = parcel_id"
)
def cascade_pick(spark: SparkSession, d: str) -> DataFrame:
    """WIN-03: the lowest step with a place, of two lists of answers."""
    p = load(spark, d, "parcels")
    one = spark.sql(_STEPS.format(s="string", p="{p}", m=4), p=p)
    two = spark.sql(_STEPS.format(s="string", p="{p}", m=3), p=p).withColumns({"step": F.lit(3), "confidence": F.lit(75), "note": F.lit("n")})
    return geocode.cascade(p.select(F.col("parcel_id").alias("request_id")), one, two).drop("note")


_LOTS = "parcel_id, gis_id, concat(house, ' ', street, ' ', street_type) AS address"
_QUERY = "CASE parcel_id % 4 WHEN 0 THEN concat(house, ' ', lower(street), ' ', lower(street_type), ', Coquitlam') WHEN 1 THEN gis_id WHEN 2 THEN concat(substr(house, 2), ' ', street) ELSE concat('no such lane ', parcel_id) END"


@query(
    with_sql("parcels")
    + f""", l AS (SELECT {_LOTS} FROM parcels), q AS (SELECT parcel_id AS k, {_QUERY} AS query, concat(house, ' ', street, ' ', street_type) AS own, concat(substr(house, 2), ' ', street) AS part FROM parcels)
SELECT query, CASE k % 4 WHEN 0 THEN (SELECT min(parcel_id) FROM l WHERE address = own) WHEN 1 THEN k WHEN 2 THEN (SELECT min(parcel_id) FROM l WHERE contains(address, part)) END AS parcel_id, CASE k % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'gis_id' WHEN 2 THEN 'contains' END AS match FROM q"""
)
def parcel_lookups(spark: SparkSession, d: str) -> DataFrame:
    """JN-11: whole addresses, ids, parts of addresses and unknown ones."""
    p = load(spark, d, "parcels")
    return geocode.parcel_lookup(p.select(F.expr(_QUERY).alias("query")), p.selectExpr("parcel_id", "gis_id", "concat(house, ' ', street, ' ', street_type) AS address"))


@query(with_sql("segments") + _XING + ", i AS (SELECT canon_a, canon_b, x, row_number() OVER (PARTITION BY canon_a, canon_b ORDER BY x, y) - 1 AS candidate_index FROM n) SELECT canon_a, canon_b, candidate_index, CASE WHEN candidate_index = 0 AND canon_a = 'STREET1' THEN 0.0 ELSE x END AS x FROM i UNION ALL SELECT 'STREET0', 'MANUAL', 0, 1.0")
def manual_over_derived(spark: SparkSession, d: str) -> DataFrame:
    """JN-12: manual junctions replace derived ones of their key; one of them is new."""
    n = saved(spatial.number_candidates(spatial.line_crossings(load(spark, d, "segments"))).select("canon_a", "canon_b", "candidate_index", "x"))
    manual = n.where("candidate_index = 0 and canon_a = 'STREET1'").withColumn("x", F.lit(0.0)).unionByName(spark.sql("select 'STREET0' as canon_a, 'MANUAL' as canon_b, 0 as candidate_index, 1.0D as x"))
    return upsert.keep_manual(n, manual, ["canon_a", "canon_b", "candidate_index"])


@query(with_sql("dispatches") + " SELECT dispatch_id FROM dispatches WHERE id % 6 = 0 AND id % 4 <> 0")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    """JN-13."""
    t = load(spark, d, "dispatches")
    lost = t.where("id % 6 = 0").select("dispatch_id").unionByName(spark.sql("select cast(null as string) as dispatch_id"))
    return lookups.orphans(lost, t.where("id % 4 = 0"), "dispatch_id")


@query(with_sql("parcels") + ", t AS (SELECT DISTINCT 14 AS z, trunc((lng + 180.0) / 360.0 * 16384)::BIGINT AS x, trunc((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 16384)::BIGINT AS y FROM parcels) SELECT z, x, y FROM t WHERE (x + y) % 3 <> 0")
def tiles_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """SET-03: tiles of all parcels without those of every third diagonal."""
    t = load(spark, d, "parcels").select(F.lit(14).alias("z"), geo.tile_of(F.col("lat"), F.col("lng"), F.lit(14)).alias("t")).select("z", "t.*")
    return lookups.missing_tiles(t, t.where("(x + y) % 3 = 0"))


@query(with_sql("parcels") + ", t AS (SELECT DISTINCT 14 AS z, trunc((lng + 180.0) / 360.0 * 16384)::BIGINT AS x, trunc((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 16384)::BIGINT AS y FROM parcels) SELECT x, y, round(x / 16384.0 * 360 - 180, 9) AS lng, round(degrees(atan(sinh(pi() * (1 - 2 * y / 16384.0)))), 9) AS lat, round(x * (2 * pi() * 6378137.0 / 16384) - pi() * 6378137.0, 3) AS west, round(pi() * 6378137.0 - (y + 1) * (2 * pi() * 6378137.0 / 16384), 3) AS south FROM t".replace("sinh(pi() * (1 - 2 * y / 16384.0))", "(exp(pi() * (1 - 2 * y / 16384.0)) - exp(-pi() * (1 - 2 * y / 16384.0))) / 2"))
def tile_boxes(spark: SparkSession, d: str) -> DataFrame:
    """FN-02: corners of tiles and their boxes in metres."""
    t = load(spark, d, "parcels").select(geo.tile_of(F.col("lat"), F.col("lng"), F.lit(14)).alias("t")).select("t.*").distinct()
    c, b = geo.tile_corner(F.col("x"), F.col("y"), F.lit(14)), geo.tile_box_m(F.col("x"), F.col("y"), F.lit(14))
    return t.select("x", "y", F.round(c["lng"], 9).alias("lng"), F.round(c["lat"], 9).alias("lat"), F.round(b["west"], 3).alias("west"), F.round(b["south"], 3).alias("south"))


@query(with_sql("dispatches", "parcels") + ", e AS (SELECT street AS term, 0 AS list, min(id) AS rank FROM dispatches WHERE id % 7 < 3 GROUP BY 1 UNION ALL SELECT street, 1, min(parcel_id) FROM parcels GROUP BY 1) SELECT term, min((list, rank))[1] AS list, min((list, rank))[2] AS rank FROM e GROUP BY term")
def term_union(spark: SparkSession, d: str) -> DataFrame:
    """SET-01."""
    a = load(spark, d, "dispatches").where("id % 7 < 3").select(F.col("street").alias("term"), F.col("id").alias("rank"))
    return lookups.ordered_union(a, load(spark, d, "parcels").select(F.col("street").alias("term"), F.col("parcel_id").alias("rank")))


@query(with_sql("dispatches") + " SELECT dispatch_id, list_sort(list_distinct([u1, u2])) = list_sort(list_distinct(CASE WHEN id % 2 = 0 THEN [u2, u1, u1] ELSE [u1] END)) AS same, array_to_string(list_filter([u1, u2], lambda u: u = CASE WHEN id % 3 = 0 THEN u2 ELSE u1 END), ',') AS shared FROM dispatches")
def unit_sets(spark: SparkSession, d: str) -> DataFrame:
    """SET-02."""
    t = load(spark, d, "dispatches").withColumn("a", F.array("u1", "u2"))
    return t.select("dispatch_id", reports.same_units(F.col("a"), F.expr("CASE WHEN id % 2 = 0 THEN array(u2, u1, u1) ELSE array(u1) END")).alias("same"), F.array_join(reports.shared_units(F.col("a"), F.expr("array(CASE WHEN id % 3 = 0 THEN u2 ELSE u1 END)")), ",").alias("shared"))


@query(with_sql("parcels") + ", a AS (SELECT parcel_id, concat(house, ' ', street) AS address FROM parcels) SELECT parcel_id, address FROM a WHERE contains(lower(address), '7 street1') ORDER BY address, parcel_id LIMIT 25")
def address_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03: 25 found addresses are the feature."""
    return lookups.address_search(load(spark, d, "parcels").select("parcel_id", F.concat_ws(" ", "house", "street").alias("address")), "7 STREET1")


_TRAIN = "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('said ', id) END"


@query(with_sql("dispatches") + f" SELECT dispatch_id || '.wav' AS file_name, {_TRAIN} AS verified_transcript, street AS raw_transcript FROM dispatches WHERE feedback_submitted AND {_TRAIN} <> '' AND id % 5 <> 0")
def training_manifest(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06 and SNK-05."""
    return sinks.training_manifest(load(spark, d, "dispatches").withColumns({"verified_transcript": F.expr(_TRAIN), "raw_transcript": F.col("street"), "include_in_training": F.expr("CASE WHEN id % 5 = 0 THEN false WHEN id % 2 = 0 THEN true END")}))


@query(with_sql("closures") + " SELECT closure_id, CASE WHEN event_id % 4 = 0 THEN concat('', event_id % 25) WHEN event_id % 3 = 0 THEN '1,2' END AS affected FROM closures WHERE event_id % 5 <> 0")
def active_closures(spark: SparkSession, d: str) -> DataFrame:
    """FLT-08."""
    c = load(spark, d, "closures").selectExpr("closure_id", "start_time AS updated_at", "event_id % 5 <> 0 AS active", "CASE WHEN event_id % 4 = 0 THEN concat('', event_id % 25) END AS zone_id", "CASE WHEN event_id % 4 <> 0 AND event_id % 3 = 0 THEN array('1', '2') ELSE array() END AS affected_zones")
    return lookups.active_closures(c.withColumn("affected_zones", F.col("affected_zones").cast("array<string>"))).select("closure_id", F.array_join("affected_zones", ",").alias("affected"))


@query(with_sql("dispatches") + " SELECT dispatch_id FROM dispatches WHERE feedback_submitted AND (contains(lower(street), 'street1') OR contains(lower(dispatch_id), 'street1')) AND (u1 LIKE 'E%' OR lower(u2) LIKE 'e%' OR id % 4 = 0) AND (CASE WHEN id % 3 = 0 THEN u2 = 'SQ2' ELSE u1 LIKE '%2%' OR u2 LIKE '%2%' END)")
def reviewed_list(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04: text, status, tone and unit at once."""
    t = load(spark, d, "dispatches").withColumns({"units": F.array("u1", "u2"), "verified_units": F.expr("CASE WHEN id % 3 = 0 THEN array(u2) END"), "address": F.col("street"), "raw_transcript": F.lit(None).cast("string"), "tone_name": F.expr("CASE WHEN id % 4 = 0 THEN 'Engine Tone' WHEN id % 3 = 0 AND u1 LIKE 'E%' THEN 'Engine Tone' END")})
    return dispatch.review_list(t, text="street1", status="fine_tuned", tone="engine", unit="2").select("dispatch_id")


_SAID = "CASE parcel_id % 6 WHEN 0 THEN concat(house, ' ', street, ' Avenue unit 7') WHEN 1 THEN concat(house, ' block of ', street, ' road') WHEN 2 THEN concat(house, ' ', street) WHEN 3 THEN street WHEN 4 THEN concat(house, ' avenue') ELSE concat(house, ' ', street, ' quay west') END"


@query(
    with_sql("parcels")
    + """ SELECT parcel_id, CASE WHEN parcel_id % 6 <> 3 THEN house END AS house, CASE parcel_id % 6 WHEN 0 THEN street WHEN 1 THEN street WHEN 2 THEN street WHEN 4 THEN '' WHEN 5 THEN street || ' quay' END AS street,
 CASE parcel_id % 6 WHEN 0 THEN 'AVE' WHEN 1 THEN 'RD' WHEN 2 THEN '' WHEN 4 THEN 'AVE' WHEN 5 THEN 'WEST' END AS street_type, CASE WHEN parcel_id % 6 <> 3 THEN parcel_id % 6 = 1 END AS has_block FROM parcels"""
)
def houses_and_streets(spark: SparkSession, d: str) -> DataFrame:
    """CLN-07."""
    return load(spark, d, "parcels").select("parcel_id", text.house_and_street(F.expr(_SAID)).alias("h")).select("parcel_id", "h.*")


_MAIL = "CASE parcel_id % 5 WHEN 0 THEN concat('unit 12 - ', house, ' ', lower(street), ' av, Coquitlam, BC') WHEN 1 THEN concat(house, ' ', street, ' hwy, suite 4') WHEN 2 THEN concat('7-', house, ' ', street, ' Street') WHEN 3 THEN concat(street, ' Rd at Main St') END"


@query(
    with_sql("parcels")
    + """ SELECT parcel_id, CASE parcel_id % 5 WHEN 0 THEN house || ' ' || street || ' AVE' WHEN 1 THEN house || ' ' || street || ' HIGHWAY' WHEN 2 THEN '7-' || house || ' ' || street || ' STREET' WHEN 3 THEN street || ' RD AT MAIN ST' ELSE '' END AS clean,
 CASE parcel_id % 5 WHEN 0 THEN house || ' ' || lower(street) || ' av, Coquitlam, BC' WHEN 1 THEN house || ' ' || street || ' hwy,' WHEN 2 THEN house || ' ' || street || ' Street' WHEN 3 THEN street || ' Rd & Main St' ELSE '' END AS civic FROM parcels"""
)
def lookup_addresses(spark: SparkSession, d: str) -> DataFrame:
    """CLN-09 and CLN-11."""
    return load(spark, d, "parcels").select("parcel_id", text.lookup_address(F.expr(_MAIL)).alias("clean"), text.civic_address(F.expr(_MAIL)).alias("civic"))


@query(with_sql("dispatches") + " SELECT dispatch_id, CASE WHEN id % 3 = 0 THEN u1 || ', X9' ELSE u1 || ', ' || u2 END AS units, 'E' || (id % 4 + 1) || CASE WHEN id % 2 = 0 THEN ',LAV' || (id % 3 + 1) ELSE '' END AS codes FROM dispatches")
def merged_units(spark: SparkSession, d: str) -> DataFrame:
    """CLN-18 and CLN-19."""
    known = [f"{kind} {n}" for kind in ("engine", "light attack vehicle") for n in (1, 2, 3, 4)]
    said = F.expr("concat('Engine ', id % 4 + 1, ', engine  ', id % 4 + 1, ' and tender 3', CASE WHEN id % 2 = 0 THEN concat(' light attack vehicle ', id % 3 + 1) ELSE '' END)")
    more = F.expr("CASE WHEN id % 3 = 0 THEN concat(lower(u1), ',X9, ') ELSE concat(u2, ', ', u1) END")
    return load(spark, d, "dispatches").select("dispatch_id", text.merge_units(F.col("u1"), more).alias("units"), F.array_join(tr.unit_codes(said, known), ",").alias("codes"))


@query(with_sql("parcels") + ", b AS (SELECT parcel_id AS k, street AS word, lat AS blat FROM parcels WHERE parcel_id < 30), t AS (SELECT parcel_id, house || ' ' || street AS a FROM parcels) SELECT parcel_id, coalesce((SELECT 'Hall ' || min(k) FROM b WHERE contains(a, word)), a) AS address, (SELECT 'B' || min(k) FROM b WHERE contains(a, word)) AS building FROM t")
def known_buildings(spark: SparkSession, d: str) -> DataFrame:
    """CLN-25: streets serve as aliases of buildings; the lowest position wins."""
    p = load(spark, d, "parcels")
    b = p.where("parcel_id < 30").selectExpr("parcel_id AS position", "concat('B', parcel_id) AS name", "concat('Hall ', parcel_id) AS address", "array(lower(street)) AS aliases", "lat", "lng", "cast(null as double) AS entrance_lat", "cast(null as double) AS entrance_lng")
    return views.with_building(p.selectExpr("parcel_id", "concat(house, ' ', street) AS address", "lat", "lng"), b).select("parcel_id", "address", "building")


@query(with_sql("parcels") + " SELECT parcel_id, CASE WHEN parcel_id % 6 = 0 THEN NULL WHEN parcel_id % 2 = 0 THEN 'Point' ELSE 'LineString' END AS kind, CASE WHEN parcel_id % 6 <> 0 THEN lng END AS first_x FROM parcels")
def geometries(spark: SparkSession, d: str) -> DataFrame:
    """FN-05."""
    pair = lambda lat, lng: F.struct(F.expr(lat).cast("double").alias("lat"), F.expr(lng).cast("double").alias("lng"))
    pairs = F.array(pair("CASE WHEN parcel_id % 6 <> 0 THEN lat END", "lng"), pair("CASE WHEN parcel_id % 2 <> 0 THEN lat END", "lng + 1"))
    g = load(spark, d, "parcels").select("parcel_id", geo.geometry(pairs).alias("g"))
    return g.select("parcel_id", F.col("g.type").alias("kind"), F.col("g.coordinates")[0][0].alias("first_x"))


@query(with_sql("zones", "dispatches") + " SELECT 'hall' AS kind, hall_id AS name, count(*) AS n FROM zones GROUP BY hall_id UNION ALL SELECT 'category', incident_type, count(*) FROM dispatches WHERE coalesce(feedback_submitted, false) GROUP BY incident_type")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03: zones per hall, and terms per category (incident types of reviewed dispatches stand for the vocabulary)."""
    z = reports.per_hall(load(spark, d, "zones")).select(F.lit("hall").alias("kind"), F.col("hall_id").alias("name"), "n")
    v = load(spark, d, "dispatches").select(F.col("incident_type").alias("category"), F.coalesce("feedback_submitted", F.lit(False)).alias("is_active"))
    return z.unionByName(reports.per_category(v).select(F.lit("category").alias("kind"), F.col("category").alias("name"), "n"))


@query(with_sql("parcels", "zones") + " SELECT 'zones' AS \"table\", count(*) AS n, 25 AS low, 25 AS high, count(*) = 25 AS ok FROM zones UNION ALL SELECT 'parcels', count(*), 1, NULL, count(*) >= 1 FROM parcels")
def table_bands(spark: SparkSession, d: str) -> DataFrame:
    """QC-02."""
    return reports.row_counts({"zones": load(spark, d, "zones"), "parcels": load(spark, d, "parcels")}, {"zones": (25, 25), "parcels": (1, None)})


@query(
    with_sql("dispatches")
    + """, s AS (SELECT incident_type, (id % 5) / 10.0 AS o, (id % 4) / 10.0 AS n FROM dispatches)
SELECT incident_type, count(*) AS n, round(count(*) FILTER (n = 0) * 100.0 / count(*), 4) AS perfect, round(count(*) FILTER (n > 0 AND n < 0.2) * 100.0 / count(*), 4) AS operational, round(count(*) FILTER (n >= 0.2) * 100.0 / count(*), 4) AS failed,
 count(*) FILTER (n < o) AS improved, count(*) FILTER (n > o) AS regression, count(*) FILTER (n = o) AS unchanged FROM s GROUP BY incident_type"""
)
def score_changes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09."""
    return reports.rating_distribution(load(spark, d, "dispatches").selectExpr("incident_type", "cast((id % 5) / 10.0 as double) AS old_rate", "cast((id % 4) / 10.0 as double) AS new_rate"), "incident_type")


_FOUND = "SELECT concat('D', event_id % 500) AS dispatch_id, event_id AS position, CASE WHEN event_id % 3 = 0 THEN concat('unit ', event_id) END AS units, CASE WHEN event_id % 5 = 0 THEN event_type END AS call_type, CASE WHEN event_id % 4 = 0 THEN concat('', event_id % 25) END AS grid, CASE WHEN event_id % 6 = 0 THEN 'CH' END AS channel FROM {e}"


@query(
    f"WITH c AS ({_FOUND.format(e='events')}) SELECT dispatch_id, arg_min(units, position) FILTER (units IS NOT NULL) AS units, arg_min(call_type, position) FILTER (call_type IS NOT NULL) AS call_type, arg_min(grid, position) FILTER (grid IS NOT NULL) AS grid, arg_min(channel, position) FILTER (channel IS NOT NULL) AS channel FROM c GROUP BY dispatch_id"
)
def first_known(spark: SparkSession, d: str) -> DataFrame:
    """WIN-04."""
    return transcripts.first_known(spark.sql(_FOUND, e=spark.read.parquet(f"{d}/events.parquet")), "dispatch_id", ["units", "call_type", "grid", "channel"])


@query(
    f"""WITH c AS ({_FOUND.format(e='events')}), p AS (SELECT *, CASE WHEN position % 7 = 0 THEN 49.2 END AS lat FROM c),
f AS (SELECT dispatch_id, arg_min(units, position) FILTER (units IS NOT NULL) AS units, arg_min(grid, position) FILTER (grid IS NOT NULL) AS grid, arg_min(channel, position) FILTER (channel IS NOT NULL) AS channel, arg_min(position, (lat IS NULL, position)) AS place, arg_min(lat, (lat IS NULL, position)) FILTER (lat IS NOT NULL) AS lat FROM p GROUP BY 1),
g AS (SELECT *, coalesce(grid, CASE WHEN lat IS NOT NULL THEN '9' END) AS map_grid FROM f), s AS (SELECT *, greatest(0.0, CASE WHEN lat IS NULL THEN 0 ELSE 100 END - CASE WHEN lat IS NULL THEN 30 ELSE 0 END - CASE WHEN units IS NULL THEN 20 ELSE 0 END - CASE WHEN map_grid IS NULL THEN 15 ELSE 0 END - CASE WHEN channel IS NULL THEN 15 ELSE 0 END) AS score FROM g)
SELECT dispatch_id, units, concat('A', place) AS address, map_grid, lat, score, score < 90 AS verify FROM s"""
)
def built_dispatches(spark: SparkSession, d: str) -> DataFrame:
    """TXT-10, second half."""
    none = F.lit(None).cast("string")
    c = spark.sql(_FOUND, e=spark.read.parquet(f"{d}/events.parquet")).withColumns({"address": F.concat(F.lit("A"), F.col("position").cast("string")), "intersection": none, "sub": none, "cross_1": none, "cross_2": none})
    places = c.where("position % 7 = 0").select("dispatch_id", "position", F.lit(49.2).alias("lat"), F.lit(-122.8).alias("lng"), F.lit(100).alias("confidence"), F.lit("9").alias("zone_id"))
    return transcripts.build_dispatches(c, places).select("dispatch_id", "units", "address", "map_grid", "lat", "score", "verify")


@query(
    with_sql("readings")
    + """, q AS (SELECT device, seq, value AS rms, coalesce(value < 60, false) AS quiet FROM readings), n AS (SELECT *, row_number() OVER w AS k, sum(rms) OVER (w ROWS 49 PRECEDING) AS tail FROM q WINDOW w AS (PARTITION BY device, quiet ORDER BY seq)),
m AS (SELECT *, CASE WHEN quiet THEN CASE WHEN k < 50 THEN (tail + 16) / (k + 1) ELSE tail / 50 END END AS mean FROM n), b AS (SELECT *, coalesce(last_value(mean IGNORE NULLS) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING), 16.0) AS base FROM m),
l AS (SELECT device, seq, rms, coalesce(rms > greatest(40.0, 2.5 * base), false) AS loud FROM b) SELECT device, seq, rms, loud, sum(loud::INT) OVER (PARTITION BY device ORDER BY seq ROWS 4 PRECEDING) >= 4 AS triggered FROM l"""
)
def loud_readings(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05."""
    return dispatch.loud_readings(load(spark, d, "readings").withColumnRenamed("value", "rms"))


@query(with_sql("readings") + """, l AS (SELECT device, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts)) > 3000000 THEN 1 WHEN lag(ts) OVER (PARTITION BY device ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM readings WHERE value >= 30),
r AS (SELECT device, ts, sum(new) OVER (PARTITION BY device ORDER BY ts) AS run FROM l), p AS (SELECT *, floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY device, run))) / 75000000) AS part FROM r),
s AS (SELECT device, min(ts) AS start, max(ts) AS e FROM p GROUP BY device, run, part) SELECT device, start, greatest(0, (epoch_us(e) - epoch_us(start)) // 1000000 // 3 - 2 - CASE WHEN (epoch_us(e) - epoch_us(start)) % 3000000 < 1000000 AND (epoch_us(e) - epoch_us(start)) >= 10000000 THEN 1 ELSE 0 END)::BIGINT AS ticks FROM s""")
def capture_ticks(spark: SparkSession, d: str) -> DataFrame:
    """STR-03: phase-1 checks of all sessions."""
    s = ch.sessions(load(spark, d, "readings").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("value", "rms"))
    return ch.with_ticks(s).select("device", F.col("start").cast("timestamp_ntz").alias("start"), F.size("ticks").cast("long").alias("ticks"))


@query(
    with_sql("changes")
    + """, k AS (SELECT *, max(CASE WHEN op = 'DELETE' THEN (ts, seq) END) OVER (PARTITION BY dispatch_id) AS gone FROM changes), a AS (SELECT * FROM k WHERE gone IS NULL OR (ts, seq) > gone)
SELECT dispatch_id, arg_max(address, (ts, seq)) FILTER (address IS NOT NULL) AS address, arg_max(incident_type, (ts, seq)) FILTER (incident_type IS NOT NULL) AS incident_type, arg_max(confidence_score, (ts, seq)) FILTER (confidence_score IS NOT NULL) AS confidence_score FROM a GROUP BY dispatch_id"""
)
def dispatch_state(spark: SparkSession, d: str) -> DataFrame:
    """STR-01 as one batch on an empty state: nothing from before a key's last delete comes back."""
    c = load(spark, d, "changes").select("op", "ts", "seq", F.struct("dispatch_id", *ch.FIELDS).alias("record"))
    empty = spark.createDataFrame([], "dispatch_id string, address string, incident_type string, confidence_score double")
    return ch.apply_changes(empty, c)


@query(
    with_sql("zones", "hydrants")
    + f", q AS (SELECT object_id, {_IN.replace('p.', 'h.')} AS zone_id FROM hydrants h) SELECT hall_id, count(*) AS hydrants, count(DISTINCT zone_id) AS zones FROM q LEFT JOIN zones ON zone_id = map_name GROUP BY hall_id"
)
def hydrants_per_hall(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-06 (strict: a hydrant on an outline is in no zone) and AGG-03: hydrants by zone, counted per hall."""
    shapes = zone_shapes(load(spark, d, "zones"))
    h = spatial.with_zone(load(spark, d, "hydrants"), shapes, strict=True).join(shapes.select(F.col("map_name").alias("zone_id"), "hall_id"), "zone_id", "left")
    return h.groupBy("hall_id").agg(F.count("*").alias("hydrants"), F.count_distinct("zone_id").alias("zones"))




@query(
    """SELECT concat('D', o_orderkey) AS dispatch_id, concat('engine ', o_orderkey % 4 + 1, ', ladder 2') AS units, 'emergency' AS priority,
 CASE WHEN o_orderkey % 3 = 2 THEN 'Unknown Incident' WHEN o_orderkey % 3 = 0 THEN 'Medical Aid' ELSE 'Structure Fire' END AS call_type, concat('', o_orderkey % 150 + 1) AS grid,
 CASE o_orderkey % 3 WHEN 0 THEN '5' WHEN 1 THEN '7' ELSE '10' END AS channel FROM orders"""
)
def left_to_right(spark: SparkSession, d: str) -> DataFrame:
    """TXT-04 on announcements written from all orders, a second grid at the end; call types with marks are not met at the start."""
    t = _calls(spark, d).select("dispatch_id", F.concat(F.lit("coquitlam map grid 3 "), F.regexp_replace("transcript", "^Coquitlam ", "")).alias("x"), "transcript")
    t = t.select("dispatch_id", tr.sanitized(F.concat("transcript", F.lit(""))).alias("clean"))
    got = transcripts.left_to_right(t, [x for x in _TYPES if "-" not in x])
    return got.select("dispatch_id", F.array_join("units", ", ").alias("units"), "priority", "call_type", "grid", "channel")


@query(with_sql("segments") + _XING + """, i AS (SELECT canon_a, canon_b, x, y FROM n), r AS (SELECT DISTINCT canon_a || ' & ' || canon_b AS key FROM i UNION SELECT DISTINCT 'RAW ' || canon_a || ' & ' || canon_b FROM i) SELECT key, count(*) AS n FROM r GROUP BY key""")
def raw_keys(spark: SparkSession, d: str) -> DataFrame:
    """JN-05: the index holds normal and raw keys."""
    n = spatial.line_crossings(load(spark, d, "segments")).select(F.concat_ws(" & ", "canon_a", "canon_b").alias("key"), F.concat(F.lit("raw "), F.concat_ws(" & ", "canon_a", "canon_b")).alias("raw_key")).distinct()
    return geocode.with_raw_keys(n).groupBy("key").agg(F.count("*").alias("n"))


_FOOT = "greatest(0.0, least(1.0, ((x - x1) * cos(radians(y)) * (x2 - x1) * cos(radians(y)) + (y - y1) * (y2 - y1)) / (((x2 - x1) * cos(radians(y))) ** 2 + (y2 - y1) ** 2)))"


@query(
    with_sql("segments")
    + f""", p AS (SELECT road_id, canon, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM segments), c AS (SELECT a.road_id AS request_id, b.road_id AS candidate_index, a.canon, b.x, b.y FROM p a JOIN p b ON b.road_id BETWEEN a.road_id AND a.road_id + 2),
f AS (SELECT request_id, candidate_index, x, y, x1, y1, x2, y2, {_FOOT} AS t FROM c JOIN segments USING (canon)),
d AS (SELECT request_id, candidate_index, min(sqrt(((x1 + t * (x2 - x1) - x) * cos(radians(y))) ** 2 + (y1 + t * (y2 - y1) - y) ** 2) * 6371000.0 * pi() / 180) AS m FROM f GROUP BY ALL)
SELECT request_id, candidate_index, round(m, 3) AS road_m FROM (SELECT *, min(m) OVER (PARTITION BY request_id) AS best FROM d) WHERE m - best <= 150"""
)
def narrowed_junctions(spark: SparkSession, d: str) -> DataFrame:
    """JN-08: three places a request, kept by their distance to the request's own street."""
    s = load(spark, d, "segments")
    p = s.selectExpr("road_id AS candidate_index", "(x1 + x2) / 2 AS lng", "(y1 + y2) / 2 AS lat")
    c = s.select(F.col("road_id").alias("request_id"), F.explode(F.array(F.col("road_id"), F.col("road_id") + 1, F.col("road_id") + 2)).alias("candidate_index")).join(p, "candidate_index")
    return jl.narrow_by_roads(c, s.selectExpr("road_id AS request_id", "canon AS cross"), s).select("request_id", "candidate_index", geo.rounded(F.col("road_m"), 3).alias("road_m"))
