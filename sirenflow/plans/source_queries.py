"""Registered queries, with SQL: tables written as municipal files and read back in byte ranges, and zones of crowded places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenflow.functions import transcript
from sirenflow.operators import spatial
from sirenflow.operators.lineage import fresh
from sirenflow.plans.fixtures import load, with_sql, zone_shapes
from sirenflow.plans.reference_queries import _ZONE_OF, query
from sirenflow.plans.row_queries import ORACLE, QUERIES
from sirenflow.sources import feeds, readers
from sirenflow.sources.sinks import append_evaluation, write_features, write_listed

__all__ = ["ORACLE", "QUERIES"]

PER_FILE = 20_000


def _files(spark: SparkSession, rows: DataFrame, key: str) -> str:
    path = fresh(spark, "feeds")
    write_features(rows, path, key, PER_FILE)
    return f"{path}/*/*.txt"


_ADDRESSES = """SELECT c_custkey AS k, concat(c_name, CASE c_custkey % 4 WHEN 0 THEN ' "{{[' WHEN 1 THEN ' }}]' WHEN 2 THEN concat(' ', chr(92), '"}}') ELSE '' END) AS legal,
 concat('', c_custkey % 9000 + 1, ' ', c_mktsegment) AS address, CASE c_custkey % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'many' WHEN 2 THEN '<Null>' WHEN 3 THEN '0' END AS units, CASE WHEN c_custkey % 3 = 0 THEN 'Retired' END AS state, c_acctbal AS lat FROM {customer}"""


@query(
    f"""WITH t AS ({_ADDRESSES.format(customer="customer")})
SELECT address, arg_min(legal, k) AS legaldesc, arg_min(CASE k % 5 WHEN 0 THEN 12 WHEN 3 THEN 0 ELSE -1 END, k) AS units, arg_min(coalesce(state, 'Active'), k) AS status, arg_min(k % 180, k)::DOUBLE AS lng, arg_min(lat, k) AS lat FROM t GROUP BY address"""
)
def address_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05 of files that many tasks read: customers as addresses, whose texts hold braces, brackets, quotes and backslashes."""
    t = spark.sql(_ADDRESSES, customer=spark.read.parquet(f"{d}/customer.parquet"))
    props = F.struct(F.col("address").alias("Address"), F.col("legal").alias("LegalDesc"), F.col("units").alias("Units"), F.col("state").alias("Status"), F.col("k").alias("K"))
    f = readers.features(spark, _files(spark, t.select("k", props.alias("properties"), F.expr("named_struct('type', 'Point', 'coordinates', array(double(k % 180), lat))").alias("geometry")), "k"), split=True)
    point = F.from_json("coordinates", "array<double>")
    got = feeds.parcels(f.select("props", point[1].alias("lat"), point[0].alias("lng"), F.col("props")["K"].cast("long").alias("place")))
    return got.select("address", "legaldesc", F.coalesce("units", F.lit(-1)).alias("units"), "status", "lng", "lat")


@query(
    with_sql("segments") + """ SELECT concat(canon, ' LANE') AS fullname, left_begin, left_end, right_begin, right_end, CASE WHEN road_id % 4 < 3 THEN 50 + road_id % 3 END AS speed, road_id % 3 < 2 AS truck_route, x1, y1, x2, y2, CASE WHEN road_id % 6 = 0 THEN 2 ELSE 1 END AS n_lines FROM segments WHERE road_id % 5 <> 1 AND road_id % 7 <> 0"""
)
def road_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01: roads as feature files with either case of names, odd states, lines with heights and roads of two lines."""
    t = load(spark, d, "segments").withColumns({"s": F.expr("CASE road_id % 5 WHEN 0 THEN null WHEN 1 THEN 'PROPOSED' WHEN 2 THEN ' operating ' WHEN 3 THEN '' ELSE 'OPERATING' END"), "full": F.expr("CASE WHEN road_id % 7 = 0 THEN ' ' ELSE concat(' ', canon, ' LANE ') END")})
    props = F.expr("named_struct('FullName', full, 'status', s, 'LEFTBEGIN', left_begin, 'leftEnd', left_end, 'RightBegin', string(right_begin), 'RIGHTEND', right_end, 'SPEED', if(road_id % 4 < 3, string(50 + road_id % 3), 'fast'), 'TruckRoute', element_at(array('yes', '1', 'no'), int(road_id % 3) + 1))")
    line = F.expr("array(array(x1, y1, 7.5D), array(x2, y2, 7.5D))")
    geometry = F.when(F.col("road_id") % 6 == 0, F.struct(F.lit("MultiLineString").alias("type"), F.to_json(F.array(line, line)).alias("c"))).otherwise(F.struct(F.lit("LineString").alias("type"), F.to_json(line).alias("c")))
    # a line and a list of lines have no common type, so the coordinates are put into the text
    text = F.concat(F.lit('{"properties":'), F.to_json(props), F.lit(',"geometry":{"type":"'), geometry["type"], F.lit('","coordinates":'), geometry["c"], F.lit("}}"))
    path = fresh(spark, "feeds")
    write_listed(t.select(F.col("road_id").alias("key"), text.alias("value")), path, '{"features":[', '],"type":"FeatureCollection"}', PER_FILE)
    r = readers.roads(spark, f"{path}/*/*.txt", split=True)
    at = lambda i, k: F.col("lines")[0][i][k]
    return r.select("fullname", "left_begin", "left_end", "right_begin", "right_end", "speed", "truck_route", at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(1, "x").alias("x2"), at(1, "y").alias("y2"), F.size("lines").alias("n_lines"))


@query(
    with_sql("hydrants") + """ SELECT object_id::INT AS object_id, CASE WHEN object_id % 4 > 0 THEN concat('G', object_id) ELSE concat('H-', object_id) END AS gis_id, status, flow_class, round(lat, 6) AS lat, round(lng, 6) AS lng FROM hydrants WHERE object_id % 11 > 0 AND object_id % 13 > 0"""
)
def hydrant_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-07: hydrants as pages with attributes; some lack an id or a place."""
    t = load(spark, d, "hydrants")
    value = F.to_json(F.expr("named_struct('attributes', named_struct('OBJECTID', if(object_id % 11 = 0, null, object_id), 'GIS_ID', if(object_id % 4 > 0, concat('G', object_id), ' '), 'STATUS', status, 'FLOW_CLASS', coalesce(flow_class, '<Null>')), 'geometry', if(object_id % 13 = 0, null, named_struct('x', lng, 'y', lat)))"))
    path = fresh(spark, "feeds")
    write_listed(t.select(F.col("object_id").alias("key"), value.alias("value")), path, '{"fields":[{"name":"OBJECTID"},{"name":"a } brace"}],"features":[', "]}", PER_FILE)
    return readers.hydrants(spark, f"{path}/*/*.txt", split=True)


@query(
    with_sql("zones") + """ SELECT map_name, CASE WHEN k IN (7, 17) THEN 6 ELSE 4 END AS points, x0 AS x, y0 AS y FROM zones WHERE k % 6 > 0"""
)
def zone_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02: zones as polygons; blank names go."""
    t = zone_shapes(load(spark, d, "zones")).withColumn("k", F.col("map_name").cast("int") - 1)
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["x"], p["y"], F.lit(0.0)))
    rows = t.select("k", F.struct(F.when(F.col("k") % 6 > 0, F.concat(F.lit(" "), "map_name")).otherwise("").alias("Map_Name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    z = readers.zones(spark, _files(spark, rows, "k"), split=True)
    first = F.col("rings")[0]
    return z.select("map_name", F.size(first).alias("points"), first[0]["x"].alias("x"), first[0]["y"].alias("y"))


@query(
    """SELECT concat('e', event_id) AS closure_id, CASE WHEN event_id % 3 = 0 THEN 'Regional Corridor' ELSE concat('Hwy ', event_id % 9) END AS street_name, CASE WHEN event_type = 'error' THEN 'FULL_CLOSURE' ELSE 'LANE_RESTRICTION' END AS closure_type,
CASE WHEN event_type = 'error' THEN 'NO_ACCESS' ELSE 'CAUTION' END AS emergency_access, (event_id % 80 + CASE WHEN event_id % 4 = 1 THEN 0.5 ELSE 0 END)::DOUBLE AS lat, value AS lng,
CASE event_id % 5 WHEN 0 THEN 1704103200 WHEN 1 THEN 1706745600 WHEN 2 THEN 1706770800 ELSE 1701421200 END AS start_s, CASE event_id % 5 WHEN 0 THEN 1704110400 WHEN 1 THEN 1709251199 WHEN 2 THEN 1709229659 END AS end_s FROM events WHERE event_id % 4 < 2"""
)
def open511_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08: events as an Open511 list, with intervals, recurring schedules, or the creation alone; other shapes than points and lines go."""
    t = spark.read.parquet(f"{d}/events.parquet")
    shape = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"type":"Point","coordinates":[', value, ',', event_id % 80, ']}')
      WHEN 1 THEN concat('{"type":"LineString","coordinates":[[', value - 1, ',', event_id % 80, '],[', value, ',', event_id % 80 + 0.5D, ']]}') WHEN 2 THEN '{"type":"Polygon","coordinates":[[[1,2]]]}' ELSE '{"type":"Point","coordinates":[]}' END""")
    times = F.expr("""CASE event_id % 5 WHEN 0 THEN '{"intervals":["2024-01-01T10:00Z/2024-01-01T12:00Z"]}' WHEN 1 THEN '{"recurring_schedules":[{"start_date":"2024-02-01","end_date":"2024-02-29"}]}'
      WHEN 2 THEN '{"recurring_schedules":[{"start_date":"2024-02-01","end_date":"2024-02-29","daily_start_time":"07:00","daily_end_time":"18:00"}]}' ELSE '{}' END""")
    plain = F.to_json(F.expr("named_struct('id', concat('e', event_id), 'road_name', if(event_id % 3 = 0, '', concat('Hwy ', event_id % 9)), 'severity', if(event_type = 'error', 'major', 'MINOR'), 'headline', concat(event_type, ' } {'), 'created', '2023-12-01T09:00:00Z')"))
    value = F.concat(F.expr("substr(plain, 1, length(plain) - 1)"), F.lit(',"geography":'), shape, F.lit(',"schedule":'), times, F.lit("}"))
    path = fresh(spark, "feeds")
    write_listed(t.withColumn("plain", plain).select(F.col("event_id").alias("key"), value.alias("value")), path, '{"pagination":{"offset":0},"events":[', "]}", PER_FILE)
    c = feeds.open511(spark, f"{path}/*/*.txt", split=True)
    return c.select("closure_id", "street_name", "closure_type", "emergency_access", "lat", "lng", F.unix_seconds("start_time").alias("start_s"), F.unix_seconds("end_time").alias("end_s"))


@query(with_sql("zones", "crowded") + f" SELECT id, {_ZONE_OF} AS zone_id FROM crowded p")
def crowded_zones(spark: SparkSession, d: str) -> DataFrame:
    """SPJ-01 where nine places of ten lie in one cell, which four zones meet in: the cell is split by its counts."""
    return spatial.with_zone(load(spark, d, "crowded"), zone_shapes(load(spark, d, "zones")), per_cell=2_000).select("id", "zone_id")


@query(
    """WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E3' WHEN 3 THEN 'Q5' WHEN 4 THEN 'E4' WHEN 5 THEN 'X9' END AS unit_id FROM customer)
SELECT concat('', k) AS zone_id, unit_id, CASE WHEN k % 2 = 0 THEN 'Hall' END AS station, CASE unit_id WHEN 'E1' THEN '1' WHEN 'E2' THEN '2' WHEN 'E3' THEN '3' WHEN 'Q5' THEN '3' WHEN 'E4' THEN '4' END AS hall_id FROM t WHERE unit_id IS NOT NULL AND k % 9 > 0"""
)
def zone_unit_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06: a bare list of zones with their first-due unit; blank zones and units go."""
    t = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS key", "to_json(named_struct('zone_id', if(c_custkey % 9 = 0, ' ', concat(c_custkey, ' ')), 'unit_id', element_at(array('e1', ' E2', 'e3', 'q5', 'E4', 'x9', ''), int(c_custkey % 7) + 1), 'station', if(c_custkey % 2 = 0, ' Hall ', ' '))) AS value")
    path = fresh(spark, "feeds")
    write_listed(t, path, "[", "]", PER_FILE)
    return feeds.zone_units(spark, f"{path}/*/*.txt", split=True)


@query(
    """WITH n AS (SELECT concat('Road ', s_suppkey % 70) AS r FROM supplier WHERE s_suppkey % 5 > 0 UNION SELECT concat('Lane ', s_suppkey % 30) FROM supplier WHERE s_suppkey % 4 > 0 UNION SELECT s_name FROM supplier)
SELECT r AS road_name, upper(r) AS road_name_normalized FROM n"""
)
def road_name_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-04: the suppliers' names in files of the three forms, some of them blank or repeated."""
    t, base = spark.read.parquet(f"{d}/supplier.parquet"), fresh(spark, "feeds")
    forms = {
        "a": ("to_json(named_struct('attributes', if(s_suppkey % 2 = 0, map('ROAD_NAME', r), map('road_name', r))))", "if(s_suppkey % 5 = 0, ' ', concat(' Road ', s_suppkey % 70))", '{"features":[', "]}"),
        "b": ("concat('\"', r, '\"')", "if(s_suppkey % 4 = 0, '', concat('Lane ', s_suppkey % 30, ' '))", "[", "]"),
        "c": ("to_json(map('RoadName', r))", "s_name", "[", "]"),
    }
    for name, (value, r, head, tail) in forms.items():
        write_listed(t.withColumn("r", F.expr(r)).selectExpr("s_suppkey AS key", f"{value} AS value"), f"{base}/{name}", head, tail, PER_FILE)
    return readers.road_names(spark, f"{base}/*/*/*.txt")


@query(
    with_sql("dispatches") + """ SELECT dispatch_id, concat(id % 900, ' ', street) AS address, lat, id % 2 = 0 AS include_in_training, CASE WHEN id % 5 > 0 THEN 'CH "2"' END AS channel FROM dispatches"""
)
def dispatch_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: dispatch records whose target is an object, a JSON text, or a text that holds a quoted JSON text."""
    t = load(spark, d, "dispatches").withColumn("o", F.expr("to_json(named_struct('address', concat(id % 900, ' ', street), 'lat', lat, 'include_in_training', id % 2 = 0, 'radio_channel', if(id % 5 > 0, 'CH \"2\"', null)))"))
    quoted = lambda c: F.expr(f"substr(to_json(named_struct('t', {c})), 6, length(to_json(named_struct('t', {c}))) - 6)")
    t = t.withColumn("q", quoted("o"))
    target = F.when(F.col("id") % 3 == 0, F.col("o")).when(F.col("id") % 3 == 1, F.col("q")).otherwise(quoted("q"))
    path = fresh(spark, "feeds")
    t.select(F.concat(F.lit('{"dispatch_id":"'), "dispatch_id", F.lit('","target":'), target, F.lit("}"))).write.text(path)
    r = feeds.dispatches(spark, path)
    return r.select("dispatch_id", *[F.col(f"target.{c}").alias(c) for c in ("address", "lat", "include_in_training")], F.col("target.radio_channel").alias("channel"))


@query("SELECT concat('t', event_id) AS timestamp, event_type AS tone, value AS score, concat(user_id, ',', user_id * 2) AS freqs FROM events WHERE event_id % 7 > 0")
def tone_history_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13: tone history lines of which each seventh breaks off."""
    line = "to_json(named_struct('timestamp', concat('t', event_id), 'tone', event_type, 'score', value, 'freqs', array(user_id, user_id * 2)))"
    path = fresh(spark, "feeds")
    spark.read.parquet(f"{d}/events.parquet").selectExpr(f"if(event_id % 7 = 0, substr({line}, 1, 20), {line})").write.text(path)
    return feeds.tone_history(spark, path).select("timestamp", "tone", "score", F.array_join(F.transform("freqs", lambda f: f.cast("long").cast("string")), ",").alias("freqs"))


_ROUND = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'E1' END AS units, CASE WHEN o_orderkey % 11 = 0 THEN 'Unknown' ELSE 'Medical Aid' END AS kind, o_orderkey % 7 > 0 AS located,
 CASE o_orderkey % 5 WHEN 0 THEN '12' WHEN 1 THEN 'Grid 135' WHEN 2 THEN '' END AS grid, CASE o_orderkey % 6 WHEN 0 THEN 'Engine 1 Grade 7' WHEN 1 THEN 'engine 1 ladder 2 map grid 200' WHEN 2 THEN 'Engine 1, engine  1' WHEN 3 THEN 'grid 0' WHEN 4 THEN 'engine 1 engine 2' END AS said FROM {orders}"""


@query(
    f"WITH t AS ({_ROUND.format(orders='orders')}) SELECT id, located AND units <> '' AND kind <> 'Unknown' AND (coalesce(TRY_CAST(regexp_replace(grid, '[^0-9]', '', 'g') AS INT) BETWEEN 1 AND 134, false) OR coalesce(said IN ('Engine 1 Grade 7', 'Engine 1, engine  1'), false)) AS complete FROM t"
)
def complete_rounds(spark: SparkSession, d: str) -> DataFrame:
    """TXT-08: whether a round is complete, by its parsed grid, one in its text or a unit named twice."""
    t = spark.sql(_ROUND, orders=spark.read.parquet(f"{d}/orders.parquet"))
    kind = F.when(F.col("kind") == "Unknown", transcript.UNKNOWN).otherwise(F.col("kind"))
    return t.select("id", transcript.round_complete(F.col("units"), kind, F.col("located"), F.col("grid"), F.col("said"), ("Engine", "Ladder")).alias("complete"))


@query("SELECT 'first' AS run, event_type AS metric, round(avg(value), 6) AS score, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'second', event_type, round(avg(value), 6), count(*) FROM events WHERE user_id % 3 > 0 GROUP BY 2")
def evaluation_history(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06: the scores of two runs, the first one tried again with other rows before; a run has the rows of its last try."""
    e, path = spark.read.parquet(f"{d}/events.parquet"), fresh(spark, "feeds")
    for run, rows in (("first", e.where("user_id % 2 = 0")), ("second", e.where("user_id % 3 > 0")), ("first", e)):
        append_evaluation(rows.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("n")), path, run)
    return spark.read.parquet(path).select("run", "metric", "score", "n")
