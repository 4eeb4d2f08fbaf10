"""Municipal layers and feeds as typed tables: one pass of JSON functions each, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenflow.functions.text import blank_to_null, safe_bool, safe_int
from sirenflow.sources.json_parts import json_objects

_FEATURE = "struct<properties:map<string,string>,attributes:map<string,string>,geometry:struct<type:string,coordinates:string,x:double,y:double>>"


def listed(spark: SparkSession, path: str, member: str, row: str, split: bool = False) -> DataFrame:
    """(r): the objects of a file's list ``member``, or of a file that is a list, parsed as ``row``.

    ``split`` reads large files in byte ranges by many tasks, each file twice; without it a file is one row of one task, which suits many
    small files and ends at 2 GB.
    """
    if split:
        return json_objects(spark, path).where(F.col("member").isin("", member)).select(F.from_json("text", row).alias("r")).where("r is not null")
    raw = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json("value", f"struct<{member}:array<{row}>>")[member], F.from_json("value", f"array<{row}>"))
    return raw.select(F.explode(both).alias("r")).where("r is not null")


def features(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """(props map<string,string> with upper-case names, kind, coordinates as JSON text, x, y) of a feature collection."""
    f = listed(spark, path, "features", _FEATURE, split).select(F.col("r").alias("f"))
    props = F.coalesce("f.properties", "f.attributes")
    upper = F.map_from_entries(F.transform(F.map_entries(props), lambda e: F.struct(F.upper(e["key"]), e["value"])))
    return f.select(upper.alias("props"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.geometry.x").alias("x"), F.col("f.geometry.y").alias("y"))


def _rings(kind, coordinates):
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    xy = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return F.when(kind == "Polygon", F.transform(one, xy)).otherwise(F.transform(F.flatten(many), xy))


def roads(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """SRC-01: operating roads with a name; lines as array<array<struct<x,y>>>."""
    f, p = features(spark, path, split), lambda k: blank_to_null(F.col("props")[k])
    line = F.from_json("coordinates", "array<array<double>>")
    lines = F.from_json("coordinates", "array<array<array<double>>>")
    xy = lambda r: F.transform(r, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))
    ok = F.coalesce(F.upper(F.trim(F.col("props")["STATUS"])), F.lit("")).isin("", "OPERATING") & p("FULLNAME").isNotNull()
    return f.where(ok).select(
        F.trim(p("FULLNAME")).alias("fullname"), p("ROADNAME").alias("roadname"), p("ROADTYPE").alias("roadtype"), safe_int(p("SPEED")).alias("speed"), safe_bool(p("TRUCKROUTE")).alias("truck_route"),
        *[safe_int(p(k.upper().replace("_", ""))).alias(k) for k in ("left_begin", "left_end", "right_begin", "right_end")],
        F.when(F.col("kind") == "LineString", F.array(xy(line))).otherwise(F.transform(lines, xy)).alias("lines"),
    )


def zones(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """SRC-02: zones with a name; rings as array<array<struct<x,y>>>."""
    f = features(spark, path, split)
    name = blank_to_null(F.col("props")["MAP_NAME"])
    return f.where(name.isNotNull()).select(F.trim(name).alias("map_name"), _rings(F.col("kind"), F.col("coordinates")).alias("rings"))


def boundary(spark: SparkSession, path: str, name: str = "City") -> DataFrame:
    """SRC-03: the first feature, with a default name."""
    one = "struct<features:array<struct<properties:struct<NAME:string>,geometry:struct<type:string,coordinates:string>>>>"
    g = spark.read.text(path, wholetext=True).select(F.from_json("value", one).alias("j")).select(F.get("j.features", F.lit(0)).alias("f")).where("f is not null")
    return g.select(F.coalesce("f.properties.NAME", F.lit(name)).alias("name"), _rings(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("rings"))


def road_names(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: distinct names from a feature list, a list of strings or a list of objects."""
    raw = spark.read.text(path, wholetext=True)
    keys = lambda m: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in ("ROAD_NAME", "road_name", "RoadName")])
    a = raw.select(F.explode(F.from_json("value", "struct<features:array<struct<attributes:map<string,string>>>>").getField("features")).alias("f")).select(keys(F.col("f.attributes")).alias("n"))
    b = raw.select(F.explode(F.from_json("value", "array<string>")).alias("n")).where("n not like '{%'")
    c = raw.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m")).select(keys(F.col("m")).alias("n"))
    return a.union(b).union(c).select(F.trim("n").alias("road_name")).where("road_name != ''").distinct().withColumn("road_name_normalized", F.upper("road_name"))


def hydrants(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """SRC-07: pages of hydrants with an id and a place; status and flow class stay null where unknown."""
    p = lambda k: blank_to_null(F.col("props")[k])
    return features(spark, path, split).where(safe_int(p("OBJECTID")).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        safe_int(p("OBJECTID")).alias("object_id"), F.coalesce(p("GIS_ID"), F.concat(F.lit("H-"), p("OBJECTID"))).alias("gis_id"), p("STATUS").alias("status"), p("FLOW_CLASS").alias("flow_class"), F.round("y", 6).alias("lat"), F.round("x", 6).alias("lng"))


def vocabulary(table: DataFrame, category: str) -> list[str]:
    """SRC-11: active terms of one category in order (a bounded word list); an empty category is an error."""
    rows = table.where((F.col("category") == category) & F.col("is_active")).orderBy(F.length("term").desc() if category == "call_type" else "sort_order", "term").select("term").collect()
    if not rows:
        raise ValueError(f"vocabulary has no active {category}")
    return [r["term"] for r in rows]


_RECORD = "struct<dispatch_id:string,address:string,incident_type:string,confidence_score:double>"
CHANGE = f"eventType string, event string, new {_RECORD}, payload {_RECORD}, ts timestamp, seq long"


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: dispatch changes of three envelope shapes as (op, record, ts, seq)."""
    raw = spark.readStream.schema(CHANGE + ", dispatch_id string, address string, incident_type string, confidence_score double").json(path)
    bare = F.when(F.col("dispatch_id").isNotNull(), F.struct("dispatch_id", "address", "incident_type", "confidence_score"))
    return raw.select(F.upper(F.coalesce("eventType", "event", F.lit("INSERT"))).alias("op"), F.coalesce("new", "payload", bare).alias("record"), "ts", "seq").where("record.dispatch_id is not null")
