"""Feeds and files of the dispatch side: addresses, first-due units, closures, dispatch records, tones, clips, golden texts (SRC-05, 06, 08..10, 12, 13, 15)."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sirenflow.functions.fuzzy import polyline
from sirenflow.functions.text import blank_to_null
from sirenflow.operators.reports import FIRST_DUE
from sirenflow.sources.readers import _rings, features, listed

#: Address columns taken as they are, fixed values.
ADDRESS_TEXT = ("GIS_ID", "HOUSE", "STREET", "STREETTYPE", "UNIT", "UNITTYPE", "POSTAL", "BLOCK", "PLAN", "LOT", "PLAN_AREA", "FOLIO", "ZONETYPE1", "ZONETYPE2", "ZONETYPE3", "SC_CARD")
CLIP_SECONDS, CLIP_LEAST = 3.5, 1.0
#: Highest bit of a municipal closure type that shuts the road, and those that leave access only; fixed values.
NO_ACCESS_BIT, ACCESS_ONLY_BITS = 262144, (65536, 32768, 16384)
CLOSURE = ("closure_id", "street_name", "source", "closure_type", "emergency_access", "headline", "description", "points", "lat", "lng", "start_time", "end_time")


def addresses(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """SRC-05 of a feature collection."""
    f = features(spark, path, split)
    point = F.from_json("coordinates", "array<double>")
    ring = F.get(_rings(F.col("kind"), F.col("coordinates")), F.lit(0))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.size(ring)
    is_point = F.col("kind") == "Point"
    return parcels(f.select("props", F.when(is_point, point[1]).otherwise(mean("y")).alias("lat"), F.when(is_point, point[0]).otherwise(mean("x")).alias("lng"), F.monotonically_increasing_id().alias("place")))


def parcels(rows: DataFrame) -> DataFrame:
    """SRC-05, WIN-02: one parcel per ADDRESS, the first by ``place``.

    Rows: props (map<string,string>, upper-case names), lat, lng, place. Blank texts are null and rows without an address
    go. Units count only as plain digits; the date is the first ten characters; status defaults to Active. The place is
    copied to front, centroid and entrance; an unknown place stays null.
    """
    p = lambda k: F.trim(blank_to_null(F.try_element_at("props", F.lit(k))))
    units = F.trim(F.try_element_at("props", F.lit("UNITS")))
    t = rows.select(
        p("ADDRESS").alias("address"), *[p(k).alias(k.lower()) for k in ADDRESS_TEXT], F.trim(F.regexp_replace(p("LEGALDESC"), r"[\n\r]", " ")).alias("legaldesc"),
        F.coalesce(p("STATUS"), F.lit("Active")).alias("status"), F.when(units.rlike(r"^\d+$"), units.try_cast("int")).alias("units"),
        F.substring(F.try_element_at("props", F.lit("EXTRACT_DT")), 1, 10).try_cast("date").alias("extract_dt"), F.lower(p("ADDRESS")).alias("address_normalized"),
        "lat", "lng", *[F.col(k).alias(f"{n}_{k}") for n in ("front", "centroid", "entrance") for k in ("lat", "lng")], "place",
    ).where("address is not null")
    best = t.groupBy("address").agg(F.min_by(F.struct(*[c for c in t.columns if c not in ("address", "place")]), "place").alias("r"))
    return best.select("address", "r.*")


def zone_units(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """SRC-06: (zone_id, unit_id, station, hall_id) of a list or a feature collection; blank rows go, an unknown unit has no hall."""
    row = "struct<zone_id:string,unit_id:string,station:string>"
    z = listed(spark, path, "features", row, split).select(F.col("r").alias("z")).select(F.trim("z.zone_id").alias("zone_id"), F.upper(F.trim("z.unit_id")).alias("unit_id"), F.nullif(F.trim("z.station"), F.lit("")).alias("station"))
    hall = F.try_element_at(F.create_map(*[F.lit(x) for kv in FIRST_DUE.items() for x in kv]), F.col("unit_id"))
    return z.where("zone_id != '' and unit_id != ''").withColumn("hall_id", hall)


def _instant(c: Column) -> Column:
    """A time of ISO form, seconds or none."""
    return F.regexp_replace(c, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d)(?![:\d])", "$1:00").try_cast("timestamp")


def _middle(points: Column, k: str) -> Column:
    return F.get(points, F.floor(F.size(points) / 2).cast("int"))[k]


def open511(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """SRC-08: closures of an Open511 event list. Other geometries than points and lines go; no coordinate is made up.

    Times come from the first interval, else the first recurring schedule (from 00:00 to 23:59:59), else the creation.
    """
    event = """struct<id:string,road_name:string,severity:string,headline:string,description:string,created:string,geography:struct<type:string,coordinates:string>,
      schedule:struct<intervals:array<string>,recurring_schedules:array<struct<start_date:string,end_date:string,daily_start_time:string,daily_end_time:string>>>>"""
    e = listed(spark, path, "events", event, split).select("r.*")
    xy = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    text, line = F.col("geography.coordinates"), F.col("geography.type") == "LineString"
    pts = F.when(F.col("geography.type") == "Point", F.array(xy(F.from_json(text, "array<double>")))).when(line, F.transform(F.from_json(text, "array<array<double>>"), xy))
    e = e.withColumn("points", F.filter(pts, lambda p: p["x"].isNotNull() & p["y"].isNotNull())).where(F.size("points") > 0)
    parts = F.split(F.get("schedule.intervals", F.lit(0)), "/")
    parts, again, major = F.when(F.size(parts) == 2, parts), F.get("schedule.recurring_schedules", F.lit(0)), F.upper(F.coalesce("severity", F.lit("MINOR"))) == "MAJOR"
    at = lambda d, t, default, sec: F.concat(again[d], F.lit("T"), F.coalesce(again[t], F.lit(default)), F.lit(f":{sec}Z"))
    first = F.coalesce(_instant(parts[0]), F.when(parts.isNull(), _instant(at("start_date", "daily_start_time", "00:00", "00"))), _instant(F.col("created")))
    last = F.coalesce(_instant(parts[1]), F.when(parts.isNull(), _instant(at("end_date", "daily_end_time", "23:59", "59"))))
    named = lambda c, default: F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)))
    return e.select(
        F.col("id").alias("closure_id"), named("road_name", "Regional Corridor").alias("street_name"), F.lit("DriveBC Open511").alias("source"),
        F.when(major, "FULL_CLOSURE").otherwise("LANE_RESTRICTION").alias("closure_type"), F.when(major, "NO_ACCESS").otherwise("CAUTION").alias("emergency_access"),
        named("headline", "TRAFFIC ALERT").alias("headline"), named("description", "Active traffic event.").alias("description"), "points",
        _middle(F.col("points"), "y").alias("lat"), _middle(F.col("points"), "x").alias("lng"), first.alias("start_time"), last.alias("end_time"),
    )


def _points(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [[x, y] for y, x in polyline(t)] if t else [])


def municipal_issues(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: closures of municipal issue files. A file's one encoded line is dealt out to the geometries in order, NumPoints each.

    Access follows the highest bit of the closure type, and a text that says road closed or full closure leaves access
    only. Geometries without points go.
    """
    geom = "struct<NumPoints:int,MarkerInfo:struct<RoadClosureType:long,LocationName:string>>"
    desc = "struct<BaseDescription:string,Headline:string,BaseLocationDescription:string,ProposedStartTimeUtcEpochMillis:long,ProposedEndTimeUtcEpochMillis:long>"
    issue = f"struct<IssueId:string,Source:string,Geometry:array<{geom}>,Description:{desc},TableViewInfo:struct<Location:string>>"
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"struct<CoordsEncoded:string,Issues:array<{issue}>>").alias("j"))
    g = f.select("file", F.posexplode("j.Issues").alias("i", "issue")).select("file", "i", "issue", F.posexplode("issue.Geometry").alias("k", "g"))
    n = F.coalesce("g.NumPoints", F.lit(0))
    taken = F.sum(n).over(Window.partitionBy("file").orderBy("i", "k")) - n
    decoded = f.select("file", F.pandas_udf(_points, "array<array<double>>")("j.CoordsEncoded").alias("line"))
    lines = decoded.select("file", F.transform("line", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("line"))
    g = g.withColumns({"n": n, "taken": taken}).where("n > 0").join(lines, "file").withColumn("points", F.slice("line", (F.col("taken") + 1).cast("int"), F.col("n"))).where(F.size("points") > 0)
    kind, d = F.coalesce("g.MarkerInfo.RoadClosureType", F.lit(0)), F.col("issue.Description")
    top = F.when(kind > 0, F.pow(F.lit(2.0), F.floor(F.log2(kind.cast("double")))).cast("long")).otherwise(0)
    said = F.lower(F.concat_ws(" | ", d["BaseDescription"], d["Headline"])).rlike("road closed|full closure")
    access = F.when(top == NO_ACCESS_BIT, "NO_ACCESS").when(top.isin(*ACCESS_ONLY_BITS) | said, "ACCESS_ONLY").otherwise("CAUTION")
    some = lambda *c: F.trim(F.coalesce(*[F.nullif(x, F.lit("")) for x in c]))
    name = some(F.col("g.MarkerInfo.LocationName"), F.col("issue.TableViewInfo.Location"), d["BaseLocationDescription"], F.lit("Local Road"))
    moment = lambda c: F.when(c != 0, F.timestamp_millis(c))
    return g.select(
        F.concat_ws("_", F.lit("muni"), "issue.IssueId", F.col("k").cast("string")).alias("closure_id"), name.alias("street_name"), some(F.col("issue.Source"), F.lit("City of Coquitlam")).alias("source"),
        F.when(access == "NO_ACCESS", "FULL_CLOSURE").otherwise("LANE_RESTRICTION").alias("closure_type"), access.alias("emergency_access"), some(d["Headline"], name).alias("headline"),
        some(F.trim(d["BaseDescription"]), F.lit("Local road construction or restriction.")).alias("description"), "points", _middle(F.col("points"), "y").alias("lat"), _middle(F.col("points"), "x").alias("lng"),
        moment(d["ProposedStartTimeUtcEpochMillis"]).alias("start_time"), moment(d["ProposedEndTimeUtcEpochMillis"]).alias("end_time"),
    )


TARGET = "struct<address:string,subaddress:string,intersection:string,lat:double,lng:double,map_grid:string,verified_map_grid:string,radio_channel:string,verified_talkgroup:string,tone_name:string,include_in_training:boolean>"


def with_target(d: DataFrame) -> DataFrame:
    """SRC-10: ``target`` as a struct, whether it was read as a JSON text, an object or a text that holds a quoted JSON text."""
    kind = d.schema["target"].dataType.simpleString()
    if not kind.startswith("string"):
        return d.withColumn("target", F.from_json(F.to_json("target"), TARGET))
    plain = F.when(F.col("target").startswith('"'), F.get_json_object(F.concat(F.lit('{"t":'), F.col("target"), F.lit("}")), "$.t")).otherwise(F.col("target"))
    return d.withColumn("target", F.from_json(plain, TARGET))


def dispatches(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """SRC-10: dispatch records of a JSON or Parquet folder, with a typed target."""
    return with_target(spark.read.format(form).load(path))


def tone_history(spark: SparkSession, path: str, schema: str = "timestamp string, tone string, score double, freqs array<double>") -> DataFrame:
    """SRC-13: tone history lines; lines that are not JSON are left out."""
    return spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")


def clips(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: (clip_id, rate, pcm) of 16-bit WAV files: first channel, first 3.5 s; clips under a second or unreadable are left out.

    A task decodes a file at a time; clip_id is the file name without its ending.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate, wide, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
                        data = w.readframes(int(CLIP_SECONDS * rate))
                except (wave.Error, EOFError):
                    continue
                pcm = np.frombuffer(data, "<i2")[::wide] if width == 2 else np.empty(0, "<i2")
                if len(pcm) >= CLIP_LEAST * rate:
                    yield pd.DataFrame({"path": [name], "rate": [rate], "pcm": [pcm.tobytes()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, rate int, pcm binary").select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("clip_id"), "rate", "pcm")


#: Other names of the golden texts' keys, fixed values.
GOLDEN = {"transcript": ("transcript",), "address": ("address",), "units": ("units",), "priority": ("priority", "response"), "grid": ("grid", "map_grid")}


def golden_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: (file, transcript, address, units, priority, grid) of expected-result texts; a text without keys is a transcript."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    pairs = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"), x.contains(":").alias("ok"))), lambda p: p["ok"])
    keys = [k for names in GOLDEN.values() for k in names]
    t = t.withColumn("p", F.filter(pairs, lambda p: p["key"].isin(*keys)))
    first = lambda names: F.get(F.filter("p", lambda p: p["key"].isin(*names)), F.lit(0))["value"]
    return t.select("file", *[(F.when(F.size("p") == 0, F.trim("value")).otherwise(first(n)) if k == "transcript" else first(n)).alias(k) for k, n in GOLDEN.items()])
