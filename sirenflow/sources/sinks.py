"""Written tables: closure sync, training manifest, evaluation history, street-view overrides (SNK-03, 05, 06, 08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sirenflow.functions.text import lookup_address
from sirenflow.operators.dispatch import sync_closures, training_rows

OVERRIDE = ("streetview_heading", "streetview_pitch", "streetview_fov")


def write_closures(spark: SparkSession, existing: str, notices: DataFrame, now, out: str) -> None:
    """SNK-03: the synchronised closure table as a new snapshot at ``out``; the old snapshot stays for readers of it."""
    sync_closures(spark.read.parquet(existing), notices, now).write.mode("overwrite").parquet(out)


def training_manifest(d: DataFrame) -> DataFrame:
    """SNK-05: (file_name, verified_transcript, raw_transcript) of the training rows; file_name is <dispatch_id>.wav."""
    return training_rows(d).select(F.concat("dispatch_id", F.lit(".wav")).alias("file_name"), "verified_transcript", "raw_transcript")


def write_manifest(d: DataFrame, path: str) -> None:
    """SNK-05 as CSV with a header, ordered by file name over all part files."""
    training_manifest(d).orderBy("file_name").write.mode("overwrite").option("header", True).csv(path)


def write_listed(d: DataFrame, path: str, head: str, tail: str, per_file: int = 50_000) -> None:
    """JSON files of ``head``, the texts ``value`` in the order of the whole number ``key`` with commas between, and ``tail``.

    A file is one task's work and holds ``per_file`` values of key; rows of one key share a file, and rows without a key share one.
    """
    part = F.coalesce(F.floor(F.col("key") / per_file), F.lit(-1)).alias("part")
    order = Window.partitionBy("part").orderBy("key", "value")
    # head and tail go with the first and last row: as rows of their own, joined by a union, the planner may leave them in another task and so in another file
    rows = d.select(part, "key", "value").withColumns({"first": F.lag("part").over(order).isNull(), "last": F.lead("part").over(order).isNull()})
    line = F.concat(F.when(F.col("first"), head + "\n").otherwise(""), "value", F.when(F.col("last"), "\n" + tail).otherwise(","))
    rows.sortWithinPartitions("part", "key", "last").select("part", line.alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def write_features(d: DataFrame, path: str, key: str, per_file: int = 50_000) -> None:
    """Feature collections of the columns ``properties`` and ``geometry``, see :func:`write_listed`."""
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", "geometry"), {"ignoreNullFields": "false"})
    head = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:4326"}},"features":['
    write_listed(d.select(F.col(key).alias("key"), text.alias("value")), path, head, "]}", per_file)


def append_evaluation(metrics: DataFrame, path: str, run: str | None = None) -> None:
    """SNK-06: adds the evaluation rows of one run to the history table, in the folder run=<name>; a retry replaces its own rows only.

    Without a name the run is named after a digest of its rows.
    """
    if run is None:
        run = str(metrics.agg(F.coalesce(F.bit_xor(F.xxhash64(F.to_json(F.struct("*")))), F.lit(0)).alias("h")).first()["h"])
    metrics.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def street_view_merge(parcels: DataFrame, overrides: DataFrame) -> DataFrame:
    """SNK-08: parcels with street-view overrides; an override that no parcel fits becomes a parcel.

    Parcels: gis_id, clean_address, front_lat, front_lng and the street-view columns; overrides: address, heading, pitch,
    fov, front_lat, front_lng. An override belongs to the parcel whose address or id equals its cleaned, else its raw
    address; else to one whose address holds it from a word's start. Lowest gis_id wins; of several overrides of a parcel
    the last by address. Front points are filled only where they are empty.
    """
    raw = F.upper(F.trim("address"))
    o = overrides.select(raw.alias("raw"), F.coalesce(F.nullif(lookup_address(F.col("address")), F.lit("")), raw).alias("clean"), F.col("heading").alias("h"), F.col("pitch").alias("p"), F.col("fov").alias("v"), F.col("front_lat").alias("la"), F.col("front_lng").alias("lo")).where("raw != ''").dropDuplicates(["raw"])
    p = parcels.select("gis_id", "clean_address")
    hits = None
    for rank, (mine, theirs) in enumerate((("clean", "clean_address"), ("raw", "clean_address"), ("clean", "gis_id"), ("raw", "gis_id"))):
        one = o.select("raw", F.col(mine).alias("k")).join(p.select(F.col(theirs).alias("k"), "gis_id"), "k").select("raw", F.lit(rank).alias("rank"), "gis_id")
        hits = one if hits is None else hits.unionByName(one)
    equal = hits.groupBy("raw").agg(F.min(F.struct("rank", "gis_id")).alias("b")).select("raw", "b.gis_id")
    first = lambda c: F.substring_index(c, " ", 1)
    words = p.select("gis_id", "clean_address", F.explode(F.array_distinct(F.split("clean_address", " "))).alias("w"))
    rest = o.join(equal.select("raw"), "raw", "left_anti").select("raw", "clean", first(F.col("clean")).alias("w"))
    held = rest.join(words, "w").where(F.contains("clean_address", "clean")).groupBy("raw").agg(F.min("gis_id").alias("gis_id"))
    found = equal.unionByName(held)
    m = o.join(found, "raw", "left")
    mine = m.where("gis_id is not null").groupBy("gis_id").agg(F.max(F.struct("raw", "h", "p", "v", "la", "lo")).alias("o"))
    j = parcels.join(mine, "gis_id", "left")
    new = {"streetview_heading": "h", "streetview_pitch": "p", "streetview_fov": "v"}
    cols = {c: F.when(F.col("o").isNotNull(), F.col(f"o.{f}")).otherwise(F.col(c)) for c, f in new.items()}
    cols |= {c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.col(f"o.{f}"), F.col(c)) for c, f in (("front_lat", "la"), ("front_lng", "lo"))}
    kept = j.withColumns(cols).select(*parcels.columns)
    fresh = m.where("gis_id is null").dropDuplicates(["clean"]).select(F.col("clean").alias("gis_id"), F.col("clean").alias("clean_address"), F.col("la").alias("front_lat"), F.col("lo").alias("front_lng"), F.col("h").alias("streetview_heading"), F.col("p").alias("streetview_pitch"), F.col("v").alias("streetview_fov"))
    return kept.unionByName(fresh, allowMissingColumns=True)
