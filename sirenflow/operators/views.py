"""Views of dispatch records (CLN-22, 24, 25) and the comparison of two views (QC-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tone -> beginnings and contained words of units that imply it, fixed values.
IMPLIED = {"engine": (("e",), ("engine",)), "rescue": (("m", "r"), ("medic", "rescue")), "chief": (("c",), ("car", "chief"))}


def call_tones(tone_name: Column, verified: Column, responding: Column) -> Column:
    """CLN-22: recorded tones (by the apparatus they name), then those the units imply, each once. Verified units win if there are any."""
    clean = lambda t: F.lower(F.trim(t))
    named = lambda t: F.when(t.contains("chief"), "chief").when(t.contains("engine"), "engine").when(t.contains("rescue"), "rescue").otherwise(t)
    said = F.filter(F.transform(F.split(F.coalesce(tone_name, F.lit("")), ","), lambda t: named(clean(t))), lambda t: t != "")
    units = F.coalesce(F.when(F.size(verified) > 0, verified), responding, F.array().cast("array<string>"))

    def implied(u: Column) -> Column:
        hits = [F.when(F.regexp_like(clean(u), F.lit(f"^(?:{'|'.join(a)})|{'|'.join(b)}")), F.lit(t)) for t, (a, b) in IMPLIED.items()]
        return F.array_compact(F.array(*hits))

    return F.array_distinct(F.concat(said, F.flatten(F.transform(units, implied))))


def current(d: DataFrame) -> DataFrame:
    """CLN-24: one flat row per dispatch: the verified value, else the target's, else the record's. Unknown coordinates stay null.

    Columns: id, dispatch_id, target (struct), verified_address, address, verified_incident, incident_type, verified_units,
    responding_units, lat, lng, verify_location, confidence_score, audio_url, raw_transcript. Missing texts are empty.
    """
    t = lambda k: F.col("target")[k]
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    text = lambda *c: F.coalesce(some(*c), F.lit(""))
    none = F.array().cast("array<string>")
    units = F.when(F.size("verified_units") > 0, F.col("verified_units")).when(F.size("responding_units") > 0, F.col("responding_units")).otherwise(none)
    sure = F.when(F.coalesce(F.col("confidence_score"), F.lit(0)) != 0, F.col("confidence_score") >= 90).otherwise(True)
    return d.select(
        "id", "dispatch_id", some(F.col("verified_address"), t("address"), F.col("address")).alias("address"), some(F.col("verified_incident"), F.col("incident_type")).alias("incident_type"),
        units.alias("responding_units"), text(t("subaddress")).alias("subaddress"), text(t("intersection")).alias("intersection"), F.coalesce(t("lat"), F.col("lat")).alias("lat"), F.coalesce(t("lng"), F.col("lng")).alias("lng"),
        F.coalesce(F.col("verify_location"), sure).alias("verify_location"), text(t("verified_map_grid"), t("map_grid")).alias("map_grid"), text(t("verified_talkgroup"), t("radio_channel")).alias("radio_channel"),
        text(t("tone_name")).alias("tone_name"), text(F.col("audio_url")).alias("audio_url"), text(F.col("raw_transcript")).alias("raw_transcript"),
    )


def with_building(targets: DataFrame, buildings: DataFrame) -> DataFrame:
    """CLN-25: targets whose address holds a known building's name, address or alias take its address, name and entrance.

    Targets: address, lat, lng and others; buildings: position, name, address, aliases, lat, lng, entrance_lat,
    entrance_lng, the lowest position wins. Distinct addresses and the buildings' words meet by three letters, a word's
    first, so neither list is gathered anywhere. Others keep their values and a null building.
    """
    b = buildings.select("position", "name", F.col("address").alias("b_address"), F.coalesce("entrance_lat", "lat").alias("b_lat"), F.coalesce("entrance_lng", "lng").alias("b_lng"),
        F.explode(F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name", "address")), lambda w: F.upper(w)), lambda w: w != ""))).alias("word"))
    b = b.withColumn("g", F.substring("word", 1, 3))
    raw = targets.select(F.col("address").alias("__a")).where("__a is not null").distinct().withColumn("raw", F.upper(F.trim("__a")))
    pieces = F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("raw"), F.lit(1))), lambda i: F.substr(F.col("raw"), i, k)))))
    met = raw.withColumn("g", F.explode(pieces)).join(b, "g").where(F.contains("raw", "word"))
    best = met.groupBy("__a").agg(F.min(F.struct("position", "name", "b_address", "b_lat", "b_lng")).alias("__b"))
    t = targets.join(best, F.col("address") == F.col("__a"), "left")
    new = {"address": "b_address", "lat": "b_lat", "lng": "b_lng"}
    keep = [F.coalesce(F.col("__b")[new[c]], F.col(c)).alias(c) if c in new else F.col(c) for c in targets.columns]
    return t.select(*keep, F.col("__b.name").alias("building"))


def view_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """QC-05: (key, field, old, new) where two views of the same records differ; null equals null."""
    side = lambda t, n: t.select(key, *[F.col(f).cast("string").alias(f"{n}_{f}") for f in fields])
    rows = [F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new"))) for f in fields]
    j = side(old, "o").join(side(new, "n"), key, "full")
    return j.select(key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(key, "r.*")
