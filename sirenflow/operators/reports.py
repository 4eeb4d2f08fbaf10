"""Import summaries, accuracy reports, street rankings and table checks (AGG-04..16, JN-17, SNK-07, QC-01, QC-02, CLN-17, CLN-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Long and short street types for comparison, fixed values.
COMPARED = (
    ("lane", "ln"), ("street", "st"), ("avenue", "ave"), ("road", "rd"), ("drive", "dr"), ("crescent", "cres"),
    ("boulevard", "blvd"), ("place", "pl"), ("court", "ct"), ("highway", "hwy"),
)
#: First-due unit -> hall, fixed values.
FIRST_DUE = {"E1": "1", "E2": "2", "E3": "3", "Q5": "3", "E4": "4"}
HALL_ORDER = ("1", "2", "3", "4", "OTHER")
TOP_PEAKS, BUCKET_HZ = 10, 5
OPERATIONAL = 0.20


def comparable(c: Column) -> Column:
    """CLN-17: lower case, short street types, letters and digits only; null is empty."""
    s = F.lower(F.coalesce(c, F.lit("")))
    for long, short in COMPARED:
        s = F.regexp_replace(s, rf"\b{long}\b", short)
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def channel_name(c: Column) -> Column:
    """CLN-21: without the city and a leading "talk group"; the name itself if nothing is left."""
    s = F.trim(F.regexp_replace(c, r"(?i)\bcoquitlam\b", ""))
    s = F.trim(F.regexp_replace(s, r"(?i)^talk\s*group\b", ""))
    return F.when(s == "", c).otherwise(s)


def address_match(a: Column, b: Column) -> Column:
    """AGG-12: one comparable form holds the other, or both are intersections of the same streets; empty never matches."""
    ca, cb = comparable(a), comparable(b)
    parts = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.lower(c), r"\s+and\s+|\s*&\s*"), lambda p: F.trim(p) != ""), comparable)))
    crossing = F.lower(a).rlike("and|&") | F.lower(b).rlike("and|&")
    return (ca != "") & (cb != "") & (ca.contains(cb) | cb.contains(ca) | (crossing & (parts(a) == parts(b))))


def match_rates(pairs: DataFrame) -> DataFrame:
    """AGG-10: share of pairs that agree per field, and the mean of the five.

    Columns: ref_ and hyp_ address, units (array), incident, grid, channel, text. Blank and null agree. Where both
    texts refer to dispatch for the location, address, grid and channel count as agreeing. No pairs: nulls.
    """
    low = lambda n: F.lower(F.trim(F.coalesce(F.col(n), F.lit(""))))
    plain = lambda n: F.trim(F.coalesce(F.col(n), F.lit("")))
    units = lambda n: F.array_sort(F.array_distinct(F.coalesce(F.col(n), F.array().cast("array<string>"))))
    vague = lambda n: F.coalesce(F.lower(F.col(n)).rlike("contact dispatch|location information"), F.lit(False))
    both = vague("ref_text") & vague("hyp_text")
    agree = {
        "address": both | (low("ref_address") == low("hyp_address")), "units": units("ref_units") == units("hyp_units"), "incident": low("ref_incident") == low("hyp_incident"),
        "grid": both | (plain("ref_grid") == plain("hyp_grid")), "channel": both | (plain("ref_channel") == plain("hyp_channel")),
    }
    rates = pairs.agg(*[F.avg(v.cast("double")).alias(k) for k, v in agree.items()])
    return rates.withColumn("overall", sum((F.col(k) for k in agree), F.lit(0.0)) / len(agree))


def import_summary(parcels: DataFrame) -> DataFrame:
    """AGG-04: rows, with geometry, distinct zones, above 50 units, with a unit, with a front point of their own."""
    return parcels.agg(
        F.count("*").alias("total"), F.count("geom").alias("with_geometry"), F.count_distinct("zone_id").alias("zones"), F.count_if(F.col("units") > 50).alias("high_rises"),
        F.count_if(F.col("unit") != "").alias("multi_unit"), F.count_if(F.col("front_lat") != F.col("lat")).alias("front_aligned"),
    )


def streets_in_grid(parcels: DataFrame) -> DataFrame:
    """AGG-07: distinct upper-case streets of each zone."""
    return parcels.where("zone_id is not null and street != ''").select("zone_id", F.upper("street").alias("street")).distinct()


def top_streets(parcels: DataFrame, limit: int = 100) -> DataFrame:
    """AGG-15: streets with the most parcels, ties by name; the limit is the report."""
    return parcels.where("street != ''").groupBy("street").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "street").limit(limit)


def corrected_streets(d: DataFrame) -> DataFrame:
    """AGG-14: verified streets of reviewed dispatches whose own street differs, with counts."""

    def street(c: Column) -> Column:
        head = F.trim(F.substring_index(c, ",", 1))
        return F.initcap(F.trim(F.when(head.rlike(r"^\d+\s+"), F.regexp_replace(head, r"^\d+\s+", "")).otherwise(c)))

    pairs = d.where("feedback_submitted").select(street(F.col("verified_address")).alias("street"), street(F.col("address")).alias("own"))
    return pairs.where("street != '' and own != '' and street != own").groupBy("street").agg(F.count("*").alias("n"))


def frequency_histogram(clips: DataFrame, top: int = TOP_PEAKS) -> DataFrame:
    """AGG-13: the ``top`` most frequent 5 Hz buckets per category and over all clips (category 'All'), ties by bucket.

    Clips: category, freqs (array of double). One pass counts both levels; a null category stays null.
    """
    f = clips.select("category", F.explode("freqs").alias("f")).where("f is not null").select("category", (F.bround(F.col("f") / BUCKET_HZ) * BUCKET_HZ).cast("long").alias("bucket"))
    n = f.groupingSets([["category", "bucket"], ["bucket"]], "category", "bucket").agg(F.grouping("category").alias("every"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("every", "category").orderBy(F.desc("n"), "bucket"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top).select(F.when(F.col("every") == 1, "All").otherwise(F.col("category")).alias("category"), "bucket", "n", "rank")


def closures_by_hall(closures: DataFrame, zones: DataFrame, home: str = "1") -> DataFrame:
    """JN-17: closures with the hall of their zone's first-due unit (OTHER when unknown), home hall first, newest start first.

    Closures: closure_id, zone_id, start_time; zones: zone_id, unit_id, a row a zone.
    """
    hall_of = F.create_map(*[F.lit(x) for kv in FIRST_DUE.items() for x in kv])
    order = [home, *[h for h in HALL_ORDER if h != home]] if home in HALL_ORDER else list(HALL_ORDER)
    out = closures.join(zones.select("zone_id", "unit_id"), "zone_id", "left")
    out = out.withColumn("hall", F.coalesce(F.try_element_at(hall_of, F.col("unit_id")), F.lit("OTHER")))
    out = out.withColumn("place", F.array_position(F.array(*[F.lit(h) for h in order]), F.col("hall")))
    return out.select("closure_id", "zone_id", "hall", "place", "start_time").orderBy("place", F.desc_nulls_last("start_time"), "closure_id")


def with_audio_url(d: DataFrame) -> DataFrame:
    """SNK-07: a missing audio URL becomes /api/audio/<dispatch_id>.wav; without an id it stays null."""
    return d.withColumn("audio_url", F.coalesce("audio_url", F.concat(F.lit("/api/audio/"), F.col("dispatch_id"), F.lit(".wav"))))


def missing_suffixes(roads: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """QC-01: road types without an active street_suffix entry."""
    known = vocabulary.where("category = 'street_suffix' and is_active").select(F.col("term").alias("roadtype"))
    return roads.select(F.upper(F.trim("roadtype")).alias("roadtype")).where("roadtype != ''").distinct().join(known, "roadtype", "left_anti")


def require_suffixes(roads: DataFrame, vocabulary: DataFrame) -> None:
    """QC-01 as a guard: raises with the missing types; there are no more of them than road types."""
    lost = [r[0] for r in missing_suffixes(roads, vocabulary).orderBy("roadtype").collect()]
    if lost:
        raise ValueError(f"road types without a street suffix entry: {', '.join(lost)}")


def repeated_keys(t: DataFrame, *keys: str) -> DataFrame:
    """QC-02: keys that more than one row has, with the number of rows."""
    return t.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def row_counts(tables: dict[str, DataFrame], bands: dict[str, tuple[int, int | None]]) -> DataFrame:
    """QC-02: (table, n, low, high, ok) of each table: whether its row count is in its band; a high of null has no upper end."""
    out = None
    for name, t in tables.items():
        low, high = bands.get(name, (0, None))
        ok = (F.col("n") >= low) & (F.col("n") <= high if high is not None else F.lit(True))
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n", F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"), ok.alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def rating(rate: Column) -> Column:
    """AGG-09: perfect at 0, operational below 0.20, else failed; null stays null."""
    return F.when(rate == 0, "perfect").when(rate < OPERATIONAL, "operational").when(rate.isNotNull(), "failed")


def change(old: Column, new: Column) -> Column:
    """AGG-09: improved, regression or unchanged against the old rate; null if either is."""
    return F.when(new < old, "improved").when(new > old, "regression").when(new == old, "unchanged")


def rating_distribution(scores: DataFrame, *keys: str) -> DataFrame:
    """AGG-09: per group: n, the share in percent of each rating, and counts of improved, regression and unchanged rows.

    Scores: the keys, old_rate, new_rate.
    """
    s = scores.withColumns({"__r": rating(F.col("new_rate")), "__c": change(F.col("old_rate"), F.col("new_rate"))})
    share = lambda r: F.round(F.count_if(F.col("__r") == r) * 100.0 / F.count("*"), 4).alias(r)
    return s.groupBy(*keys).agg(F.count("*").alias("n"), *[share(r) for r in ("perfect", "operational", "failed")], *[F.count_if(F.col("__c") == c).alias(c) for c in ("improved", "regression", "unchanged")])


def per_hall(zones: DataFrame) -> DataFrame:
    """AGG-03: zones per hall, null last."""
    return zones.groupBy("hall_id").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("hall_id"))


def per_category(vocabulary: DataFrame) -> DataFrame:
    """AGG-03: active terms per vocabulary category."""
    return vocabulary.where("is_active").groupBy("category").agg(F.count("*").alias("n"))


def same_units(a: Column, b: Column) -> Column:
    """SET-02: whether two unit lists are the same set; null is the empty list."""
    units = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    return units(a) == units(b)


def shared_units(a: Column, b: Column) -> Column:
    """SET-02: the units of both lists, in the first one's order; null is the empty list."""
    return F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def tiles_per_zoom(required: DataFrame, present: DataFrame) -> DataFrame:
    """AGG-17: (z, required, present, missing): different tiles (z, x, y) of each zoom that are needed, there, and needed but not there.

    Zooms of either table are listed; tiles with a null key are left out.
    """
    tile = ["z", "x", "y"]
    r = required.select(*tile).dropna().distinct().withColumn("r", F.lit(1))
    p = present.select(*tile).dropna().distinct().withColumn("p", F.lit(1))
    both = r.join(p, tile, "full_outer")
    return both.groupBy("z").agg(F.count("r").alias("required"), F.count("p").alias("present"), F.count_if(F.col("r").isNotNull() & F.col("p").isNull()).alias("missing"))
