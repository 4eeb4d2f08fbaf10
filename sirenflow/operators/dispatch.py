"""Dispatch review, statistics, responses and closures (FLT, AGG, JN-13..19, WIN-05..07, STR-04)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.functions.geo import haversine_m
from sirenflow.functions.text import unit_class, unit_hall, unit_type
from sirenflow.operators.carry import scanned
from sirenflow.operators.views import call_tones

QUIET_SEED, QUIET_ROWS, QUIET_BELOW, LOUD_FLOOR, LOUD_FACTOR = 16.0, 50, 60.0, 40.0, 2.5
LOUD_OF, LOUD_NEED = 5, 4


def unreviewed(d: DataFrame) -> DataFrame:
    """FLT-05: feedback flag false or null."""
    return d.where(~F.coalesce("feedback_submitted", F.lit(False)))


def training_rows(d: DataFrame) -> DataFrame:
    """FLT-06: reviewed rows with a transcript that are not excluded from training."""
    return d.where("feedback_submitted and coalesce(verified_transcript, '') != '' and coalesce(include_in_training, true)")


def review_list(d: DataFrame, text: str | None = None, status: str | None = None, tone: str | None = None, unit: str | None = None, low_only: bool = False) -> DataFrame:
    """FLT-04: free text in four fields; status needs_review (no feedback), fine_tuned (feedback) or low_confidence (under 80, null
    counts as 100; ``low_only`` is the same); a call tone (CLN-22, columns tone_name, verified_units, units); a unit substring in the verified units, else the others."""
    if text:
        d = d.where(F.exists(F.array("dispatch_id", "incident_type", "address", "raw_transcript"), lambda c: F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))))
    seen = F.coalesce("feedback_submitted", F.lit(False)) if "feedback_submitted" in d.columns else F.lit(False)
    if status not in (None, "needs_review", "fine_tuned", "low_confidence"):
        raise ValueError(f"no such status: {status}")
    if status in ("needs_review", "fine_tuned"):
        d = d.where(seen if status == "fine_tuned" else ~seen)
    if low_only or status == "low_confidence":
        d = d.where(F.coalesce("confidence_score", F.lit(100.0)) < 80)
    units = F.coalesce(F.when(F.size("verified_units") > 0, F.col("verified_units")), F.col("units")) if "verified_units" in d.columns else F.col("units")
    if tone:
        d = d.where(F.array_contains(call_tones(F.col("tone_name"), F.col("verified_units") if "verified_units" in d.columns else F.array().cast("array<string>"), F.col("units")), tone))
    return d.where(F.coalesce(F.exists(units, lambda u: F.upper(u).contains(unit.upper())), F.lit(False))) if unit else d


def page(d: DataFrame, limit: int, offset: int) -> DataFrame:
    """WIN-06: newest first, ties by id."""
    return d.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def stats(d: DataFrame) -> DataFrame:
    """AGG-01: totals and the mean confidence (0.0 when there is none)."""
    return d.agg(F.count("*").alias("total"), F.count_if(F.coalesce("feedback_submitted", F.lit(False))).alias("reviewed"), F.count_if(~F.coalesce("feedback_submitted", F.lit(False))).alias("unreviewed"), F.coalesce(F.round(F.avg("confidence_score"), 1), F.lit(0.0)).alias("mean_confidence"))


def hydrant_stats(h: DataFrame) -> DataFrame:
    """AGG-02 with QC-04: counts per status; rated means a flow class is known; bad is a class that does not exist."""
    return h.groupBy("status").agg(F.count("*").alias("total"), F.count("flow_class").alias("rated"), (F.count("*") - F.count("flow_class")).alias("unrated"), F.count_if(F.col("flow_class").isNotNull() & ~F.col("flow_class").isin("AA", "A", "B", "C")).alias("bad"))


def street_frequency(dispatches: DataFrame, parcels: DataFrame) -> DataFrame:
    """JN-15: streets by dispatches, then parcels, then name."""
    d = dispatches.where("street is not null").groupBy("street").agg(F.count("*").alias("dispatched"))
    p = parcels.where("street is not null").groupBy("street").agg(F.count("*").alias("parcels"))
    return d.join(p, "street", "full_outer").select("street", F.coalesce("dispatched", F.lit(0)).alias("dispatched"), F.coalesce("parcels", F.lit(0)).alias("parcels")).orderBy(F.desc("dispatched"), F.desc("parcels"), "street")


def new_incident_types(d: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """JN-14: incident types that the vocabulary lacks, compared without case."""
    known = vocabulary.where("category = 'call_type'").select(F.lower("term").alias("k")).distinct()
    seen = d.where("incident_type is not null").groupBy(F.lower(F.trim("incident_type")).alias("k")).agg(F.min(F.trim("incident_type")).alias("term")).where("k != ''")
    return seen.join(known, "k", "left_anti").select(F.lit("call_type").alias("category"), "term", F.lit(999).alias("sort_order"), F.lit("learned").alias("source"))


def unit_responses(d: DataFrame, halls: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """JN-19: one row per dispatch and distinct unit: type, class, home hall, crow distance, router figures.

    Halls: hall_id, lat, lng, a handful of rows. Matrix: dispatch_id, hall_id, road_m, seconds. Without a router's
    figure the distance is the crow's, the ETA null and the source ``degraded_no_router``.
    """
    u = d.select("dispatch_id", F.col("lat").alias("ty"), F.col("lng").alias("tx"), F.explode(F.array_distinct(F.transform("units", lambda x: F.upper(F.trim(x))))).alias("unit"))
    u = u.withColumns({"unit_type": unit_type(F.col("unit")), "unit_class": unit_class(F.col("unit")), "hall_id": unit_hall(F.col("unit"))}).join(halls, "hall_id", "left")
    u = u.withColumn("crow_m", haversine_m(F.col("ty"), F.col("tx"), F.col("lat"), F.col("lng"))).drop("lat", "lng", "tx", "ty")
    if matrix is None:
        u = u.withColumns({"road_m": F.lit(None).cast("double"), "seconds": F.lit(None).cast("double")})
    else:
        u = u.join(matrix, ["dispatch_id", "hall_id"], "left")
    eta = F.when(F.col("seconds").isNotNull(), F.greatest(F.lit(1), F.bround(F.col("seconds") / 60).cast("int")))
    source = F.when(F.col("seconds").isNull(), "degraded_no_router").otherwise("router")
    return u.select("dispatch_id", "unit", "unit_type", "unit_class", "hall_id", "crow_m", F.coalesce("road_m", "crow_m").alias("distance_m"), eta.alias("eta_min"), source.alias("source"))


def closure_state(c: DataFrame, now) -> DataFrame:
    """FLT-07: state (future, expired, active), in_24h, in_7d at ``now``."""
    start, end = F.col("start_time"), F.col("end_time")
    future = F.coalesce(now < start, F.lit(False))
    c = c.withColumn("state", F.when(future, "future").when(F.coalesce(now > end, F.lit(False)), "expired").otherwise("active"))
    return c.withColumns({"in_24h": future & (start <= now + F.expr("interval 24 hours")), "in_7d": future & (start <= now + F.expr("interval 7 days"))})


def sync_closures(existing: DataFrame, notices: DataFrame, now) -> DataFrame:
    """STR-04: the closure table after one sync at ``now``; an empty feed changes nothing.

    Notices replace rows of their id and are active unless past their end; rows the feed no longer has become
    inactive once started; past ends become inactive; inactive rows untouched for 30 days go.
    """
    if notices.isEmpty():
        return existing
    cols = ["closure_id", "start_time", "end_time", "active", "updated_at"]
    past = F.coalesce(F.col("end_time") < now, F.lit(False))
    fresh = notices.select("closure_id", "start_time", "end_time", (~past).alias("active"), now.alias("updated_at"))
    kept = existing.select(*cols).join(fresh.select("closure_id"), "closure_id", "left_anti")
    stop = F.col("active") & (past | F.coalesce(F.col("start_time") <= now, F.lit(True)))
    kept = kept.withColumns({"active": F.col("active") & ~stop, "updated_at": F.when(stop, now).otherwise(F.col("updated_at"))})
    kept = kept.where(F.col("active") | (F.col("updated_at") >= now - F.expr("interval 30 days")))
    return fresh.unionByName(kept)


class _Loudness:
    """Carries the last quiet readings of a device and whether its last four readings were loud.

    A block's summary has its own last quiet readings, and its last four readings with the number of quiet ones after each: enough to
    tell their loudness once the quiet readings before the block are known.
    """

    columns = ["rms"]

    def start(self):
        return np.array([QUIET_SEED]), np.array([], bool)

    def read(self, summary, rows):
        tail, last = summary or (np.array([]), [])
        v = rows["rms"].to_numpy(float)
        quiet = v < QUIET_BELOW
        after = quiet[::-1].cumsum()[::-1] - quiet
        own = list(zip(v[-LOUD_OF + 1 :], after[-LOUD_OF + 1 :], strict=True))
        return np.concatenate((tail, v[quiet]))[-QUIET_ROWS - LOUD_OF :], [*((x, k + quiet.sum()) for x, k in last), *own][-LOUD_OF + 1 :]

    def absorb(self, state, summary):
        quiet, loud = state
        tail, last = summary
        both = np.concatenate((quiet, tail))
        flags = [x > max(LOUD_FLOOR, LOUD_FACTOR * both[: len(both) - k][-QUIET_ROWS:].mean()) for x, k in last]
        return both[-QUIET_ROWS:], np.concatenate((loud, np.array(flags, bool)))[-LOUD_OF + 1 :]

    def write(self, state, rows):
        quiet, loud = state
        v = rows["rms"].to_numpy(float)
        is_quiet = v < QUIET_BELOW
        both = np.concatenate((quiet, v[is_quiet]))
        end = len(quiet) + is_quiet.cumsum()
        # each window is summed anew, oldest first: a running total would keep rounding errors of all readings before
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(QUIET_ROWS - 1), both)), QUIET_ROWS)
        total = np.cumsum(windows, axis=1)[:, -1][end - 1]
        now = v > np.maximum(LOUD_FLOOR, LOUD_FACTOR * total / np.minimum(end, QUIET_ROWS))
        seen = np.concatenate((loud, now)).astype(int)
        sums = np.concatenate(([0], seen.cumsum()))
        at = np.arange(len(loud), len(seen)) + 1
        out = rows.drop(columns="__device").assign(loud=now, triggered=sums[at] - sums[np.maximum(at - LOUD_OF, 0)] >= LOUD_NEED)
        return out, (both[-QUIET_ROWS:], seen[-LOUD_OF + 1 :].astype(bool))


def loud_readings(r: DataFrame, tasks: int | None = None) -> DataFrame:
    """WIN-05: (device, seq, rms, loud, triggered): loud above max(40, 2.5 x the mean of the last 50 quiet readings), triggered at 4 loud ones of 5.

    Quiet readings are those below 60, the current one included; a reading of 16 stands before a device's first. The mean
    runs over quiet rows only, however far back they are. A null reading is neither quiet nor loud; readings of a null
    device are one device's. A device's readings may lie in many tasks.
    """
    own = r.select("device", "seq", F.col("rms").cast("double").alias("rms"), F.coalesce(F.concat(F.lit("v"), F.col("device").cast("string")), F.lit("")).alias("__device"))
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("device", "seq", "rms"))
    return scanned(own, "__device", ["seq"], _Loudness(), f"{kinds}, loud boolean, triggered boolean", tasks)
