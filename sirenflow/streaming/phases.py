"""STR-02: the two phases of a dispatch, matched by its id within 600 s, in a batch or on two streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_S = 600
UNKNOWN = "Unknown Location"
SURE, UNRATED = 100.0, 80.0


def _place(side: str) -> Column:
    """The address of a phase's first located candidate, else its intersection; empty if it has none."""
    return F.coalesce(F.nullif(F.col(f"{side}.address"), F.lit("")), F.nullif(F.col(f"{side}.intersection"), F.lit("")), F.lit(""))


def correlated(first: DataFrame, second: DataFrame, late: str | None = None) -> DataFrame:
    """STR-02: (dispatch_id, outcome, address, confidence, verify_location) for each dispatch of either phase.

    ``first``: dispatch_id, ts, address, intersection, target_address (what phase 1 has stored). ``second``: dispatch_id, ts, address,
    intersection, found_address, found_confidence (what a geocoder makes of its place, null if nothing). Phase 2 meets a
    phase 1 that is at most 600 s older. Outcomes: ``confirmed``, the places are equal without case (confidence 100);
    ``corrected``, they differ and phase 2's is found; ``unsure``, they differ and it is not found (phase 1's stays, the only
    outcome to verify); ``kept``, phase 2 has no place; ``single``, no phase 1; ``expired``, no phase 2 in time. A null
    confidence or flag leaves what is stored.

    A full outer join with an interval. On streams ``late`` is the watermark of both sides: rows may come in any order within it, later ones
    are dropped and counted in the progress, and unmatched rows leave the state once no partner can come. A dispatch has one row
    a phase; repeated rows are one. Rows without an id or time match nothing and are left out.
    """
    # the joined columns must stay apart on either side: each side is one struct
    def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
        d = df.select("dispatch_id", "ts", *columns).where("dispatch_id is not null and ts is not null")
        d = d.withWatermark("ts", late).dropDuplicatesWithinWatermark() if late else d.distinct()
        return d.select(F.col("dispatch_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"), F.struct("address", "intersection", *columns[2:]).alias(name))

    a = side(first, "a", "address", "intersection", "target_address")
    b = side(second, "b", "address", "intersection", "found_address", "found_confidence")
    within = F.expr(f"a_id = b_id AND b_ts >= a_ts AND b_ts <= a_ts + interval {TTL_S} seconds")
    j = a.join(b, within, "full_outer")
    p1, p2 = F.lower(_place("a")), F.lower(_place("b"))
    none1, none2 = F.col("a_id").isNull(), F.col("b_id").isNull()
    outcome = (
        F.when(none2, "expired").when(none1, "single").when((p1 == p2) & (p1 != ""), "confirmed").when(p2 == "", "kept").when(F.col("b.found_address").isNotNull(), "corrected").otherwise("unsure")
    )
    j = j.select(F.coalesce("a_id", "b_id").alias("dispatch_id"), outcome.alias("outcome"), "a", "b", _place("a").alias("pa"), _place("b").alias("pb"))
    stored = F.nullif(F.col("a.target_address"), F.lit(""))
    rated = F.coalesce(F.col("b.found_confidence"), F.lit(UNRATED))
    address = (
        F.when(F.col("outcome") == "confirmed", F.coalesce(stored, F.col("pa")))
        .when(F.col("outcome") == "corrected", F.col("b.found_address"))
        .when(F.col("outcome") == "single", F.coalesce("b.found_address", F.nullif(F.col("pb"), F.lit("")), F.lit(UNKNOWN)))
        .otherwise(F.coalesce(stored, F.lit(UNKNOWN)))
    )
    confidence = F.when(F.col("outcome") == "confirmed", F.lit(SURE)).when((F.col("outcome") == "corrected") | ((F.col("outcome") == "single") & F.col("b.found_address").isNotNull()), rated)
    verify = F.when(F.col("outcome").isin("confirmed", "corrected", "kept"), F.lit(False)).when(F.col("outcome") == "unsure", F.lit(True))
    return j.select("dispatch_id", "outcome", address.alias("address"), confidence.alias("confidence"), verify.alias("verify_location"))


def run_correlation(first: DataFrame, second: DataFrame, path: str, checkpoint: str, late: str = "10 minutes"):
    """STR-02 as a stream over what there is now, into Parquet files."""
    return correlated(first, second, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
