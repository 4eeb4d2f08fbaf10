"""Changes folded into a table (STR-01), sessions and captures of readings (STR-03), in batches; see ``keyed`` for their streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sirenflow.operators.carry import scanned
from sirenflow.operators.dispatch import LOUD_FACTOR, LOUD_FLOOR, LOUD_NEED, LOUD_OF, QUIET_BELOW, QUIET_ROWS, QUIET_SEED
from sirenflow.operators.upsert import patch

FIELDS = ["address", "incident_type", "confidence_score"]
QUIET_S, CAP_S, SILENCE_RMS = 3, 75, 30.0
LOOK_S, FIRST_TICK_S, TICK_S = 3.5, 10, 3
APPARATUS = ("Chief Tone", "Engine Tone", "Rescue Tone")  # fixed values; a page for the station alone is none of them


def latest_changes(changes: DataFrame, key: str = "dispatch_id") -> DataFrame:
    """Changes folded to one row per key: op of the last one; whether there was a delete; each field from the last change after
    the last delete that carries it. Order is by (ts, seq)."""
    rec = changes.select(F.col(f"record.{key}").alias(key), "op", F.struct("ts", "seq").alias("at"), *[F.col(f"record.{c}").alias(c) for c in FIELDS])
    rec = rec.withColumn("gone", F.max(F.when(F.col("op") == "DELETE", F.col("at"))).over(Window.partitionBy(key)))
    alive = F.col("gone").isNull() | (F.col("at") > F.col("gone"))
    last = [F.max_by(c, F.when(F.col(c).isNotNull() & alive, F.col("at"))).alias(c) for c in FIELDS]
    return rec.groupBy(key).agg(F.max_by("op", "at").alias("op"), F.max(F.col("gone").isNotNull()).alias("deleted"), *last)


def apply_changes(state: DataFrame, changes: DataFrame, key: str = "dispatch_id") -> DataFrame:
    """STR-01: the state after a batch of changes: inserts, partial updates, deletes. A key that comes back after a delete
    starts anew, without values from before."""
    got = latest_changes(changes, key)
    named = got.where("op != 'DELETE'").withColumn("present", F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in FIELDS])))
    live = state.join(got.where("deleted"), key, "left_anti")
    return patch(live, named, key, FIELDS)


def run_changes(stream: DataFrame, target: str, checkpoint: str, key: str = "dispatch_id"):
    """STR-01 as a stream: one Parquet snapshot per batch under ``target``/v=<batch>; the batch number makes a retry harmless.

    Only batch 0 starts from nothing; a snapshot that cannot be read stops the stream. The snapshot before the last is removed.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], f"{key} string, address string, incident_type string, confidence_score double")
        state = spark.read.parquet(f"{target}/v={number - 1}") if number else empty
        apply_changes(state, batch, key).write.mode("overwrite").parquet(f"{target}/v={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Runs:
    """Carries the time of a device's last loud reading and of the first one of its session.

    A block's summary has its first and last reading and the begin of the last session that begins inside it, if one does.
    """

    columns = ["us"]

    def start(self):
        return None

    def read(self, summary, rows):
        us = rows["us"].to_numpy()
        breaks = np.flatnonzero(np.diff(us, prepend=summary[1] if summary else us[0]) > QUIET_S * 1_000_000)
        begin = int(us[breaks[-1]]) if len(breaks) else summary[2] if summary else None
        return (summary[0] if summary else int(us[0])), int(us[-1]), begin

    def absorb(self, state, summary):
        first, last, begin = summary
        if begin is None:
            begin = state[1] if state and first - state[0] <= QUIET_S * 1_000_000 else first
        return last, begin

    def write(self, state, rows):
        us = rows["us"].to_numpy()
        new = np.diff(us, prepend=state[0] if state else us[0]) > QUIET_S * 1_000_000
        new[0] |= state is None
        at = np.maximum.accumulate(np.where(new, np.arange(len(us)), -1))
        begin = np.where(at >= 0, us[at], state[1] if state else 0)
        return rows.drop(columns="__device").assign(begin=begin), (int(us[-1]), int(begin[-1]))


def sessions(readings: DataFrame, tasks: int | None = None) -> DataFrame:
    """STR-03: (device, start, end, readings): readings above 30 no more than 3 s apart, cut every 75 s from a session's start.

    Readings without a time are left out; those of a null device are one device's. A device's readings may lie in many tasks.
    """
    loud = readings.where((F.col("rms") >= SILENCE_RMS) & F.col("ts").isNotNull())
    s = loud.select("device", F.unix_micros("ts").alias("us"), F.coalesce(F.concat(F.lit("v"), F.col("device").cast("string")), F.lit("")).alias("__device"))
    s = scanned(s, "__device", ["us"], _Runs(), f"device {readings.schema['device'].dataType.simpleString()}, us long, begin long", tasks)
    s = s.withColumn("part", F.floor((F.col("us") - F.col("begin")) / (CAP_S * 1_000_000)))
    at = lambda c: F.timestamp_micros(c)
    return s.groupBy("device", "begin", "part").agg(at(F.min("us")).alias("start"), at(F.max("us")).alias("end"), F.count("*").alias("readings")).drop("begin", "part")


def with_ticks(captures: DataFrame) -> DataFrame:
    """STR-03: captures (start, end) with ``ticks``, the times of the phase-1 checks: the first once 10 s are recorded, then every 3 s up to the end."""
    first = F.unix_micros("start") + FIRST_TICK_S * 1_000_000
    steps = F.when(first <= F.unix_micros("end"), F.sequence(first, F.unix_micros("end"), F.lit(TICK_S * 1_000_000)))
    return captures.withColumn("ticks", F.coalesce(F.transform(steps, lambda t: F.timestamp_micros(t)), F.array().cast("array<timestamp>")))


def fresh_listener() -> dict:
    return {"quiet": [QUIET_SEED], "loud": [], "recent": [], "look": None, "tones": [], "start": None, "silent": None, "tick": 0, "ticks": []}


def capture_steps(rows: Iterator[tuple], state: dict | None) -> tuple[list[tuple], dict]:
    """One device's readings (ts in microseconds, rms, tone) in order, from a state on: finished captures (start, end, ticks, reason), and the new state.

    Listening: the loud rule of WIN-05; four loud readings of the last five start a look at the tone and empty the list of
    loud ones. The look covers the last five readings too and ends once it is 3.5 s long. A page for the station alone, or no known
    tone, clears the baseline and listens on. Else a capture runs, from the first reading of the look, until the readings
    have been below 30 for 3 s or 75 s are full; phase-1 ticks come every 3 s after the look once it has 10 s. After it all is
    as at the start.
    """
    s = dict(state) if state else fresh_listener()
    out = []
    for ts, rms, tone in rows:
        if s["start"] is not None:
            if ts - s["start"] >= FIRST_TICK_S * 1_000_000 and ts - s["tick"] >= TICK_S * 1_000_000:
                s["tick"] = ts
                s["ticks"] = [*s["ticks"], ts]
            if rms is None or rms < SILENCE_RMS:
                s["silent"] = ts if s["silent"] is None else s["silent"]
            else:
                s["silent"] = None
            full = ts - s["start"] >= CAP_S * 1_000_000
            if full or (s["silent"] is not None and ts - s["silent"] >= QUIET_S * 1_000_000):
                out.append((s["start"], ts, s["ticks"], "full" if full else "silence"))
                s = fresh_listener()
        elif s["look"] is not None:
            if tone:
                s["tones"] = [*s["tones"], tone]
            if ts - s["look"] >= LOOK_S * 1_000_000:
                if any(t in APPARATUS for t in s["tones"]):
                    s |= {"start": s["look"], "silent": None, "tick": ts, "ticks": []}
                else:
                    s |= {"quiet": [QUIET_SEED]}
                s |= {"look": None, "tones": []}
        else:
            s["recent"] = [*s["recent"], (ts, tone)][-LOUD_OF:]
            if rms is not None and rms < QUIET_BELOW:
                s["quiet"] = [*s["quiet"], rms][-QUIET_ROWS:]
            loud = rms is not None and rms > max(LOUD_FLOOR, LOUD_FACTOR * sum(s["quiet"]) / len(s["quiet"]))
            s["loud"] = [*s["loud"], loud][-LOUD_OF:]
            if sum(s["loud"]) >= LOUD_NEED:
                s |= {"look": s["recent"][0][0], "tones": [t for _, t in s["recent"] if t], "loud": []}
    return out, s


CAPTURE = "device string, start timestamp, end timestamp, ticks array<timestamp>, reason string"


def captured(device: str, found: list[tuple]) -> pd.DataFrame:
    at = lambda us: pd.Timestamp(us, unit="us")
    return pd.DataFrame([(device, at(a), at(b), [at(t) for t in ticks], why) for a, b, ticks, why in found], columns=["device", "start", "end", "ticks", "reason"])


def captures(readings: DataFrame) -> DataFrame:
    """STR-03 in one batch: captures (device, start, end, ticks, reason) of readings (device string, ts, rms, tone).

    A task sorts the readings of its devices and passes over them once, with one device's state at a time; readings without a
    device or time are left out, and a capture that the readings do not end is not reported.
    """
    r = readings.where("device is not null and ts is not null").select("device", F.unix_micros("ts").alias("us"), "rms", "tone")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, state = None, None
        for pdf in batches:
            for name, part in pdf.groupby("device", sort=False):
                if name != device:
                    device, state = name, None
                rows = ((int(u), None if pd.isna(v) else float(v), t) for u, v, t in zip(part["us"], part["rms"], part["tone"], strict=True))
                found, state = capture_steps(rows, state)
                if found:
                    yield captured(device, found)

    return r.repartition("device").sortWithinPartitions("device", "us", "rms", "tone").mapInPandas(run, CAPTURE)
