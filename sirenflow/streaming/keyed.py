"""Keyed state in the state store: dispatches that change in place (STR-01), and captures of readings in event-time order (STR-03)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sirenflow.streaming.changes import CAP_S, CAPTURE, FIELDS, QUIET_S, capture_steps, captured, fresh_listener

#: Days of event time for which a deleted key still turns late changes away, and a silent device keeps its baseline.
KEEP_DAYS, IDLE_DAYS = 7, 1
_DAY_MS = 86_400_000
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB and write a batch's changes only, not the whole state."""
    old = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---------------------------------------------------------------- dispatches

_TYPES = {"address": "string", "incident_type": "string", "confidence_score": "double"}
#: A key's state: time and number of its last change, whether that is a delete, of its last delete, and each field with those of its change.
STATE = "us long, seq long, deleted boolean, gone_us long, gone_seq long, " + ", ".join(f"{c} {_TYPES[c]}, {c}_us long, {c}_seq long" for c in FIELDS)
FEED = "dispatch_id string, op string, " + ", ".join(f"{c} {_TYPES[c]}" for c in FIELDS)
_NONE = (-(1 << 62), -(1 << 62))


def fold_change(state: dict | None, op: str, at: tuple[int, int], fields: dict) -> dict:
    """The state after one change, whatever the order in which changes come.

    The last delete by (time, number) takes away all fields from before it; a field is that of the last change after it
    that carries one; a key lives if its last change is no delete.
    """
    s = dict(state) if state else {"at": _NONE, "deleted": False, "gone": _NONE, "fields": {}}
    if at >= s["at"]:
        s["at"], s["deleted"] = at, op == "DELETE"
    if op == "DELETE":
        s["gone"] = max(s["gone"], at)
        s["fields"] = {c: v for c, v in s["fields"].items() if v[1] > s["gone"]}
    elif at > s["gone"]:
        s["fields"] = s["fields"] | {c: (v, at) for c, v in fields.items() if v is not None and at >= s["fields"].get(c, (None, _NONE))[1]}
    return s


def _packed(s: dict) -> tuple:
    fields = [s["fields"].get(c, (None, (None, None))) for c in FIELDS]
    return (*s["at"], s["deleted"], *s["gone"], *[x for value, at in fields for x in (value, *at)])


def _unpacked(t: tuple) -> dict:
    n = {c: (t[5 + 3 * k], (t[6 + 3 * k], t[7 + 3 * k])) for k, c in enumerate(FIELDS)}
    return {"at": (t[0], t[1]), "deleted": t[2], "gone": (t[3], t[4]), "fields": {c: v for c, v in n.items() if v[1][0] is not None}}


def _value(x):
    return None if x is None or x != x else x


class DispatchState(StatefulProcessor):
    """One value a key; a batch reads and writes the keys that it names. Emits the row of each key that a batch changed.

    A deleted key is forgotten ``keep_ms`` of event time after its last change, by a timer.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", STATE)

    def _row(self, key: str, s: dict) -> pd.DataFrame:
        f = {c: None if s["deleted"] else s["fields"].get(c, (None,))[0] for c in FIELDS}
        return pd.DataFrame([{"dispatch_id": key, "op": "DELETE" if s["deleted"] else "UPSERT"} | f]).astype({"confidence_score": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = _unpacked(self.current.get()) if self.current.exists() else None
        s = old
        for pdf in rows:
            for r in pdf.itertuples():
                s = fold_change(s, r.op, (int(r.us), int(r.seq)), {c: _value(getattr(r, c)) for c in FIELDS})
        if s is not None and s != old:
            self.current.update(_packed(s))
            if s["deleted"] and self.keep_ms is not None:
                self.handle.registerTimer(s["at"][0] // 1000 + self.keep_ms)
            yield self._row(key[0], s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.current.exists():
            s = _unpacked(self.current.get())
            if s["deleted"] and s["at"][0] // 1000 + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.current.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Rows of a table from before the stream: older than any change."""
        r = initialState.iloc[0]
        first = (_NONE[0] + 1, 0)
        self.current.update(_packed(fold_change(None, "INSERT", first, {c: _value(r[c]) for c in FIELDS})))

    def close(self) -> None:
        pass


def dispatch_feed(changes: DataFrame, before: DataFrame | None = None, late: str | None = None, keep_days: int = KEEP_DAYS) -> DataFrame:
    """STR-01: the feed (dispatch_id, op UPSERT or DELETE, fields) of rows that a stream of changes (op, ts, seq, record) alters.

    The order in which changes come does not matter. With ``late``, changes older than the watermark are dropped by Spark (and counted
    in the progress, see :func:`late_rows`), and deleted keys are forgotten after ``keep_days``; without, nothing is
    ever forgotten. ``before`` (dispatch_id, fields) is the table that the stream starts from, one row a key. Changes
    without an id are ignored, those without a time or number count as the earliest.
    """
    us = F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us")
    source = changes.withWatermark("ts", late) if late else changes
    c = source.select(F.col("record.dispatch_id").alias("dispatch_id"), "op", "ts", us, F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), *[F.col(f"record.{c}").cast(_TYPES[c]).alias(c) for c in FIELDS]).where("dispatch_id is not null")
    start = before.select("dispatch_id", *FIELDS).groupBy("dispatch_id") if before is not None else None
    processor = DispatchState(keep_days * _DAY_MS if late else None)
    return c.groupBy("dispatch_id").transformWithStateInPandas(processor, FEED, "Update", "EventTime" if late else "None", start)


def run_dispatches(changes: DataFrame, checkpoint: str, before: DataFrame | None = None, late: str | None = None, keep_days: int = KEEP_DAYS, sink=None):
    """STR-01 as a stream over what there is now; ``sink(batch, number)`` gets each batch's feed. The state stays in ``checkpoint``."""
    with state_store(changes.sparkSession):
        w = dispatch_feed(changes, before, late, keep_days).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return (w.foreachBatch(sink) if sink else w.format("noop")).start()


def dispatches_in(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The table of live dispatches, read from the state of :func:`run_dispatches`."""
    with state_store(spark):
        s = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "current").load()
        return s.where("not value.deleted").select(F.col("key.dispatch_id").alias("dispatch_id"), *[F.col(f"value.{c}").alias(c) for c in FIELDS])


def late_rows(query) -> int:
    """Rows that a query has dropped as later than its watermark, over all batches that its progress still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


# ---------------------------------------------------------------- captures

_LISTENER = "quiet array<double>, loud array<boolean>, recent array<struct<us:long,tone:string>>, look long, tones array<string>, start long, silent long, tick long, ticks array<long>"
_NAMES = ["quiet", "loud", "recent", "look", "tones", "start", "silent", "tick", "ticks"]


class Captures(StatefulProcessor):
    """Readings wait in a list until the watermark has passed them and are then taken in time order.

    Timers stand at the first waiting reading, at the time when an open capture of a device that sends nothing more is full,
    and at the time when a silent device is forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listener = handle.getValueState("listener", _LISTENER)
        self.waiting = handle.getListState("waiting", "us long, rms double, tone string")
        self.last = handle.getValueState("last", "us long")

    def _advance(self, key: str, rows: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        ready = sorted((r for r in rows if r[0] // 1000 < watermark_ms), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0, r[2] or ""))
        wait = [r for r in rows if r[0] // 1000 >= watermark_ms]
        state = None
        if self.listener.exists():
            state = {n: [tuple(x) if n == "recent" else x for x in v] if isinstance(v, (list, tuple)) else v for n, v in zip(_NAMES, self.listener.get(), strict=True)}
        found, new = capture_steps(ready, state)
        last = ready[-1][0] if ready else (self.last.get()[0] if self.last.exists() else None)
        # nothing came for as long as a capture may last: what is open ends with its last reading
        if new["start"] is not None and not wait and last is not None and last // 1000 + CAP_S * 1000 <= watermark_ms:
            found.append((new["start"], last + QUIET_S * 1_000_000, new["ticks"], "lost"))
            new = fresh_listener()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not wait and last is not None and last // 1000 + IDLE_DAYS * _DAY_MS <= watermark_ms:
            self.listener.clear()
            self.last.clear()
            self.waiting.clear()
        else:
            self.listener.update(tuple(new[n] for n in _NAMES))
            if last is not None:
                self.last.update((last,))
            self.waiting.put(wait) if wait else self.waiting.clear()
            if wait:
                self.handle.registerTimer(min(r[0] for r in wait) // 1000 + 1)
            elif last is not None:
                self.handle.registerTimer(last // 1000 + (CAP_S * 1000 if new["start"] is not None else IDLE_DAYS * _DAY_MS))
        if found:
            yield captured(key, found)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.us), _value(r.rms), r.tone) for pdf in rows for r in pdf.itertuples()]
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key[0], [*held, *new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key[0], held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def capture_feed(readings: DataFrame, late: str = "10 seconds") -> DataFrame:
    """STR-03 on a stream (device string, ts, rms, tone or null): captures (device, start, end, ticks, reason).

    Readings are taken in event-time order however they come; those later than the watermark are dropped by Spark and
    counted (:func:`late_rows`). A device that falls silent has its open capture closed 3 s after its last reading (reason
    ``lost``), once event time is 75 s on; after a day of silence nothing of it is kept.
    """
    s = readings.withWatermark("ts", late).select("device", "ts", F.unix_micros("ts").alias("us"), "rms", "tone").where("device is not null and ts is not null")
    return s.groupBy("device").transformWithStateInPandas(Captures(), CAPTURE, "Append", "EventTime")


def run_captures(readings: DataFrame, path: str, checkpoint: str, late: str = "10 seconds"):
    """STR-03 as a stream over what there is now, into Parquet files."""
    with state_store(readings.sparkSession):
        return capture_feed(readings, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
