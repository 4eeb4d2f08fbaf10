"""Registered queries of keyed state and streams: each writes the table as files, runs the stream over them and returns what it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenflow.operators.lineage import fresh
from sirenflow.plans.fixtures import load
from sirenflow.plans.more_queries import ORACLE, QUERIES
from sirenflow.plans.street_queries import query
from sirenflow.streaming import changes as ch
from sirenflow.streaming import keyed, phases

__all__ = ["ORACLE", "QUERIES"]

#: Files of a stream's source, of which a batch takes two.
PARTS = 10


def _streamed(df: DataFrame, *order: str, end: DataFrame | None = None) -> DataFrame:
    """A stream over ``df``, dealt to files by a hash of ``order`` so that each batch has rows of every time; ``end`` is a
    last file, whose late time lets the watermark pass all rows."""
    path = fresh(df.sparkSession, "stream")
    df.repartition(PARTS, *order).write.parquet(path)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


_LIVE = "FROM a WHERE dispatch_id IN (SELECT dispatch_id FROM changes GROUP BY 1 HAVING arg_max(op, (ts, seq)) <> 'DELETE') GROUP BY dispatch_id"


@query(ORACLE["dispatch_state"].replace("FROM a GROUP BY dispatch_id", _LIVE))
def dispatch_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """STR-01 and SNK-04: the state that a stream of changes in no order leaves in its store."""
    c = load(spark, d, "changes").select("op", F.col("ts").cast("timestamp").alias("ts"), "seq", F.struct("dispatch_id", *ch.FIELDS).alias("record"))
    at = fresh(spark, "checkpoint")
    keyed.run_dispatches(_streamed(c, "seq"), at).awaitTermination()
    return keyed.dispatches_in(spark, at)


_FIRST = """SELECT concat('D', event_id) AS dispatch_id, ts, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Street ', event_id % 4) END AS address,
 CASE WHEN event_id % 6 < 2 AND event_id % 4 > 0 THEN concat('A & ', event_id % 4) END AS intersection, CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 9 > 1 THEN concat('STORED ', event_id % 4) END AS target_address FROM {events} WHERE event_id % 7 <> 0"""
_SECOND = """SELECT concat('D', event_id) AS dispatch_id, ts + {minutes} AS ts, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('Street ', event_id % 4 + 1) ELSE concat('STREET ', event_id % 4) END AS address,
 CASE WHEN event_id % 16 = 8 THEN concat('a & ', event_id % 4) END AS intersection, CASE WHEN event_id % 3 > 0 THEN concat('FOUND ', event_id % 4) END AS found_address, CASE WHEN event_id % 10 < 5 THEN 50.5D + event_id % 10 END AS found_confidence FROM {events} WHERE event_id % 5 <> 0"""
_PHASES_SQL = f"""WITH p AS ({_FIRST.format(events="events")}), q AS ({_SECOND.format(events="events", minutes="interval '1' minute * (event_id % 13 - 1)").replace("50.5D", "50.5::DOUBLE")}),
a AS (SELECT *, coalesce(nullif(address, ''), nullif(intersection, ''), '') AS place FROM p), b AS (SELECT *, coalesce(nullif(address, ''), nullif(intersection, ''), '') AS place FROM q),
j AS (SELECT coalesce(a.dispatch_id, b.dispatch_id) AS dispatch_id, nullif(target_address, '') AS stored, a.place AS pa, b.place AS pb, found_address, found_confidence,
 CASE WHEN b.dispatch_id IS NULL THEN 'expired' WHEN a.dispatch_id IS NULL THEN 'single' WHEN lower(a.place) = lower(b.place) AND a.place <> '' THEN 'confirmed' WHEN b.place = '' THEN 'kept' WHEN found_address IS NOT NULL THEN 'corrected' ELSE 'unsure' END AS outcome
 FROM a FULL JOIN b ON a.dispatch_id = b.dispatch_id AND b.ts >= a.ts AND b.ts <= a.ts + interval '600' second)
SELECT dispatch_id, outcome, CASE outcome WHEN 'confirmed' THEN coalesce(stored, pa) WHEN 'corrected' THEN found_address WHEN 'single' THEN coalesce(found_address, nullif(pb, ''), 'Unknown Location') ELSE coalesce(stored, 'Unknown Location') END AS address,
 CASE WHEN outcome = 'confirmed' THEN 100.0::DOUBLE WHEN outcome = 'corrected' OR outcome = 'single' AND found_address IS NOT NULL THEN coalesce(found_confidence, 80.0) END AS confidence,
 CASE WHEN outcome IN ('confirmed', 'corrected', 'kept') THEN false WHEN outcome = 'unsure' THEN true END AS verify_location FROM j"""


def _phases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(_FIRST, events=events), spark.sql(_SECOND.replace("{minutes}", "make_dt_interval(0, 0, cast(event_id % 13 - 1 as int))"), events=events)


@query(_PHASES_SQL)
def phase_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """STR-02 in one batch."""
    return phases.correlated(*_phases(spark, d))


@query(_PHASES_SQL)
def phase_outcomes_stream(spark: SparkSession, d: str) -> DataFrame:
    """STR-02 on two streams whose rows come in no order."""
    ended = [_streamed(df, "dispatch_id", end=df.limit(1).selectExpr("'end' AS dispatch_id", "ts + interval 9999 days AS ts", *df.columns[2:])) for df in _phases(spark, d)]
    path, at = fresh(spark, "out"), fresh(spark, "checkpoint")
    phases.run_correlation(*ended, path, at, late="400 days").awaitTermination()
    return spark.read.parquet(path).where("dispatch_id != 'end'")


# a device's readings half a second apart: half a minute of quiet, half a minute of sound, and every fifth device never falls silent again
_SOUND = """SELECT concat('d', user_id % 20) AS device, cast(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS bigint) AS rn, user_id % 20 AS dn, value FROM {events}"""
_HEARD = """SELECT device, rn, 1704067200000000 + rn * 500000 AS us, CASE WHEN rn % 97 = 0 THEN NULL WHEN turn % 2 = 1 OR (dn % 5 = 0 AND turn > 2) THEN 120 + value % 50 ELSE value % 25 END AS rms,
 CASE WHEN rn % 60 = 3 AND turn % 8 = 7 THEN 'Chief Tone' WHEN rn % 60 = 7 THEN CASE WHEN turn % 8 IN (1, 5) THEN 'Engine Tone' WHEN turn % 8 = 3 AND dn % 2 = 0 THEN 'PA Tone' END END AS tone
 FROM (SELECT *, (rn - rn % 60) / 60 AS turn FROM {s})"""
_APP = "coalesce(tone IN ('Chief Tone', 'Engine Tone', 'Rescue Tone'), false)"
_LOUD = "coalesce(rms > greatest(40.0, 2.5 * list_avg(quiet2)), false)"
_LISTEN = f"""WITH RECURSIVE s AS ({_SOUND.format(events="events")}), r AS ({_HEARD.format(s="s")}),
m AS (
  SELECT device, 0::BIGINT AS rn, 0::BIGINT AS us, [16.0::DOUBLE] AS quiet, []::BOOLEAN[] AS loud, []::STRUCT(us BIGINT, app BOOLEAN)[] AS recent, NULL::BIGINT AS look, false AS app, NULL::BIGINT AS began, NULL::BIGINT AS silent,
         0::BIGINT AS tick, 0::BIGINT AS ticks, NULL::STRUCT(a BIGINT, b BIGINT, t BIGINT, why VARCHAR) AS done FROM (SELECT DISTINCT device FROM r)
  UNION ALL
  SELECT device, rn, us,
         CASE WHEN mode = 'c' AND over OR mode = 'l' AND heard AND NOT app2 THEN [16.0::DOUBLE] WHEN mode = 'q' THEN quiet2 ELSE quiet END,
         CASE WHEN mode = 'c' AND over OR mode = 'q' AND loud_n >= 4 THEN []::BOOLEAN[] WHEN mode = 'q' THEN loud2 ELSE loud END,
         CASE WHEN mode = 'c' AND over THEN []::STRUCT(us BIGINT, app BOOLEAN)[] WHEN mode = 'q' THEN recent2 ELSE recent END,
         CASE WHEN mode = 'l' AND NOT heard THEN look WHEN mode = 'q' AND loud_n >= 4 THEN recent2[1].us END,
         CASE WHEN mode = 'l' AND NOT heard THEN app2 WHEN mode = 'q' AND loud_n >= 4 THEN list_bool_or(list_transform(recent2, lambda x: x.app)) ELSE false END,
         CASE WHEN mode = 'c' AND NOT over THEN began WHEN mode = 'l' AND heard AND app2 THEN look END,
         CASE WHEN mode = 'c' AND NOT over THEN silent2 END,
         CASE WHEN mode = 'l' OR ticked THEN us ELSE tick END,
         CASE WHEN mode = 'c' THEN ticks + ticked::INT ELSE 0 END,
         CASE WHEN mode = 'c' AND over THEN {{'a': began, 'b': us, 't': ticks + ticked::INT, 'why': CASE WHEN us - began >= 75000000 THEN 'full' ELSE 'silence' END}} END
  FROM (
    SELECT *, coalesce(us - began >= 75000000 OR us - silent2 >= 3000000, false) AS over, list_append(loud, {_LOUD})[-5:] AS loud2, list_sum(list_transform(list_append(loud, {_LOUD})[-5:], lambda x: x::INT)) AS loud_n
    FROM (
      SELECT m.device, r.rn, r.us, r.rms, quiet, loud, recent, look, app, began, tick, ticks, CASE WHEN began IS NOT NULL THEN 'c' WHEN look IS NOT NULL THEN 'l' ELSE 'q' END AS mode,
             CASE WHEN rms < 60 THEN list_append(quiet, rms)[-50:] ELSE quiet END AS quiet2, list_append(recent, {{'us': r.us, 'app': {_APP}}})[-5:] AS recent2, app OR {_APP} AS app2, r.us - look >= 3500000 AS heard,
             CASE WHEN rms IS NULL OR rms < 30 THEN coalesce(silent, r.us) END AS silent2, coalesce(began IS NOT NULL AND r.us - began >= 10000000 AND r.us - tick >= 3000000, false) AS ticked
      FROM m JOIN r ON r.device = m.device AND r.rn = m.rn + 1))
), f AS (SELECT device, done.a AS a, done.b AS b, done.t AS t, done.why AS why FROM m WHERE done IS NOT NULL-- open captures
) SELECT device, make_timestamp(a) AS start, make_timestamp(b) AS "end", t::BIGINT AS ticks, why AS reason FROM f"""


def _readings(spark: SparkSession, d: str) -> DataFrame:
    s = spark.sql(_SOUND, events=spark.read.parquet(f"{d}/events.parquet"))
    return spark.sql(_HEARD, s=s).select("device", F.timestamp_micros("us").alias("ts"), F.col("rms").cast("double").alias("rms"), "tone")


def _plain(captures: DataFrame) -> DataFrame:
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return captures.select("device", at("start"), at("end"), F.size("ticks").cast("long").alias("ticks"), "reason")


@query(_LISTEN)
def captures(spark: SparkSession, d: str) -> DataFrame:
    """STR-03 whole in one batch: loud readings, look at the tone, capture, ticks, silence and cap."""
    return _plain(ch.captures(_readings(spark, d)))


_OPEN = " UNION ALL SELECT device, began, us + 3000000, ticks, 'lost' FROM m WHERE began IS NOT NULL AND rn = (SELECT max(rn) FROM r WHERE r.device = m.device)"


@query(_LISTEN.replace("-- open captures", _OPEN))
def captures_stream(spark: SparkSession, d: str) -> DataFrame:
    """STR-03 whole on a stream whose readings come in no order; devices that send nothing more are closed by timers."""
    end = spark.range(1).select(F.lit("end").alias("device"), F.expr("timestamp '2034-01-01'").alias("ts"), F.lit(0.0).alias("rms"), F.lit(None).cast("string").alias("tone"))
    path, at = fresh(spark, "out"), fresh(spark, "checkpoint")
    keyed.run_captures(_streamed(_readings(spark, d), "device", "ts", end=end), path, at, late="400 days").awaitTermination()
    return _plain(spark.read.schema(ch.CAPTURE).parquet(path))
