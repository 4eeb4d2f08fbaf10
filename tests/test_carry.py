"""Scans that are carried from task to task: hot keys over many tasks give what one pass gives."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sirenflow.operators import carry, dispatch, geocode
from sirenflow.streaming import changes as ch


def _loud(rows):
    """(loud, triggered) per reading of a device in order, with plain lists."""
    quiet, loud, out = [16.0], [], []
    for v in rows:
        if v is not None and v < 60:
            quiet = [*quiet, v][-50:]
        loud = [*loud, v is not None and v > max(40, 2.5 * sum(quiet) / len(quiet))][-5:]
        out.append((loud[-1], sum(loud) >= 4))
    return out


def test_loud_readings_of_a_hot_device(spark):
    rng = random.Random(1)
    rows = [("hot", k, rng.choice([None, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(30, 59), rng.uniform(60, 200), 41.0])) for k in range(20_000)]
    rows += [("hush", k, 300.0) for k in range(300)] + [(f"d{k % 40}", k, rng.uniform(0, 120)) for k in range(400)] + [(None, k, 50.0) for k in range(9)]
    df = spark.createDataFrame(rows, "device string, seq int, rms double").repartition(6)
    res = dispatch.loud_readings(df, tasks=16)
    got = {(r.device, r.seq): (r.loud, r.triggered) for r in res.collect()}
    by = {}
    for d, k, v in rows:
        by.setdefault(d, []).append((k, v))
    want = {(d, k): x for d, vs in by.items() for (k, _), x in zip(sorted(vs), _loud([v for _, v in sorted(vs)]), strict=True)}
    assert got == want
    assert res.where("device = 'hot'").select(F.spark_partition_id()).distinct().count() >= 12


def test_blocks_of_any_size_sum_up(spark):
    """Summaries of blocks, however small, lead to the state of one pass."""
    rng = np.random.default_rng(3)
    v = pd.DataFrame({"rms": rng.choice([5.0, 20.0, 55.0, 61.0, 90.0, np.nan], 400), "__device": "v"})
    scan = dispatch._Loudness()
    for size in (1, 2, 3, 7, 60):
        state = start = scan.start()
        for k in range(0, len(v), size):
            part = v.iloc[k : k + size]
            summary = None
            for i in range(0, len(part), 2):
                summary = scan.read(summary, part.iloc[i : i + 2])
            _, after = scan.write(start, part)
            state = scan.absorb(state, summary)
            assert np.allclose(state[0], after[0]) and list(state[1]) == list(after[1])
            start = after


def test_sessions_of_a_hot_device(spark):
    rng, t0 = random.Random(2), datetime(2024, 1, 1)
    at, rows = 0.0, []
    for _ in range(8_000):
        at += rng.choice([0.5, 1.0, 2.9, 3.0, 3.1, 10.0]) if rng.random() < 0.2 else 0.5
        rows.append(("hot", t0 + timedelta(seconds=at), rng.choice([10.0, 31.0, 80.0, None])))
    rows += [("hot", t0, 50.0)] * 3 + [("b", None, 50.0), ("b", t0, 30.0), (None, t0, 30.0)]
    got = sorted((str(r.device), r.start, r.end, r.readings) for r in ch.sessions(spark.createDataFrame(rows, "device string, ts timestamp, rms double").repartition(5), tasks=14).collect())
    want, begin, last = {}, None, None
    for _, t, v in sorted((r for r in rows if r[0] == "hot" and r[2] is not None and r[2] >= 30), key=lambda r: r[1]):
        if last is None or t - last > timedelta(seconds=3):
            begin = t
        last = t
        want.setdefault((begin, (t - begin) // timedelta(seconds=75)), []).append(t)
    plain = [("hot", min(x), max(x), len(x)) for x in want.values()] + [("b", t0, t0, 1), ("None", t0, t0, 1)]
    assert got == sorted(plain)


def test_scans_of_empty_tables(spark):
    assert dispatch.loud_readings(spark.createDataFrame([], "device string, seq int, rms double")).collect() == []
    assert ch.sessions(spark.createDataFrame([], "device string, ts timestamp, rms double")).collect() == []


def test_summaries_are_two_a_task(spark):
    df = spark.createDataFrame([(f"d{k % 50}", k, 1.0) for k in range(3000)], "__device string, seq int, rms double").repartitionByRange(6, "__device").sortWithinPartitions("__device", "seq")
    n = df.select("__device", "rms").mapInPandas(carry._summaries(dispatch._Loudness(), "__device"), "task int, key string, summary binary").groupBy("task").count().collect()
    assert all(r["count"] <= 2 for r in n)


def test_a_number_asked_often_is_one_row_of_its_street(spark):
    parcels = spark.createDataFrame([(k, str(10 * k), "MAIN", "ST", None, float(k), 0.0) for k in range(1, 30)], "parcel_id int, house string, street string, street_type string, unit string, lat double, lng double")
    asked = spark.createDataFrame([(k, "104" if k % 3 else "7", "Main", "St") for k in range(3000)], "request_id int, house string, street string, street_type string")
    got = geocode.nearest_civic(asked, parcels).select("request_id", "lat").collect()
    assert len(got) == 3000 and {(r.request_id % 3 > 0, r.lat) for r in got} == {(True, 10.0), (False, 1.0)}
