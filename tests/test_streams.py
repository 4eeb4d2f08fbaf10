"""Keyed state, phases and captures: streams against batches and plain rules."""

import random
from datetime import datetime, timedelta

import pytest

from sirenflow.streaming import changes as ch
from sirenflow.streaming import keyed, phases

T0 = datetime(2024, 1, 1)
CHANGES = "op string, ts timestamp, seq long, record struct<dispatch_id:string,address:string,incident_type:string,confidence_score:double>"


def _changes(n, keys, seed):
    rng = random.Random(seed)
    return [
        (rng.choices(["INSERT", "UPDATE", "DELETE"], [2, 6, 1])[0], T0 + timedelta(seconds=rng.randrange(n // 2)), k, (f"D{rng.randrange(keys)}", rng.choice([None, f"A{k}"]), rng.choice([None, f"T{k}"]), rng.choice([None, k / 2])))
        for k in range(n)
    ]


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def _plain_state(rows):
    out = {}
    for op, _, _, (key, *fields) in sorted(rows, key=lambda r: (r[1], r[2])):
        if op == "DELETE":
            out.pop(key, None)
        else:
            out[key] = [new if new is not None else old for new, old in zip(fields, out.get(key, [None] * 3), strict=True)]
    return {k: tuple(v) for k, v in out.items()}


def _dispatches(spark, at):
    return {r.dispatch_id: (r.address, r.incident_type, r.confidence_score) for r in keyed.dispatches_in(spark, str(at)).collect()}


def test_ten_batches_in_any_order_leave_the_state_of_one(spark, tmp_path):
    rows = _changes(1500, 60, 1)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    for k in range(10):
        _write(spark, shuffled[k::10], CHANGES, tmp_path / "in")
    feed = []
    s = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keyed.run_dispatches(s, str(tmp_path / "cp"), sink=lambda batch, n: feed.append({r.dispatch_id: r for r in batch.collect()}))
    q.awaitTermination()
    assert len([f for f in feed if f]) == 10
    assert _dispatches(spark, tmp_path / "cp") == _plain_state(rows)
    last = {}
    for f in feed:
        last |= f
    assert {k: (r.address, r.incident_type, r.confidence_score) for k, r in last.items() if r.op == "UPSERT"} == _plain_state(rows)


def _state_bytes(at):
    return sum(p.stat().st_size for p in (at / "state").rglob("*") if p.is_file() and p.suffix in (".changelog", ".zip"))


def test_a_batch_writes_the_keys_that_it_names_only(spark, tmp_path):
    all_rows = [("INSERT", T0, k, (f"D{k}", f"address {k} " + "x" * 80, None, None)) for k in range(4000)]
    _write(spark, all_rows, CHANGES, tmp_path / "in")
    s = lambda: spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))
    keyed.run_dispatches(s(), str(tmp_path / "cp")).awaitTermination()
    whole = _state_bytes(tmp_path / "cp")
    _write(spark, [("UPDATE", T0 + timedelta(1), 5000 + k, (f"D{k}", "new", None, None)) for k in range(40)], CHANGES, tmp_path / "in")
    q = keyed.run_dispatches(s(), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"]) == 40
    assert _state_bytes(tmp_path / "cp") - whole < whole / 10
    got = _dispatches(spark, tmp_path / "cp")
    assert len(got) == 4000 and got["D7"][0] == "new" and got["D70"][0].startswith("address 70")


def test_a_stream_starts_from_a_table_and_forgets_deleted_keys(spark, tmp_path):
    before = spark.createDataFrame([("a", "old a", "x", 1.0), ("b", "old b", None, None)], "dispatch_id string, address string, incident_type string, confidence_score double")
    s = lambda: spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    at = str(tmp_path / "cp")
    _write(spark, [("UPDATE", T0, 1, ("a", "new a", None, None)), ("DELETE", T0, 2, ("b", None, None, None)), ("INSERT", None, None, ("c", "c", None, None)), ("INSERT", T0, 3, (None, "no id", None, None))], CHANGES, tmp_path / "in")
    keyed.run_dispatches(s(), at, before, late="1 hour", keep_days=2).awaitTermination()
    assert _dispatches(spark, at) == {"a": ("new a", "x", 1.0), "c": ("c", None, None)}
    held = lambda: {r.key.dispatch_id for r in spark.read.format("statestore").option("path", at).option("stateVarName", "current").load().collect()}
    assert held() == {"a", "b", "c"}
    # a change that is older than the delete: the key stays gone
    _write(spark, [("UPDATE", T0 - timedelta(minutes=5), 9, ("b", "too old", None, None)), ("UPDATE", T0 + timedelta(3), 10, ("a", None, "y", None))], CHANGES, tmp_path / "in")
    keyed.run_dispatches(s(), at, before, late="1 hour", keep_days=2).awaitTermination()
    assert "b" not in _dispatches(spark, at)
    # two days later the deleted key is forgotten, and a change behind the watermark is dropped and counted
    _write(spark, [("UPDATE", T0 + timedelta(hours=1), 11, ("c", "late", None, None)), ("UPDATE", T0 + timedelta(4), 12, ("a", None, None, 2.0))], CHANGES, tmp_path / "in")
    q = keyed.run_dispatches(s(), at, before, late="1 hour", keep_days=2)
    q.awaitTermination()
    assert keyed.late_rows(q) == 1
    assert _dispatches(spark, at) == {"a": ("new a", "y", 2.0), "c": ("c", None, None)} and held() == {"a", "c"}


FIRST = "dispatch_id string, ts timestamp, address string, intersection string, target_address string"
SECOND = "dispatch_id string, ts timestamp, address string, intersection string, found_address string, found_confidence double"


def _phase_rows():
    at = lambda s: T0 + timedelta(seconds=s)
    one = [
        ("same", at(0), "12 Main St", None, "12 MAIN ST"), ("cross", at(0), "", "A & B", None), ("found", at(0), "1 X St", None, "1 X ST"), ("lost", at(0), "1 X St", None, "1 X ST"), ("none", at(0), "1 X St", None, ""),
        ("slow", at(0), "1 X St", None, "kept"), ("edge", at(0), "1 X St", None, "kept"), ("early", at(60), "1 X St", None, "kept"), ("alone", at(0), None, None, None), ("twice", at(0), "q", None, "q"), ("twice", at(0), "q", None, "q"), (None, at(0), "q", None, "q"),
    ]
    two = [
        ("same", at(60), "12 MAIN st", None, None, None), ("cross", at(60), None, "a & b", "elsewhere", 90.0), ("found", at(60), "2 Y St", None, "2 Y ST", None), ("lost", at(60), "2 Y St", None, None, None), ("none", at(60), None, "", "odd", 99.0),
        ("slow", at(601), "1 X St", None, None, None), ("edge", at(600), "1 x st", None, None, None), ("early", at(0), "5 Z", None, "5 Z ST", 70.0), ("new", at(60), None, None, None, None), ("twice", at(5), "q", None, None, None), ("dark", None, "q", None, None, None),
    ]
    want = {
        ("same", "confirmed", "12 MAIN ST", 100.0, False), ("cross", "confirmed", "A & B", 100.0, False), ("found", "corrected", "2 Y ST", 80.0, False), ("lost", "unsure", "1 X ST", None, True), ("none", "kept", "Unknown Location", None, False),
        ("slow", "expired", "kept", None, None), ("slow", "single", "1 X St", None, None), ("edge", "confirmed", "kept", 100.0, False), ("early", "expired", "kept", None, None), ("early", "single", "5 Z ST", 70.0, None),
        ("alone", "expired", "Unknown Location", None, None), ("new", "single", "Unknown Location", None, None), ("twice", "confirmed", "q", 100.0, False),
    }
    return one, two, want


def test_phases_in_one_batch(spark):
    one, two, want = _phase_rows()
    got = [tuple(r) for r in phases.correlated(spark.createDataFrame(one, FIRST), spark.createDataFrame(two, SECOND)).collect()]
    assert len(got) == len(want) and set(got) == want
    none = phases.correlated(spark.createDataFrame([], FIRST), spark.createDataFrame([], SECOND))
    assert none.count() == 0


def test_phases_on_streams_late_and_reordered(spark, tmp_path):
    one, two, want = _phase_rows()
    rng = random.Random(4)
    rng.shuffle(one)
    rng.shuffle(two)
    far = T0 + timedelta(days=2)
    # phase 2 of some dispatches comes in files before their phase 1; the last rows of each side move the watermark; then a late row
    files = [(one[:2], two[:6]), (one[2:8], two[6:]), (one[8:], []), ([("end", far, None, None, None)], [("end", far, None, None, None, None)]), ([("late", T0, "x", None, "x")], [("end2", far, None, None, None, None)])]
    late = 0
    for a, b in files:
        _write(spark, a, FIRST, tmp_path / "one")
        _write(spark, b, SECOND, tmp_path / "two")
        s1, s2 = spark.readStream.schema(FIRST).parquet(str(tmp_path / "one")), spark.readStream.schema(SECOND).parquet(str(tmp_path / "two"))
        q = phases.run_correlation(s1, s2, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        late += keyed.late_rows(q)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if not r.dispatch_id.startswith("end")]
    assert len(got) == len(want) and set(got) == want and late == 1


READINGS = "device string, ts timestamp, rms double, tone string"


def _reading(device, k, rms, tone=None):
    return (device, T0 + timedelta(seconds=k / 2), rms, tone)


def _sound(device):
    out = [_reading(device, k, 10.0) for k in range(40)]
    out += [_reading(device, 40 + k, 200.0, "PA Tone" if k == 6 else None) for k in range(14)]  # a page for the station
    out += [_reading(device, 54 + k, 10.0) for k in range(20)]
    out += [_reading(device, 74 + k, 200.0, "Engine Tone" if k == 1 else None) for k in range(60)]  # the tone stands before the look
    out += [_reading(device, 134 + k, 10.0) for k in range(20)]
    out += [_reading(device, 154 + k, 200.0, "Rescue Tone" if k == 6 else None) for k in range(200)]  # one that never falls silent
    return out


def _steps(rows):
    us = [(round((t - T0).total_seconds() * 1e6), v, x) for _, t, v, x in sorted(rows, key=lambda r: r[1])]
    return ch.capture_steps(us, None)


def test_a_failed_look_forgets_the_loud_readings():
    """After a page, one loud reading does not start the next look: the list of loud ones was emptied when the look started."""
    rows = [_reading("m", k, 200.0, "PA Tone" if k == 1 else None) for k in range(8)] + [_reading("m", 8, 200.0), _reading("m", 9, 10.0, "Engine Tone")]
    rows += [_reading("m", k, 10.0) for k in range(10, 60)]
    found, state = _steps(rows)
    assert found == [] and state["start"] is None and state["look"] is None


def test_captures_begin_with_the_readings_before_the_look():
    found, _ = _steps(_sound("m"))
    assert [why for *_, why in found] == ["silence", "full"]
    # four loud readings of five: the look covers the quiet one before them
    assert found[0][0] == 36_500_000 and found[1][1] - found[1][0] == 75_000_000


def test_capture_stream_takes_readings_in_event_time_order(spark, tmp_path):
    rows = [r for dev in ("a", "b", "c") for r in _sound(dev)][: 354 * 2 + 110]  # c goes silent for good inside a capture
    shuffled = rows[:]
    random.Random(7).shuffle(shuffled)
    end = [("z", T0 + timedelta(days=3), 0.0, None)]
    late = [("a", T0, 500.0, None)] * 2
    total = 0
    for part in (shuffled[:400], shuffled[400:], end, late):
        _write(spark, part, READINGS, tmp_path / "in")
        q = keyed.run_captures(spark.readStream.schema(READINGS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour")
        q.awaitTermination()
        total += keyed.late_rows(q)
    us = lambda t: round((t - T0).total_seconds() * 1e6)
    got = sorted((r.device, us(r.start), us(r.end), tuple(map(us, r.ticks)), r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [(d, a, b, tuple(t), why) for d in "abc" for a, b, t, why in _steps([r for r in rows if r[0] == d])[0]]
    state = _steps([r for r in rows if r[0] == "c"])[1]
    last = max(us(r[1]) for r in rows if r[0] == "c")
    assert got == sorted([*want, ("c", state["start"], last + 3_000_000, tuple(state["ticks"]), "lost")])
    assert total == 2
    store = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "listener").load()
    assert {r.key.device for r in store.collect()} <= {"z"}  # silent devices are forgotten


def test_captures_in_one_batch(spark):
    rows = [r for dev in ("a", "b") for r in _sound(dev)] + [(None, T0, 1.0, None), ("a", None, 1.0, None)]
    got = [(r.device, r.reason, r.start, r.end) for r in ch.captures(spark.createDataFrame(rows, READINGS).repartition(5)).collect()]
    found, _ = _steps(_sound("a"))
    at = lambda us: T0 + timedelta(microseconds=us)
    assert sorted(got) == sorted((d, why, at(a), at(b)) for d in "ab" for a, b, _, why in found)
    assert ch.captures(spark.createDataFrame([], READINGS)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_folding_changes_does_not_depend_on_their_order(seed):
    rows = [r for r in _changes(60, 1, seed)]
    def folded(rs):
        s = None
        for op, ts, seq, (_, *fields) in rs:
            s = keyed.fold_change(s, op, (round((ts - T0).total_seconds() * 1e6), seq), dict(zip(ch.FIELDS, fields, strict=True)))
        return s
    want = folded(sorted(rows, key=lambda r: (r[1], r[2])))
    for k in range(5):
        random.Random(k).shuffle(rows)
        assert folded(rows) == want
