"""Tests of mended and new operators on small rows."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from sirenflow.functions import transcript as tr
from sirenflow.functions.lines import merged_line, point_at
from sirenflow.operators import dispatch, geocode, lookups, reports, spatial, streets, transcripts, views
from sirenflow.streaming import changes as ch

r = random.Random(4)


def test_loud_readings_against_a_rolling_list(spark):
    rows = []
    for device in ("a", "b"):
        for k in range(1000):
            loud = 300 <= k < 600
            rows.append((device, k, r.choice([None, 90.0, 300.0]) if loud else r.uniform(5, 70)))
    want = {}
    for device in ("a", "b"):
        quiet, last = [16.0], []
        for d, k, rms in rows:
            if d == device:
                if rms is not None and rms < 60:
                    quiet = [*quiet, rms][-50:]
                last = [*last, rms is not None and rms > max(40, 2.5 * float(np.mean(quiet)))][-5:]
                want[(d, k)] = (last[-1], sum(last) >= 4)
    got = {(x.device, x.seq): (x.loud, x.triggered) for x in dispatch.loud_readings(spark.createDataFrame(rows, "device string, seq int, rms double")).collect()}
    assert got == want and any(t for _, t in want.values()) and not all(x for k, (x, _) in want.items() if 300 <= k[1] < 600)


def _changes(spark, rows):
    rec = "struct<dispatch_id:string,address:string,incident_type:string,confidence_score:double>"
    return spark.createDataFrame([(op, ts, seq, (key, a, t, None)) for op, ts, seq, key, a, t in rows], f"op string, ts int, seq int, record {rec}")


def test_deleted_values_do_not_come_back(spark):
    empty = spark.createDataFrame([("old", "stored", "fire", 1.0), ("keep", "k", None, None)], "dispatch_id string, address string, incident_type string, confidence_score double")
    c = _changes(spark, [("INSERT", 1, 1, "x", "A", "fire"), ("DELETE", 2, 2, "x", None, None), ("INSERT", 3, 3, "x", None, "flood"), ("DELETE", 1, 4, "old", None, None), ("INSERT", 2, 5, "old", None, None), ("UPDATE", 1, 6, "keep", None, "gas"), ("INSERT", 1, 7, "gone", "g", None), ("DELETE", 1, 8, "gone", None, None)])
    got = {x.dispatch_id: (x.address, x.incident_type) for x in ch.apply_changes(empty, c).collect()}
    assert got == {"x": (None, "flood"), "old": (None, None), "keep": ("k", "gas")}


def test_change_stream_equals_one_batch_and_stops_on_a_lost_snapshot(spark, tmp_path):
    rows = [(r.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), k, k, f"d{r.randrange(5)}", r.choice([None, f"A{k}"]), None) for k in range(60)]
    for part in range(3):
        _changes(spark, rows[part * 20 : part * 20 + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(_changes(spark, rows).schema).parquet(str(tmp_path / "in"))
        ch.run_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    empty = spark.createDataFrame([], "dispatch_id string, address string, incident_type string, confidence_score double")
    want = sorted(map(str, ch.apply_changes(empty, _changes(spark, rows)).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out" / "v=2")).collect())) == want
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v=1", "v=2"]
    (tmp_path / "out" / "v=2").rename(tmp_path / "lost")
    _changes(spark, rows[:5]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ch.run_changes(spark.readStream.schema(_changes(spark, rows).schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    try:
        q.awaitTermination()
        raise AssertionError("the stream went on without its state")
    except Exception as e:
        assert "v=2" in str(e)


def _sound():
    rms = [(k * 0.5, 10.0, None) for k in range(40)]
    rms += [(20 + k * 0.5, 200.0, "PA Tone" if k == 6 else None) for k in range(14)]  # a page for the station
    rms += [(27 + k * 0.5, 10.0, None) for k in range(20)]
    rms += [(37 + k * 0.5, 200.0, "Engine Tone" if k == 7 else None) for k in range(60)]  # a dispatch of 30 s
    rms += [(67 + k * 0.5, 10.0, None) for k in range(20)]
    rms += [(77 + k * 0.5, 200.0, "Rescue Tone" if k == 6 else None) for k in range(200)]  # one that never ends
    return rms


def test_captures_follow_tone_silence_and_cap():
    us = [(int(t * 1e6), v, x) for t, v, x in _sound()]
    whole, _ = ch.capture_steps(us, None)
    assert [w[3] for w in whole] == ["silence", "full"] and 37e6 <= whole[0][0] <= 40e6 and 69e6 <= whole[0][1] <= 71e6
    assert whole[1][1] - whole[1][0] == 75_000_000
    ticks = whole[0][2]
    assert ticks[0] - whole[0][0] >= 10_000_000 and all(b - a >= 3_000_000 for a, b in zip(ticks, ticks[1:])) and len(ticks) > 5
    parts, state = [], None
    for k in range(0, len(us), 37):
        got, state = ch.capture_steps(us[k : k + 37], state)
        parts += got
    assert parts == whole


def test_nearest_civic_with_blank_types_and_units(spark):
    parcels = spark.createDataFrame([(1, "100", "MAIN", "ST", None, 1.0, 1.0), (2, "899", "main", "AVE", "", 2.0, 2.0), (3, "901", "MAIN", "AVE", "4", 3.0, 3.0), (4, "99999999999", "MAIN", "AVE", None, 4.0, 4.0), (5, "101", "MAIN", "ST", None, None, 1.0)], "parcel_id int, house string, street string, street_type string, unit string, lat double, lng double")
    asked = spark.createDataFrame([(1, "900", "Main", "Ave"), (2, "900", "Main", ""), (3, "150", "Main", None), (4, "90", "Main", "Rd"), (5, "x", "Main", "St"), (6, "500", None, "St")], "request_id int, house string, street string, street_type string")
    got = {x.request_id: (x.lat, x.confidence, x.note) for x in geocode.nearest_civic(asked, parcels).collect()}
    assert got == {1: (2.0, 70, "nearest civic number 899"), 2: (2.0, 70, "nearest civic number 899"), 3: (1.0, 60, "nearest civic number 100")}


def test_lines_of_several_parts(spark):
    assert merged_line([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(2, 0), (2, 2)]]) in ([(0, 0), (1, 0), (2, 0), (2, 2)], [(2, 2), (2, 0), (1, 0), (0, 0)])
    assert merged_line([[(0, 0), (1, 0)], [(5, 5), (9, 5)]]) == [(5, 5), (9, 5)] and merged_line([]) == []
    assert len(merged_line([[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 3)]])) == 2  # three ends meet: not joined, the longest stays
    line = "array<array<struct<lng:double,lat:double>>>"
    t = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (1.0, 3.0)]], 0.5), (2, [[(0.0, 0.0), (4.0, 0.0)]], 2.0), (3, None, 0.5), (4, [], 0.5), (5, [[(0.0, 0.0), (4.0, 0.0)]], None)], f"k int, lines {line}, f double")
    got = {x.k: x.p for x in t.select("k", point_at(F.col("lines"), F.col("f")).alias("p")).collect()}
    assert (got[1].lat, got[1].lng) == (1.0, 1.0) and (got[2].lat, got[2].lng) == (0.0, 4.0) and got[3].lat is None and got[4].lat is None and got[5].lat is None
    roads = t.where("k = 1").select(F.lit(9).alias("road_id"), F.lit("Elm Rd").alias("fullname"), F.lit("Elm").alias("roadname"), F.lit(100).alias("left_begin"), F.lit(200).alias("left_end"), F.lit(None).cast("int").alias("right_begin"), F.lit(None).cast("int").alias("right_end"), "lines")
    asked = spark.createDataFrame([(1, "150", "elm", "rd"), (2, "300", "elm", "rd")], "request_id int, house string, street string, street_type string")
    assert [(x.request_id, x.lat, x.lng) for x in geocode.block_range(asked, roads).collect()] == [(1, 1.0, 1.0)]


def test_street_nodes_share_snap_and_cross(spark):
    m = 1 / 111_194.9
    rows = [("A", 0.0, 0.0, 0.01, 0.0), ("B", 0.002, 0.0, 0.006, 0.0), ("C", 0.005, 1.2 * m, 0.005, 0.004), ("D", 0.008, 3 * m, 0.008, 0.004), ("E", 0.003, -0.002, 0.003, 0.002), ("F", 0.01, 0.0, 0.02, 0.0)]
    got = {(x.canon_a, x.canon_b): (x.x, x.y) for x in spatial.street_nodes(spark.createDataFrame(rows, "canon string, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert got[("A", "B")] == (0.004, 0.0) and got[("A", "E")] == (0.003, 0.0) and got[("A", "F")] == (0.01, 0.0)
    assert ("A", "C") in got and abs(got[("A", "C")][1] - 0.6 * m) < 1e-6 and ("A", "D") not in got and ("B", "C") in got


def test_places_are_looked_up_by_value(spark):
    p = lambda x, y: (float(x), float(y))
    ring = [p(0, 0), p(0.05, 0), p(0.05, 0.05), p(0, 0.05)]
    zones = spark.createDataFrame([("2", [ring]), ("10", [[p(0.05, 0), p(0.1, 0), p(0.1, 0.05), p(0.05, 0.05)]])], "map_name string, rings array<array<struct<x:double,y:double>>>")
    rows = [(1, 0.02, 0.02), (2, 0.02, 0.02), (3, 0.02, 0.05), (4, 0.02, 0.07), (5, None, 0.07), (6, 0.02, 0.10001), (7, 0.5, 0.5), (8, 0.02, 0.0), (8, 0.02, 0.0)]
    t = spark.createDataFrame(rows, "k int, lat double, lng double").repartition(3).withColumn("zone_id", F.lit("old"))
    got = sorted((x.k, x.zone_id or "") for x in spatial.with_zone(t, zones).collect())
    assert got == [(1, "2"), (2, "2"), (3, "2"), (4, "10"), (5, ""), (6, "10"), (7, ""), (8, "2"), (8, "2")]
    assert {x.k for x in spatial.with_zone(t, zones, strict=True).where("zone_id is not null").collect()} == {1, 2, 4}
    grids = spark.createDataFrame([(1, "grid 2", 0.02, 0.02), (2, "ZONE 10", 0.02, 0.02), (3, None, 0.02, 0.02), (4, "10", 0.02, 0.07), (5, "2", 0.02, 0.0)], "k int, map_grid string, lat double, lng double")
    assert {x.k: x.in_grid for x in spatial.in_grid(grids, zones).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    lines = spark.createDataFrame([(1, [p(-0.1, 0.02), p(0.2, 0.02)]), (2, [p(1, 1), p(2, 2)]), (3, [p(0.02, 0.02)]), (4, []), (5, [p(-0.02, 0.0), p(0.0, 0.0)])], "k int, points array<struct<x:double,y:double>>")
    city = zones.select(F.col("map_name").alias("name"), "rings").where("name = '2'")
    assert {x.k: x.in_city for x in lookups.lines_in_city(lines, city, "k").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_hydrants_across_cells_against_all_pairs(spark):
    g = random.Random(8)
    pts = [(k, 49.2 + g.random() * 0.03, -122.9 + g.random() * 0.04) for k in range(120)]
    hyd = [(k, g.choice(["A", None]), g.choice([None, "IN", "INACTIVE"]), 49.2 + g.random() * 0.03, -122.9 + g.random() * 0.04) for k in range(150)]

    def m(a, b, c, d):
        h = np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2
        return 2 * 6371000 * np.arcsin(np.sqrt(h))

    want = {}
    for k, la, lo in pts:
        own = [(m(la, lo, y, x), i, f) for i, f, s, y, x in hyd if s != "INACTIVE"]
        want[k] = (min(((d, i) for d, i, f in own if f and d <= 800), default=(0, None))[1], min(((d, i) for d, i, f in own if not f and d <= 400), default=(0, None))[1])
    t = spark.createDataFrame(pts, "dispatch_id int, lat double, lng double")
    h = spark.createDataFrame(hyd, "object_id int, flow_class string, status string, lat double, lng double")
    assert {x.dispatch_id: (x.city_id, x.private_id) for x in spatial.nearest_hydrants(t, h).collect()} == want


def test_nearest_road_against_all_pairs(spark):
    g = random.Random(9)
    pts = [(k, 49.2 + g.random() * 0.1, -122.9 + g.random() * 0.1) for k in range(60)] + [(99, None, 1.0)]
    segs = [(k, *(x := (-122.9 + g.random() * 0.1, 49.2 + g.random() * 0.1)), x[0] + g.uniform(-0.01, 0.01), x[1] + g.uniform(-0.01, 0.01)) for k in range(40)]

    def m(lat, lng, x1, y1, x2, y2):
        k = np.cos(np.radians(lat))
        a, b = np.array([(x1 - lng) * k, y1 - lat]), np.array([(x2 - lng) * k, y2 - lat])
        t = min(1.0, max(0.0, -(a @ (b - a)) / ((b - a) @ (b - a))))
        return np.hypot(*(a + t * (b - a))) * 6371000 * np.pi / 180

    want = {k: min((round(m(la, lo, *s[1:]), 6), s[0]) for s in segs) for k, la, lo in pts[:-1]}
    got = streets.nearest_road(spark.createDataFrame(pts, "k int, lat double, lng double"), "k", spark.createDataFrame(segs, "road_id int, x1 double, y1 double, x2 double, y2 double"))
    assert {x.k: (x.dist_m, x.road_id) for x in got.collect()} == want


def test_left_to_right_takes_the_last_grid_and_channel(spark):
    said = [
        "coquitlam engine 4 and ladder two respond emergency medical aid 2911 lougheed highway unit 12 near oak street and elm road use talk group 5 coquitlam map grid 12 map grid 45",
        "burnaby squad 2 for structure fire gordon avenue and como lake avenue talk group combined response coquitlam grid 7", "nothing much", None, "medic 1 respond alarm 5 oak street talk group 3 talk group 9",
    ]
    t = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, clean string")
    got = {x.k: x for x in transcripts.left_to_right(t, ["Medical Aid", "Structure Fire", "Alarm"]).collect()}
    a = got[0]
    assert (a.units, a.priority, a.call_type, a.grid, a.channel, a["sub"]) == (["engine 4", "ladder two"], "emergency", "Medical Aid", "45", "5", "12")
    assert a.cross_1 == "oak street" and a.cross_2 == "elm road map grid 12"  # only the last grid is taken off
    assert a.address.startswith("2911 Lougheed Highway")
    assert got[1].intersection == "Gordon Avenue and Como Lake Avenue" and got[1].channel == tr.COMBINED and got[1].grid == "7" and got[1].priority == "routine" and got[1].address is None
    assert got[2].call_type == tr.UNKNOWN and got[2].units == [] and got[2].grid is None and got[3].call_type is None and got[4].channel == "9" and got[4].address.startswith("5 Oak Street")


def test_reports_ratings_bands_and_lists(spark):
    t = spark.createDataFrame([(0.0, 0.0), (0.1, 0.3), (0.3, 0.1), (None, 0.5)], "old_rate double, new_rate double")
    x = reports.rating_distribution(t).collect()[0]
    assert (x.n, x.perfect, x.operational, x.failed, x.improved, x.regression, x.unchanged) == (4, 25.0, 25.0, 50.0, 1, 1, 1)
    assert [y.ok for y in reports.row_counts({"a": t, "b": t}, {"a": (4, 4), "b": (5, None)}).orderBy("table").collect()] == [True, False]
    d = spark.createDataFrame([("a", True, 70.0, ["E1"], ["Q2"], "Engine Tone"), ("b", None, None, ["E1"], None, None), ("c", False, 90.0, None, [], "x")], "dispatch_id string, feedback_submitted boolean, confidence_score double, units array<string>, verified_units array<string>, tone_name string")
    d = d.withColumns({"incident_type": F.lit("Fire"), "address": F.lit(None).cast("string"), "raw_transcript": F.lit("said")})
    ids = lambda **k: {x.dispatch_id for x in dispatch.review_list(d, **k).collect()}
    assert ids(status="needs_review") == {"b", "c"} and ids(status="fine_tuned") == {"a"} and ids(status="low_confidence") == {"a"} and ids(tone="engine") == {"a", "b"} and ids(unit="e1") == {"b"} and ids(text="SAID") == {"a", "b", "c"}


def test_known_buildings_and_parcel_parts(spark):
    b = spark.createDataFrame([(2, "Mall", "9 West Rd", ["the mall"], 1.0, 1.0, None, None), (1, "Hall", "5 Oak St", None, 2.0, 2.0, 3.0, 3.0)], "position int, name string, address string, aliases array<string>, lat double, lng double, entrance_lat double, entrance_lng double")
    t = spark.createDataFrame([(1, "at the MALL, hall b", 0.0, 0.0), (2, "9 west rd", 0.0, 0.0), (3, None, 5.0, None), (4, "elsewhere", 6.0, 6.0)], "k int, address string, lat double, lng double")
    got = {x.k: (x.address, x.lat, x.building) for x in views.with_building(t, b).collect()}
    assert got == {1: ("5 Oak St", 3.0, "Hall"), 2: ("9 West Rd", 1.0, "Mall"), 3: (None, 5.0, None), 4: ("elsewhere", 6.0, None)}
    lots = spark.createDataFrame([(1, "G1", "12 OAK STREET"), (2, "G2", "112 OAK STREET"), (3, "G3", None)], "parcel_id int, gis_id string, address string")
    asked = spark.createDataFrame([("12 oak street",), ("G2",), ("2 OAK",), ("k",), ("zz",), (None,), ("2 OAK",)], "query string")
    found = [(x.query, x.parcel_id, x.match) for x in geocode.parcel_lookup(asked, lots).collect()]
    assert set(found) == {("12 oak street", 1, "clean"), ("G2", 2, "gis_id"), ("2 OAK", 1, "contains"), ("k", 1, "contains"), ("zz", None, None), (None, None, None)} and len(found) == 7
