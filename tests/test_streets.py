"""Street geometry, transcripts, feeds, tones and views on small rows; the registered queries also have SQL."""

import io
import json
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sirenflow.functions import transcript as tr
from sirenflow.operators import junction_lookup as jl
from sirenflow.operators import lookups, streets, tones, transcripts, views
from sirenflow.sources import feeds, sinks

DEG = 6_371_000.0 * math.pi / 180
XY = "array<struct<x:double,y:double>>"


def one(spark, c, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(c.alias("v")).first().v


def plane(x, y, x1, y1, x2, y2):
    k = math.cos(math.radians(y))
    ax, ay, dx, dy = (x1 - x) * k, y1 - y, (x2 - x1) * k, y2 - y1
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / n)) if n else 0.0
    return math.hypot(ax + t * dx, ay + t * dy) * DEG


def test_nearest_road_against_brute_force(spark):
    r = random.Random(3)
    segs = [(i, *(v := (r.uniform(-122.9, -122.7), r.uniform(49.2, 49.3))), v[0] + r.uniform(-0.01, 0.01), v[1] + r.uniform(-0.01, 0.01)) for i in range(40)]
    pts = [(k, r.uniform(49.1, 49.4), r.uniform(-123.0, -122.6)) for k in range(60)] + [(90, None, -122.8), (91, 10.0, 10.0)]
    got = {x.k: x for x in streets.nearest_road(spark.createDataFrame(pts, "k long, lat double, lng double"), "k", spark.createDataFrame(segs, "road_id long, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert set(got) == set(range(60))
    for k, y, x in pts[:60]:
        want = min((plane(x, y, *s[1:]), s[0]) for s in segs)
        assert got[k].road_id == want[1] and got[k].dist_m == pytest.approx(want[0], abs=1e-6)


def test_front_keeps_own_points(spark):
    p = spark.createDataFrame([(1, 49.0, -122.0, 49.0, -122.0), (2, 49.5, -122.5, 49.0, -122.0), (3, None, None, 49.0, -122.0)], "parcel_id int, front_lat double, front_lng double, centroid_lat double, centroid_lng double")
    f = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0)], "parcel_id int, front_lat double, front_lng double")
    assert {x.parcel_id: x.front_lat for x in streets.with_front(p, f).collect()} == {1: 1.0, 2: 49.5, 3: None}


def test_junctions_against_brute_force(spark):
    r = random.Random(5)
    rows = [("A", "B", -122.8 + r.uniform(0, 0.002), 49.25 + r.uniform(0, 0.002)) for _ in range(60)] + [("A", "C", -122.8, 49.25), ("A", "C", -122.8, 49.25), ("A", "D", None, 49.0)]
    n = spark.createDataFrame(rows, "canon_a string, canon_b string, x double, y double")
    ab = [x[2:] for x in rows if x[1] == "B"]
    k = math.cos(math.radians(sum(y for _, y in ab) / len(ab)))
    groups = []
    for p in ab:
        near = [g for g in groups if any(math.hypot((p[0] - q[0]) * k, p[1] - q[1]) * DEG <= 25 for q in g)]
        groups = [g for g in groups if g not in near] + [[p, *(q for g in near for q in g)]]
    got = streets.junctions(n).collect()
    assert sorted(x.nodes for x in got if x.canon_b == "B") == sorted(map(len, groups))
    assert [(x.canon_b, x.nodes) for x in got if x.canon_b != "B"] == [("C", 1)]


def test_sections_and_ends(spark):
    z = spark.createDataFrame([("7", "1", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]])], "map_name string, hall_id string, rings array<array<struct<x:double,y:double>>>")
    s = spark.createDataFrame([("MAIN ST", -1.0, 0.5, 0.5, 0.5), ("MAIN ST", 0.5, 0.5, 0.9, 0.5), ("MAIN ST", 5.0, 5.0, 6.0, 5.0)], "canon string, x1 double, y1 double, x2 double, y2 double")
    r = spark.createDataFrame([("r", "Main St", "GRID 7"), ("none", "Oak St", "7"), ("nozone", "Main St", None)], "request_id string, street string, map_grid string")
    got = streets.street_sections(r, s, z).collect()
    assert len(got) == 1 and [(e.lng, e.lat) for e in got[0].endpoints] == [(0.0, 0.5), (0.9, 0.5)] and got[0].length_m == pytest.approx(0.9 * DEG * math.cos(math.radians(0.5)), abs=1)
    u = spark.createDataFrame([("r", "E1", 0.5, 2.0), ("r", "E2", 0.5, -2.0)], "request_id string, unit string, hall_lat double, hall_lng double")
    assert {x.unit: x.lng for x in streets.nearest_end(u, streets.street_sections(r, s, z)).collect()} == {"E1": 0.9, "E2": 0.0}


def test_closures_and_unreal_crossings(spark):
    ring = lambda x: [[(x, 0.0), (x + 0.02, 0.0), (x + 0.02, 0.02), (x, 0.02)]]
    z = spark.createDataFrame([("2", "1", ring(0.0)), ("10", "3", ring(0.02))], "map_name string, hall_id string, rings array<array<struct<x:double,y:double>>>")
    c = spark.createDataFrame([("line", [(0.015, 0.01), (0.039, 0.01)]), ("point", [(0.01, 0.01)]), ("away", [(1.0, 1.0)]), ("empty", []), ("null", None)], f"closure_id string, points {XY}")
    got = {x.closure_id: (x.zone_id, x.affected_zones, x.hall_id) for x in streets.closure_zones(c, z).collect()}
    assert got == {"line": ("10", ["2", "10"], "3"), "point": ("2", ["2"], "1")}


def test_parcel_hydrants(spark):
    m = 1 / DEG
    ring = [(0.0, 0.0), (100 * m, 0.0), (100 * m, 50 * m), (0.0, 50 * m), (0.0, 0.0)]
    t = spark.createDataFrame([("plain", 0.0, 0.0, None, None), ("ring", 0.0, 0.0, ring, None), ("route", 0.0, 0.0, ring, [(50 * m, -200 * m), (50 * m, -10 * m)]), ("null", None, 0.0, None, None)], f"dispatch_id string, lat double, lng double, ring {XY}, route {XY}")
    h = spark.createDataFrame([(1, 0.0, 120 * m), (2, -60 * m, 55 * m), (3, 250 * m, 0.0), (4, 0.0, -40 * m), (5, 400 * m, 0.0)], "object_id int, lat double, lng double")
    got = {}
    for x in streets.parcel_hydrants(t, h).orderBy("rank").collect():
        got.setdefault(x.dispatch_id, []).append((x.object_id, x.dist_m))
    assert got == {"plain": [(4, 40), (2, 81), (1, 120)], "ring": [(1, 20), (4, 40), (2, 60)], "route": [(2, 60)]}


def test_junction_lookup(spark):
    n = spark.createDataFrame([("MARINER WAY & OAK ST", 0, 1.0, 2.0), ("MARINER WAY & OAK ST", 1, 1.5, 2.0), ("MAIN ST & OAK ST", 0, 3.0, 4.0)], "key string, candidate_index int, lat double, lng double")
    r = spark.createDataFrame([(1, "Marinar Way", "Oak Street"), (2, "Oak St", "oak street"), (3, "Nowhere", "Oak St"), (4, None, "Oak St")], "request_id int, street_a string, street_b string")
    got = jl.suggestions(r, n).orderBy("rank").collect()
    assert [(x.request_id, x.key, x.candidate_index, x.score) for x in got] == [(1, "MARINER WAY & OAK ST", 0, 91), (1, "MARINER WAY & OAK ST", 1, 91)]
    c = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.01, 0.0), (2, 0, 0.0, 0.0)], "request_id int, candidate_index int, lat double, lng double")
    s = spark.createDataFrame([("ELM RD", -0.1, 0.0101, 0.1, 0.0101)], "canon string, x1 double, y1 double, x2 double, y2 double")
    x = spark.createDataFrame([(1, "Elm Road"), (2, "Gone Road")], "request_id int, cross string")
    assert {(v.request_id, v.candidate_index, v.note) for v in jl.narrow_by_roads(c, x, s).collect()} == {(1, 1, None), (2, 0, "cross streets not among the roads")}
    names = spark.createDataFrame([("Austen Ave",), ("Oka St",), (None,)], "name string")
    known = spark.createDataFrame([("AUSTIN",), ("OAKS",)], "street string")
    assert {v.name: v.corrected for v in jl.corrected_names(names, known).collect()} == {"Austen Ave": "Austin Ave", "Oka St": "Oka St"}
    vocab = spark.createDataFrame([("street_suffix", "SLIP LANE", "SLIP", True)], "category string, term string, term_normalized string, is_active boolean")
    roads = spark.createDataFrame([("Main, St.", "Slip Lane"), ("Oak", "Loop"), ("", "x"), ("Elm", None)], "roadname string, roadtype string")
    assert [v.canon for v in jl.with_canon(roads, vocab).orderBy("roadname").collect()] == [None, "ELM", "MAIN ST SLIP", "OAK LOOP"]


def test_sanitized(spark):
    cases = {"Unit 296, 8 Main": "unit 2968 main", "3-1-0-5": "3105", "110 0 x": "1100 x", "Engine won": "engine 1", "Cocoa cocoa respawned": "coquitlam respond", "Cocoa, cocoa": "coquitlam coquitlam", "four 2 eight": "428", "water 1": "ladder 1", "": ""}
    assert {k: one(spark, tr.sanitized(F.col("a")), a=k) for k in cases} == cases
    assert one(spark, tr.sanitized(F.col("a")), a=None) is None


def test_location_text(spark):
    assert one(spark, tr.title_street(F.col("a")), a="3030 gordon AVENUE") == "3030 Gordon Ave"
    assert one(spark, tr.bare_location(F.col("a"), ["Medical Aid"]), a="medical aid at 3 engine lougheed highway superstore") == "lougheed highway"
    assert one(spark, tr.bare_location(F.col("a")), a="main street and oak avenue") == "main street and oak avenue"
    assert tuple(one(spark, tr.sub_address(F.col("a")), a="3030 gordon avenue 105")) == ("3030 gordon avenue", "Unit 105")
    assert tuple(one(spark, tr.sub_address(F.col("a")), a="main street and oak")) == ("main street and oak", None)
    assert tuple(one(spark, tr.sub_address(F.col("a")), a="12 gordon unit b5")) == ("12 gordon", "Unit B5")
    assert one(spark, tr.unit_codes(F.col("a"), ["engine 1", "hazmat tender 3"]), a="Engine 1, hazmat tender 3, engine 9, engine 1") == ["E1", "HT3"]
    assert one(spark, tr.rounds(F.col("a")), a="engine 1 to gordon map grid 12 engine 1") == ["engine 1 to gordon map grid 12", "engine 1"]
    text = "engine 1 respond engine 1"
    args = dict(units=F.lit("engine 1"), kind=F.lit("Fire"), located=F.lit(True))
    assert one(spark, tr.round_complete(**args, grid=F.lit(None).cast("string"), text=F.col("a")), a=text) is True
    assert one(spark, tr.round_complete(**args, grid=F.lit("400"), text=F.col("a")), a="engine 1") is False


def test_parse_calls(spark):
    texts = {
        "T": "coquitlam engine 1 respond emergency Medical Aid 3-0-3-0 gordon avenue near main road and oak street use talk group 5 map grid 118",
        "X": "engine won respond routine structure fire christmas way and westwood street cross roads lougheed highway use tack 10 map grid 161",
        "F": "calls at 12 gordon street and 14 glen drive map grid 7", "I": "main street and oak avenue", "Z": "nothing", "E": "", "N": None,
    }
    d = spark.createDataFrame([*texts.items(), ("T2", texts["T"])], "dispatch_id string, transcript string")
    got = {(x.dispatch_id, x.position): x for x in transcripts.parse_calls(d, ["Medical Aid", "Structure Fire"], ["Talk Group 5", "10 Combined"]).collect()}
    assert {(k, x.address, x.intersection, x.call_type, x.channel, x.grid) for k, x in got.items()} == {
        (("T", 0), "3030 Gordon Ave", None, "Medical Aid", "Talk Group 5", "118"), (("T2", 0), "3030 Gordon Ave", None, "Medical Aid", "Talk Group 5", "118"),
        (("X", 0), None, "Christmas Way And Westwood St", "Structure Fire", "10 Combined", None), (("F", 0), "12 Gordon St", None, None, None, "7"), (("F", 1), "14 Glen Dr", None, None, None, "7"),
        (("I", 0), None, "Main St and Oak Ave", None, None, None),
    }
    empty = transcripts.parse_calls(d.limit(0), ["Fire"], ["1"])
    assert empty.count() == 0


def test_scored_terms(spark):
    t = spark.createDataFrame([("structur fire",), ("medical - aid now",), ("zzz",), (None,)], "text string")
    got = [x.call_type for x in transcripts.with_call_type(t, "text", ["Medical Aid", "Structure Fire"]).collect()]
    assert got == ["Structure Fire", "Medical Aid", "Unknown Incident", "Unknown Incident"]


def test_feeds(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"events": [
        {"id": "a", "severity": "MAJOR", "geography": {"type": "LineString", "coordinates": [[-122.8, 49.2], [-122.7, 49.3]]}, "schedule": {"intervals": ["2024-01-01T00:00:00Z/2024-01-02T00:00:00Z"]}},
        {"id": "b", "geography": {"type": "Point", "coordinates": [-122.8, 49.2]}, "schedule": {"recurring_schedules": [{"start_date": "2024-01-03", "end_date": "2024-01-04"}]}},
        {"id": "c", "geography": {"type": "Polygon", "coordinates": []}}]}))
    got = {x.closure_id: x for x in feeds.open511(spark, str(tmp_path / "e.json")).collect()}
    assert set(got) == {"a", "b"} and (got["a"].emergency_access, got["a"].lat, got["b"].street_name) == ("NO_ACCESS", 49.3, "Regional Corridor")
    assert (str(got["a"].end_time), str(got["b"].start_time), str(got["b"].end_time)) == ("2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-04 23:59:59")
    (tmp_path / "m.json").write_text(json.dumps({"CoordsEncoded": "_p~iF~ps|U_ulLnnqC_mqNvxq`@", "Issues": [
        {"IssueId": 1, "Geometry": [{"NumPoints": 2, "MarkerInfo": {"RoadClosureType": 262145, "LocationName": "Main"}}, {"NumPoints": 1}], "Description": {"Headline": "Road Closed", "ProposedStartTimeUtcEpochMillis": 1000}},
        {"IssueId": 2, "Geometry": [{"NumPoints": 4}], "Description": {}}]}))
    got = {x.closure_id: x for x in feeds.municipal_issues(spark, str(tmp_path / "m.json")).collect()}
    assert {k: (v.emergency_access, len(v.points), v.street_name) for k, v in got.items()} == {"muni_1_0": ("NO_ACCESS", 2, "Main"), "muni_1_1": ("ACCESS_ONLY", 1, "Local Road")}
    assert got["muni_1_1"].lat == 43.252
    (tmp_path / "z.json").write_text(json.dumps([{"zone_id": " 7 ", "unit_id": "e2"}, {"zone_id": "8", "unit_id": "x9", "station": "S"}, {"zone_id": "", "unit_id": "E1"}]))
    assert {(x.zone_id, x.unit_id, x.hall_id) for x in feeds.zone_units(spark, str(tmp_path / "z.json")).collect()} == {("7", "E2", "2"), ("8", "X9", None)}
    d = spark.createDataFrame([("1", '{"lat": 1.5}'), ("2", json.dumps('{"lat": 2.5}')), ("3", None)], "id string, target string")
    assert [x.target.lat if x.target else None for x in feeds.with_target(d).orderBy("id").collect()] == [1.5, 2.5, None]
    for name, text in (("a.txt", "Address: 12 Main St\nMap_Grid: 7\nnote"), ("b.txt", "just words")):
        (tmp_path / name).write_text(text)
    assert {x.file: (x.transcript, x.address, x.grid) for x in feeds.golden_texts(spark, str(tmp_path / "*.txt")).collect()} == {"a.txt": (None, "12 Main St", "7"), "b.txt": ("just words", None, None)}


def test_tones(spark, tmp_path):
    rate = 16000
    at = np.arange(4 * rate) / rate
    sound = {"chief": 8000 * (np.sin(2 * np.pi * 440.2 * at) + np.sin(2 * np.pi * 660.34 * at)), "noise": np.random.default_rng(1).normal(0, 3000, len(at)), "quiet": np.zeros(len(at)), "short": np.ones(100)}
    for name, x in sound.items():
        with io.BytesIO() as out:
            with wave.open(out, "wb") as w:
                w.setnchannels(2), w.setsampwidth(2), w.setframerate(rate)
                w.writeframes(np.repeat(x.astype("<i2"), 2).tobytes())
            (tmp_path / f"{name}.wav").write_bytes(out.getvalue())
    (tmp_path / "bad.wav").write_bytes(b"no")
    c = feeds.clips(spark, str(tmp_path))
    got = {x.clip_id: x.m for x in tones.peaks(c).select("clip_id", tones.tone_matches(F.col("freqs")).alias("m")).collect()}
    assert set(got) == {"chief", "noise", "quiet"} and (got["noise"], got["quiet"]) == ([], []) and (got["chief"][0].tone, got["chief"][0].score) == ("Chief Tone", 1.0)
    assert tones.loudness(c.where("clip_id = 'quiet'")).agg(F.max("rms")).first()[0] == 0.0
    d = spark.createDataFrame([("chief", True, None, ["E1"], "Chief Tone"), ("noise", True, [], ["L1"], None), ("quiet", False, None, ["E1"], None)], "dispatch_id string, feedback_submitted boolean, verified_units array<string>, responding_units array<string>, tone_name string")
    assert {x.clip_id: x.category for x in tones.clip_categories(c, d.withColumn("incident_type", F.lit("x"))).collect()} == {"chief": "Chief", "noise": "Ladder"}


def test_views_and_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "at the Old Mall now", 1.0, 2.0), (2, None, 3.0, 4.0)], "id int, address string, lat double, lng double")
    b = spark.createDataFrame([(0, "Old Mall", "1 Main St", ["MALL"], 9.0, 9.0, 8.0, 7.0)], "position int, name string, address string, aliases array<string>, lat double, lng double, entrance_lat double, entrance_lng double")
    assert {x.id: (x.address, x.lat, x.building) for x in views.with_building(t, b).collect()} == {1: ("1 Main St", 8.0, "Old Mall"), 2: (None, 3.0, None)}
    assert [tuple(x) for x in views.view_changes(t, t.withColumn("lat", F.when(F.col("id") == 1, 5.0).otherwise(F.col("lat"))), "id", ["address", "lat"]).collect()] == [(1, "lat", "1.0", "5.0")]
    d = spark.createDataFrame([("b", True, "vb", "rb", True), ("a", True, "va", "ra", None), ("c", False, "vc", "rc", True)], "dispatch_id string, feedback_submitted boolean, verified_transcript string, raw_transcript string, include boolean")
    d = d.withColumn("include_in_training", F.col("include"))
    sinks.write_manifest(d, str(tmp_path / "m"))
    assert [x.file_name for x in spark.read.option("header", True).csv(str(tmp_path / "m")).collect()] == ["a.wav", "b.wav"]
    for n in (1, 2):
        sinks.append_evaluation(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


def test_lookups(spark):
    p = spark.createDataFrame([(1, "12 Main St"), (2, "12 main st unit 4"), (3, "Oak"), (4, None)], "parcel_id int, address string")
    assert [x.parcel_id for x in lookups.address_search(p, "MAIN").collect()] == [1, 2]
    a, b = (spark.createDataFrame(r, "term string, rank int") for r in ([("x", 2), ("y", 1)], [("x", 1), ("z", 1)]))
    assert {(x.term, x.list, x.rank) for x in lookups.ordered_union(a, b).collect()} == {("x", 0, 2), ("y", 0, 1), ("z", 1, 1)}
