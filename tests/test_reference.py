"""Operators of the dispatch library on small rows; the registered queries also have SQL."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sirenflow.functions import fuzzy, geo, text
from sirenflow.operators import dispatch, geocode, reports, spatial, upsert
from sirenflow.sources import readers
from sirenflow.streaming import changes as ch


def one(spark, c, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(c.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [("3030 GORDON AVE, COQUITLAM, BC", "3030 GORDON AVE"), ("Unit 101 3030 Gordon Ave", "3030 GORDON AVE"), ("500 LOUGHEED HWY", "500 LOUGHEED HIGHWAY"), (None, "")])
def test_lookup_address(spark, raw, want):
    assert one(spark, text.lookup_address(F.col("a")), a=raw) == want


def test_text_rules(spark):
    assert one(spark, text.street_name(F.col("a")), a="100 block of Gordon Avenue.") == "100 GORDON AVE"
    assert one(spark, text.intersection_key(F.col("a"), F.col("b")), a="Westwood Street", b="Christmas Way") == "CHRISTMAS WAY & WESTWOOD ST"
    assert one(spark, text.intersection_parts(F.col("a")), a="Main St at Oak Rd, Port Moody") == ["Main St", "Oak Rd"]
    assert one(spark, text.intersection_parts(F.col("a")), a="3030 Gordon Ave") is None
    got = one(spark, text.house_and_street(F.col("a")), a="1000 block Ponderosa Street unit 5")
    assert (got.house, got.street, got.street_type, got.has_block) == ("1000", "Ponderosa", "ST", True)
    assert one(spark, text.civic_address(F.col("a")), a="105-3000 Riverbend Dr") == "3000 Riverbend Dr"
    assert one(spark, text.civic_address(F.col("a")), a="3000 Riverbend Dr 105A") == "3000 Riverbend Dr"
    assert one(spark, text.merge_units(F.col("a"), F.col("b")), a="E1, Q5", b="q5, L1") == "E1, Q5, L1"
    assert [one(spark, f(F.col("a")), a="LAV4") for f in (text.unit_type, text.unit_class, text.unit_hall)] == ["Light Attack Vehicle", "light", "4"]
    assert [one(spark, f(F.col("a")), a="chief") for f in (text.unit_type, text.unit_class, text.unit_hall)] == ["Chief", "light", "1"]
    assert one(spark, text.blank_to_null(F.col("a")), a=" <NULL> ") is None and one(spark, text.safe_int(F.col("a")), a="7.0") == 7


def test_fuzzy_pairs():
    assert (fuzzy.indel("HAMBER", "AMBER"), fuzzy.indel("JOHNSON", "JOHNSTON")) == (91, 93)
    assert fuzzy.token_set("Gordon Ave", "GORDON avenue gordon ave") == 100 and fuzzy.token_set("", "x") == 0
    assert fuzzy.wer("a b c", "a x c d") == pytest.approx(2 / 3) and fuzzy.wer("", "") == 0 and fuzzy.wer("", "x") == 1
    assert fuzzy.polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_zone_for_point_against_brute_force(spark):
    r = random.Random(1)
    square = lambda n, x, y: (n, [[(x, y), (x + 0.02, y), (x + 0.02, y + 0.02), (x, y + 0.02)]])
    zones = spark.createDataFrame([square("2", 0.0, 0.0), square("10", 0.02, 0.0), square("B", 0.0, 0.02)], "map_name string, rings array<array<struct<x:double,y:double>>>")
    pts = [(k, r.uniform(-0.01, 0.05), r.uniform(-0.01, 0.05)) for k in range(200)] + [(900, 0.01, 0.02), (901, -0.00002, 0.01), (902, -0.001, 0.01), (903, None, 0.1)]
    t = spark.createDataFrame(pts, "id long, lat double, lng double")
    got = {x.id: x.zone_id for x in spatial.with_zone(t, zones).collect()}

    def brute(y, x):
        return next((n for n, a, b in (("2", 0.0, 0.0), ("10", 0.02, 0.0), ("B", 0.0, 0.02)) if a <= x <= a + 0.02 and b <= y <= b + 0.02), None)

    assert all(got[k] == brute(y, x) for k, y, x in pts if k < 200)
    assert (got[900], got[903]) == ("2", None) and spatial.SLIVER_M == 5.0
    assert (got[901], got[902]) == ("2", None)
    strict = {x.id: x.zone_id for x in spatial.with_zone(t, zones, strict=True).collect()}
    assert strict[900] in (None, "2") and len(strict) == len(pts)


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([(1, "a", "n1"), (2, "b", "n2")], "id int, v string, note string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(map(tuple, upsert.upsert(old, new, "id", ["v"], ["note"]).collect())) == [(1, "a", "n1"), (2, None, "n2"), (3, "c", None)]
    p = spark.createDataFrame([(1, None, "x", ["v"]), (2, "z", None, ["note"])], "id int, v string, note string, present array<string>")
    assert sorted(map(tuple, upsert.patch(old, p, "id", ["v", "note"]).collect())) == [(1, None, "n1"), (2, "b", None)]
    assert [(r.change, r.fields) for r in upsert.snapshot_diff(old, old.where("id = 1").withColumn("v", F.lit("q")), "id", ["v", "note"]).orderBy("id").collect()] == [("modified", "v"), ("deleted", "")]


def test_empty_feed_changes_nothing(spark):
    t = spark.createDataFrame([("c", datetime(2024, 1, 1), None, True, datetime(2024, 1, 1))], "closure_id string, start_time timestamp, end_time timestamp, active boolean, updated_at timestamp")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert dispatch.sync_closures(t, t.limit(0), now).collect() == t.collect()
    other = t.withColumn("closure_id", F.lit("d")).select("closure_id", "start_time", "end_time")
    assert {(r.closure_id, r.active) for r in dispatch.sync_closures(t, other, now).collect()} == {("c", False), ("d", True)}


def test_loud_readings_against_brute_force(spark):
    r = random.Random(3)
    rows = [(d, k, r.choice([5.0, 20.0, 39.0, 55.0, 120.0])) for d in (1, 2) for k in range(80)]
    got = {(x.device, x.seq): (x.loud, x.triggered) for x in dispatch.loud_readings(spark.createDataFrame(rows, "device int, seq long, rms double")).collect()}
    for d in (1, 2):
        quiet, loud = [16.0], []  # the seed counts as a reading; quiet is below 60, the current reading included
        for _, k, v in [x for x in rows if x[0] == d]:
            if v < 60:
                quiet.append(v)
            loud.append(v > max(40.0, 2.5 * sum(quiet[-50:]) / len(quiet[-50:])))
            assert got[(d, k)] == (loud[-1], sum(loud[-5:]) >= 4)


def test_cascade_prefers_the_lowest_step(spark):
    reqs = spark.createDataFrame([(1, "100", "GORDON", "AVE"), (2, "105", "GORDEN", "AVE"), (3, "9", "NOWHERE", "ST")], "request_id long, house string, street string, street_type string")
    parcels = spark.createDataFrame([(7, "100", "GORDON", "AVE", None, 49.0, -122.0, None, None, None, None), (8, "105", "GORDON", "AVE", None, 49.1, -122.1, 49.2, -122.2, None, None)], "parcel_id long, house string, street string, street_type string, unit string, lat double, lng double, front_lat double, front_lng double, entrance_lat double, entrance_lng double")
    got = {r.request_id: r for r in geocode.cascade(reqs, geocode.exact_parcel(reqs, parcels), geocode.nearest_civic(reqs, parcels)).collect()}
    assert (got[1].step, got[1].lat, got[2].step, got[2].lat, got[2].confidence) == (0, 49.0, 0, 49.2, fuzzy.token_set("GORDEN", "GORDON"))
    assert got[3].step is None and got[3].lat is None


def test_readers(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"features":[{"properties":{"fullname":"Main St","STATUS":null,"SPEED":"50"},"geometry":{"type":"LineString","coordinates":[[1,2,9],[3,4]]}},{"properties":{"FULLNAME":"Old Rd","STATUS":"CLOSED"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}')
    rows = readers.roads(spark, str(p)).collect()
    assert [(r.fullname, r.speed, [[(c.x, c.y) for c in part] for part in r.lines]) for r in rows] == [("Main St", 50, [[(1.0, 2.0), (3.0, 4.0)]])]
    q = tmp_path / "n.json"
    q.write_text('[{"ROAD_NAME":" Oak "},{"road_name":"Elm"},{"road_name":"Elm"}]')
    assert sorted(r.road_name for r in readers.road_names(spark, str(q)).collect()) == ["Elm", "Oak"]
    q.write_text('["Fir","Fir"]')
    assert [r.road_name_normalized for r in readers.road_names(spark, str(q)).collect()] == ["FIR"]


def test_change_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"eventType":"INSERT","new":{"dispatch_id":"D1","address":"A"},"ts":"2024-01-01T00:00:00Z","seq":1}\n{"event":"UPDATE","payload":{"dispatch_id":"D1","incident_type":"Fire"},"ts":"2024-01-01T00:00:01Z","seq":2}\n{"dispatch_id":"D2","address":"B","ts":"2024-01-01T00:00:02Z","seq":3}\n{"eventType":"DELETE","new":{"dispatch_id":"D3"},"ts":"2024-01-01T00:00:03Z","seq":4}\n')
    ch.run_changes(readers.change_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.dispatch_id, r.address, r.incident_type) for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect())
    assert got == [("D1", "A", "Fire"), ("D2", "B", None)]


def test_sessions_are_cut_at_75_s(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(seconds=2 * k), 50.0) for k in range(60)] + [(1, t0 + timedelta(seconds=300), 50.0), (1, t0 + timedelta(seconds=301), 10.0)]
    got = ch.sessions(spark.createDataFrame(rows, "device int, ts timestamp, rms double")).orderBy("start").collect()
    assert [r.readings for r in got] == [38, 22, 1]


def test_tiles_and_geometry(spark):
    assert tuple(one(spark, geo.tile_of(F.col("a"), F.col("b"), F.lit(1)), a=10.0, b=-10.0)) == (0, 0)
    assert one(spark, geo.tms_row(F.lit(0), F.lit(3))) == 7
    g = spark.sql("select array(named_struct('lat', 1D, 'lng', 2D), named_struct('lat', cast(null as double), 'lng', 2D)) as p").select(geo.geometry(F.col("p")).alias("g")).first().g
    assert (g.type, g.coordinates) == ("Point", [[2.0, 1.0]])


def test_reports(spark):
    same = lambda a, b: one(spark, reports.address_match(F.col("a"), F.col("b")), a=a, b=b)
    assert same("3030 Gordon Avenue", "3030 GORDON AVE, Coquitlam") and same("Main St and Oak Road", "oak rd & main street")
    assert not same("", "x") and not same("3030 Gordon Ave", "3031 Gordon Ave")
    assert one(spark, reports.channel_name(F.col("a")), a="Coquitlam Talk Group 5") == "5" and one(spark, reports.channel_name(F.col("a")), a="Coquitlam") == "Coquitlam"
    clips = spark.createDataFrame([("Engine", [1002.0, 1002.5, 997.5]), ("Ladder", [1001.0, None]), (None, [7.0])], "category string, freqs array<double>")
    got = {(r.category, r.bucket): r.n for r in reports.frequency_histogram(clips).collect()}
    assert got == {("Engine", 1000): 3, ("Ladder", 1000): 1, (None, 5): 1, ("All", 1000): 4, ("All", 5): 1}
    roads = spark.createDataFrame([(" ave",), ("Mews",), (None,), ("",)], "roadtype string")
    vocabulary = spark.createDataFrame([("street_suffix", "AVE", True)], "category string, term string, is_active boolean")
    with pytest.raises(ValueError, match="MEWS"):
        reports.require_suffixes(roads, vocabulary)
    reports.require_suffixes(roads.limit(1), vocabulary)


def test_reports_on_empty_tables(spark):
    pair = spark.createDataFrame([], "ref_address string, hyp_address string, ref_units array<string>, hyp_units array<string>, ref_incident string, hyp_incident string, ref_grid string, hyp_grid string, ref_channel string, hyp_channel string, ref_text string, hyp_text string")
    assert reports.match_rates(pair).first().overall is None
    zones = spark.createDataFrame([("1", "Q5")], "zone_id string, unit_id string")
    rows = spark.createDataFrame([("a", "1", None), ("b", None, None)], "closure_id string, zone_id string, start_time timestamp")
    assert [(r.closure_id, r.hall) for r in reports.closures_by_hall(rows, zones, "3").collect()] == [("a", "3"), ("b", "OTHER")]
    assert reports.closures_by_hall(rows.limit(0), zones).count() == 0
