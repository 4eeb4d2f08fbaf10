"""Files cut at byte ranges: the same objects as one parse of the whole file, wherever the cuts fall."""

import json
import random

import pytest

from sirenflow.sources.feeds import open511, zone_units
from sirenflow.sources.json_parts import json_objects
from sirenflow.sources.readers import features, roads
from sirenflow.sources.sinks import write_features, write_listed

TEXTS = ['plain', 'a } b', '{[", "', 'quote " and \\ back', '\\"}', 'é☃ }{', '', 'x' * 300 + '}' * 40]


def _expected(doc):
    if isinstance(doc, list):
        return [("", o) for o in doc if isinstance(o, dict)]
    out = []
    for k, v in doc.items():
        out += [(k, v)] if isinstance(v, dict) else [(k, o) for o in v if isinstance(o, dict)] if isinstance(v, list) else []
    return out


def _got(spark, path, size):
    rows = json_objects(spark, str(path), size).orderBy("file", "n").collect()
    return [(r.member, json.loads(r.text)) for r in rows]


@pytest.mark.parametrize("size", [40, 300, None])
def test_objects_wherever_the_cuts_fall(spark, tmp_path, size):
    rnd = random.Random(size or 0)
    feature = lambda i: {"type": "Feature", "properties": {"id": i, rnd.choice(TEXTS): rnd.choice(TEXTS), "nested": {"a": [{"b": {}}]}}, "geometry": None if i % 5 == 0 else {"type": "Point", "coordinates": [i, -i]}}
    docs = [
        {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x } y"}}, "features": [feature(i) for i in range(9)], "fields": [{"name": "}"}, {"name": "{"}], "note": 'ends " {'},
        [feature(i) for i in range(4)],
        {"features": []},
        [],
        {"empty": {}, "features": [{}, {}, 3, "}", {"a": 1}]},
    ]
    for i, doc in enumerate(docs):
        f = tmp_path / f"{i}.json"
        f.write_text(json.dumps(doc, ensure_ascii=i % 2 == 0, indent=2 if i == 1 else None), encoding="utf-8")
        assert _got(spark, f, size) == _expected(doc)
    # all of them at once: files do not mix
    assert _got(spark, tmp_path / "*.json", size) == [o for doc in docs for o in _expected(doc)]


def test_broken_and_blank_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text('{"features":[{"a":{"b":1}},{"a":{"b":{"c":')
    (tmp_path / "c.json").write_text('﻿ \n[{"a":"}"}]\n')
    assert _got(spark, tmp_path / "*.json", 16) == [("features", {"a": {"b": 1}}), ("", {"a": "}"})]


def test_readers_agree_on_whole_and_split_files(spark, tmp_path):
    line = lambda i: {"type": "Feature", "properties": {"FullName": f"ROAD {i}", "STATUS": "operating", "Left_Begin": None, "SPEED": str(i)}, "geometry": {"type": "LineString", "coordinates": [[i, 1], [i, 2.5]]}}
    (tmp_path / "roads.json").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"FULLNAME": "no road"}}, "features": [line(i) for i in range(50)]}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = roads(spark, str(tmp_path / "roads.json"), split=True).orderBy("fullname").collect()
        (tmp_path / "units.json").write_text(json.dumps([{"zone_id": "1", "unit_id": "e1"}, {"zone_id": " ", "unit_id": "e2"}]))
        units = zone_units(spark, str(tmp_path / "units.json"), split=True).collect()
        (tmp_path / "events.json").write_text(json.dumps({"events": [{"id": "x", "geography": {"type": "Point", "coordinates": [1, 2]}}], "pagination": {"id": "not an event"}}))
        events = open511(spark, str(tmp_path / "events.json"), split=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert split == roads(spark, str(tmp_path / "roads.json")).orderBy("fullname").collect() and len(split) == 50
    assert [(u.zone_id, u.unit_id) for u in units] == [("1", "E1")]
    assert events == open511(spark, str(tmp_path / "events.json")).collect() and len(events) == 1


def test_many_tasks_read_one_file(spark, tmp_path):
    d = spark.range(3000).selectExpr("id", "named_struct('ID', id, 'TEXT', concat(repeat('} {\"', cast(id % 5 as int)), id)) as properties", "named_struct('type', 'Point', 'coordinates', array(id / 10D, 0.5D)) as geometry")
    write_features(d, str(tmp_path / "f"), "id", per_file=2000)
    assert len(list((tmp_path / "f").rglob("*.txt"))) == 2
    got = json_objects(spark, str(tmp_path / "f/*/*.txt"), 20_000)
    assert got.where("member = 'features'").count() == 3000 and got.where("member = 'crs'").count() == 2
    rows = features(spark, str(tmp_path / "f/*/*.txt"), split=True)
    assert sorted(int(r.props["ID"]) for r in rows.collect()) == list(range(3000))
    assert rows.where("props['TEXT'] != concat(repeat('} {\"', cast(props['ID'] % 5 as int)), props['ID'])").count() == 0


def test_head_and_tail_share_the_file_of_their_rows(spark, tmp_path):
    # rows large enough to be shuffled in several partitions
    t = "concat_ws('', transform(sequence(1, 40), i -> sha2(concat(id, '-', i), 256)))"
    d = spark.range(4000).selectExpr("id AS key", f"to_json(named_struct('ID', id, 'T', {t})) AS value")
    write_listed(d, str(tmp_path / "f"), '{"features":[', "]}", 500)
    files = list((tmp_path / "f").rglob("*.txt"))
    assert len(files) == 8
    assert sorted(o["ID"] for f in files for o in json.loads(f.read_text())["features"]) == list(range(4000))
    assert json_objects(spark, str(tmp_path / "f/*/*.txt")).where("member = 'features'").count() == 4000
