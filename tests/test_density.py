"""Cells that follow the density of places: the zones of fixed cells, and no cell that holds most of the places."""

import random

from pyspark.sql import functions as F

from sirenflow.operators import density, spatial
from sirenflow.operators.density import dense_cells, in_leaf


def _places(spark, n=4000):
    rnd = random.Random(5)
    rows = [(i, 49.2301 + rnd.random() * 0.0098, -122.8799 + rnd.random() * 0.0098) if i % 10 else (i, 49.2 + rnd.random() * 0.1, -122.92 + rnd.random() * 0.1) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 1.0), (n + 1, 49.2351, -122.876), (n + 2, 49.2351, -122.876)], "id long, lat double, lng double")


def _zones(spark):
    ring = lambda x, y, w: [[{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + w}, {"x": x, "y": y + w}]]
    small = [(str(i), ring(-122.88 + 0.001 * (i % 10), 49.23 + 0.001 * (i // 10), 0.001)) for i in range(97)]
    # far south of zero as well, and a zone over all of them
    return spark.createDataFrame([*small, ("900", ring(-122.95, 49.15, 0.11)), ("word", ring(-122.95, 49.15, 0.2))], "map_name string, rings array<array<struct<x:double,y:double>>>")


def test_zones_are_those_of_fixed_cells(spark):
    p, z = _places(spark), _zones(spark)
    for strict in (False, True):
        fixed = sorted((r.id, r.zone_id) for r in spatial.with_zone(p, z, strict=strict).collect())
        for per_cell in (1, 150) if strict else (150, 10**9):
            assert sorted((r.id, r.zone_id) for r in spatial.with_zone(p, z, strict=strict, per_cell=per_cell).collect()) == fixed
    assert sum(v is not None for _, v in fixed) > 3500
    empty = p.limit(0)
    assert spatial.with_zone(empty, z, per_cell=10).count() == 0


def test_no_leaf_holds_more_than_its_share(spark):
    p = _places(spark).where("lat is not null").select("lat", "lng").distinct()
    dense = dense_cells(p, "lng", "lat", 0.01, 150, 6)
    leaf = in_leaf(p, dense, F.col("lng"), F.col("lat"), 0.01, 6)
    counts = [r["count"] for r in leaf.groupBy("level", "cx", "cy").count().collect()]
    assert sum(counts) == p.count() and max(counts) <= 150
    # a parent of every split cell is split: leaves do not overlap
    cells = {(r.level, r.cx, r.cy) for r in dense.collect()}
    assert cells and all(level == 0 or (level - 1, x >> 1, y >> 1) in cells for level, x, y in cells)


def test_split_cells_stay_few(spark, monkeypatch):
    monkeypatch.setattr(density, "MOST_SPLIT", 20)
    p = _places(spark).where("lat is not null").select("lat", "lng").distinct()
    per_level = dense_cells(p, "lng", "lat", 0.01, 1, 6).groupBy("level").count().collect()
    assert max(r["count"] for r in per_level) <= 20
