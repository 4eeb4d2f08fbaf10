"""Components by contraction, and points linked step by step."""

import math
import random

from sirenflow.operators import linkage


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    path = [(k, k + 1) for k in range(1, 60)]
    rng.shuffle(path)
    edges = path + [(200, k) for k in range(201, 230)] + [(300, 300), (None, 5), (7, 6)] + path[:5]
    got = {r.node: r.root for r in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 200 for k in range(200, 230)}
    assert linkage.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_points_of_dense_and_sparse_cells(spark):
    rng = random.Random(9)
    deg = math.pi / 180 * 6371000
    rows = [("a", -122.8 + rng.uniform(0, 0.004), 49.25 + rng.uniform(0, 0.004)) for _ in range(150)] + [("a", -122.9 + rng.uniform(0, 0.0003), 49.2 + rng.uniform(0, 0.0003)) for _ in range(120)]
    rows = sorted(set(rows))
    k = math.cos(math.radians(sum(r[2] for r in rows) / len(rows)))
    groups: list[list[int]] = []
    for i, p in enumerate(rows):
        near = [g for g in groups if any(math.hypot((p[1] - rows[j][1]) * k, p[2] - rows[j][2]) * deg <= 25 for j in g)]
        groups = [g for g in groups if g not in near] + [[i, *(j for g in near for j in g)]]
    got = linkage.linked_points(spark.createDataFrame(rows, "g string, x double, y double").repartition(4), ["g"], 25.0).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.cluster, set()).add((r.x, r.y))
    assert sorted(map(sorted, found.values())) == sorted(sorted((rows[j][1], rows[j][2]) for j in g) for g in groups)
