"""Parts of lines joined by pointer doubling, against joining them one by one."""

import random

from sirenflow.functions.lines import merged_line
from sirenflow.operators import chains

LINES = "road_id int, lines array<array<struct<lng:double,lat:double>>>"


def _length(line):
    return sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(line, line[1:], strict=False))


def _at(line, f):
    left = f * _length(line)
    for a, b in zip(line, line[1:], strict=False):
        n = ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
        if n and left <= n + 1e-12:
            return (a[0] + (b[0] - a[0]) * left / n, a[1] + (b[1] - a[1]) * left / n)
        left -= n
    return line[-1]


def test_places_on_lines_of_many_parts(spark):
    rng = random.Random(4)
    roads = []
    for k in range(25):
        path = [(float(i), rng.uniform(0, 1)) for i in range(rng.randint(2, 40))]
        cuts = sorted({0, len(path) - 1, *rng.sample(range(len(path)), rng.randint(1, min(9, len(path))))})
        parts = [path[a : b + 1] for a, b in zip(cuts, cuts[1:], strict=False)]
        parts = [p[::-1] if rng.random() < 0.5 else p for p in parts]
        rng.shuffle(parts)
        parts += [[(100.0, 100.0), (100.1, 100.0)]] * (k % 2)  # a shorter piece that meets nothing
        roads.append((k, parts))
    roads += [(50, [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 0.0)], [(1.0, 0.0), (1.0, 3.0)]]), (51, [[(0.0, 0.0)], [(0.0, 0.0), (4.0, 0.0)]])]
    df = spark.createDataFrame(roads, LINES)
    asked = [(10 * r + i, r, f) for r, _ in roads for i, f in enumerate((0.0, 0.3, 1.0))] + [(9000, 51, 7.0), (9001, 51, None), (9002, 777, 0.5)]
    got = {r.request_id: (r.lng, r.lat) for r in chains.points_at(spark.createDataFrame(asked, "request_id int, road_id int, f double"), df).collect()}
    assert 9001 not in got and 9002 not in got and got[9000] == (4.0, 0.0)
    close = lambda p, q: abs(p[0] - q[0]) + abs(p[1] - q[1]) < 1e-9
    for r, parts in roads:
        line = merged_line(parts)
        turned = not close(got[10 * r], line[0])  # the direction is the chain's own
        assert all(close(got[10 * r + i], _at(line[::-1] if turned else line, f)) for i, f in enumerate((0.0, 0.3, 1.0)))


def test_rings_begin_with_their_lowest_part(spark):
    ring = [[(1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(1.0, 1.0), (1.0, 0.0)], [(0.0, 0.0), (0.0, 1.0)]]
    lone = [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]
    rows = chains.chained(spark.createDataFrame([(1, ring), (2, lone), (3, []), (4, None), (None, ring)], LINES)).orderBy("road_id", "seq").collect()
    got = [(r.road_id, r.chain, r.seq, r.part, r.forward, r.before, r.total) for r in rows]
    assert got == [(1, 0, 0, 0, True, 0.0, 4.0), (1, 0, 1, 3, False, 1.0, 4.0), (1, 0, 2, 1, True, 2.0, 4.0), (1, 0, 3, 2, False, 3.0, 4.0), (2, 0, 0, 0, True, 0.0, 2.0)]
    assert chains.chained(spark.createDataFrame([], LINES)).count() == 0
