"""Spatial joins as equi-joins on grid cells followed by an exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenflow.functions import geo
from sirenflow.operators import density
from sirenflow.operators.lineage import saved

ZONE_CELL = 0.01
PAIR_CELL = 0.01  # at least, for pairs of segments
SPLITS = 6  # down to cells of some 15 m
NEAR_CELL = 0.013  # above 800 m in both directions at the latitudes served (below 55 degrees)
NEAR_LAT, NEAR_LNG = 0.0075, 0.013  # the same with cells no higher than need be
SLIVER_M, SNAP_M = 5.0, 2.0
CITY_M, PRIVATE_M = 800.0, 400.0
OUT_OF_USE = ("ABANDONED", "OUT_OF_SERVICE", "INACTIVE")


def zone_cells(zones: DataFrame, name: str = "map_name", rings: str = "rings", pad_m: float = SLIVER_M) -> DataFrame:
    """(map_name, edges, cx, cy): for every cell that a zone's padded box touches, the zone's edges at the height of the cell.

    Crossing parity, edge and distance tests of a cell's points look at no other edges, so a long outline is not copied
    whole into each cell.
    """
    z = _zone_boxes(zones, rings, name, pad_m)
    return z.select("map_name", "edges", "cx", "cy")


def _at_height(rows: DataFrame, size: float, pad: float) -> DataFrame:
    """Rows of zones in cells, with the edges at their cell's height alone; a cell without any goes."""
    south, north = F.col("cy") * size - pad, (F.col("cy") + 1) * size + pad
    level = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= south) & (F.least(e["y1"], e["y2"]) <= north))
    return rows.withColumn("edges", level).where(F.size("edges") > 0)


def _zone_boxes(zones: DataFrame, rings: str, name: str, pad_m: float) -> DataFrame:
    z = zones.select(F.col(name).alias("map_name"), geo.ring_edges(F.col(rings)).alias("edges"))
    pad = pad_m / geo.DEGREE_M * 2
    lo = lambda k: F.array_min(F.transform("edges", lambda e: F.least(e[f"{k}1"], e[f"{k}2"]))) - pad
    hi = lambda k: F.array_max(F.transform("edges", lambda e: F.greatest(e[f"{k}1"], e[f"{k}2"]))) + pad
    z = z.withColumns({f"{k}{end}": of(k) for k in "xy" for end, of in (("lo", lo), ("hi", hi))})
    cells = lambda k: F.sequence(geo.cell(F.col(f"{k}lo"), ZONE_CELL), geo.cell(F.col(f"{k}hi"), ZONE_CELL))
    z = _at_height(z.withColumns({"xs": cells("x"), "cy": F.explode(cells("y"))}), ZONE_CELL, pad)
    return z.withColumn("cx", F.explode("xs")).drop("xs")


def with_zone(points: DataFrame, zones: DataFrame, lat: str = "lat", lng: str = "lng", out: str = "zone_id", strict: bool = False, per_cell: int | None = None, sliver_m: float = SLIVER_M) -> DataFrame:
    """SPJ-01: the zone of each point; with ``strict`` SPJ-02, 03 and 06, where a boundary point has none.

    Boundary-inclusive; of several zones the lowest numeric name (other names last); else the nearest zone
    within 5 m (``sliver_m``, at most that); else null. Each different place is looked up once and meets only the zones whose box touches its cell;
    partial minima are taken per place. Points with a null coordinate get null; a column ``out`` is replaced.
    With ``per_cell`` a cell of more different places is split in four, up to ``SPLITS`` times, so that neither a crowded quarter
    nor many small zones in one cell are one task's work; it costs a count of the places.
    """
    keyed = points.select(F.col(lat).alias("__y"), F.col(lng).alias("__x")).where("__x is not null and __y is not null").distinct()
    x, y = F.col("__x"), F.col("__y")
    if per_cell:
        keyed, pad = saved(keyed), SLIVER_M / geo.DEGREE_M * 2
        dense = density.dense_cells(keyed, "__x", "__y", ZONE_CELL, per_cell, SPLITS)
        cells = density.to_leaves(_zone_boxes(zones, "rings", "map_name", SLIVER_M), dense, ZONE_CELL, SPLITS, lambda rows, width: _at_height(rows, width, pad))
        met = density.in_leaf(keyed, dense, x, y, ZONE_CELL, SPLITS).join(cells.select("map_name", "edges", "level", "cx", "cy"), ["level", "cx", "cy"])
    else:
        met = keyed.withColumns({"cx": geo.cell(x, ZONE_CELL), "cy": geo.cell(y, ZONE_CELL)}).join(zone_cells(zones), ["cx", "cy"])
    edge = geo.on_edge(x, y, F.col("edges"))
    hit = geo.inside(x, y, F.col("edges")) & ~edge if strict else geo.inside(x, y, F.col("edges")) | edge
    away = F.when(hit, F.lit(-1.0)).otherwise(F.lit(None).cast("double") if strict else geo.edge_distance_m(x, y, F.col("edges")))
    number = F.col("map_name").try_cast("int")
    ranked = met.withColumn("__d", away).where(F.col("__d") <= sliver_m)
    best = ranked.groupBy("__x", "__y").agg(F.min(F.struct("__d", number.isNull().alias("word"), number.alias("number"), F.col("map_name").alias("name"))).alias("__z"))
    own = [F.col(c) for c in points.columns if c != out]
    return points.join(best, (points[lng] == best["__x"]) & (points[lat] == best["__y"]), "left").select(*own, F.col("__z.name").alias(out))


def _around(things: DataFrame, thing: str, lat: str, lng: str, *more: str) -> DataFrame:
    """Things in the nine cells around theirs."""
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    h = things.select(F.col(thing).alias("thing"), F.col(lat).alias("hy"), F.col(lng).alias("hx"), *more).where("hy is not null and hx is not null")
    h = h.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    return h.withColumns({"cx": geo.cell(F.col("hx"), NEAR_LNG) + F.col("dx"), "cy": geo.cell(F.col("hy"), NEAR_LAT) + F.col("dy")}).drop("dx", "dy")


def _met(targets: DataFrame, key: str, around: DataFrame, radius_m: float, lat: str, lng: str) -> DataFrame:
    """Targets and things of the nine cells around whose box of the radius holds the target, with their distance."""
    if radius_m > min(NEAR_LAT, NEAR_LNG * 0.57) * geo.DEGREE_M:
        raise ValueError("the radius must fit a cell")
    t = targets.select(F.col(key).alias("__k"), F.col(lat).alias("ty"), F.col(lng).alias("tx")).where("ty is not null and tx is not null")
    t = t.withColumns({"cx": geo.cell(F.col("tx"), NEAR_LNG), "cy": geo.cell(F.col("ty"), NEAR_LAT), "reach": F.lit(radius_m / geo.DEGREE_M * 1.001) / F.cos(F.radians("ty"))})
    box = (F.abs(F.col("ty") - F.col("hy")) <= radius_m / geo.DEGREE_M * 1.001) & (F.abs(F.col("tx") - F.col("hx")) <= F.col("reach") * 1.01)
    return t.join(around, ["cx", "cy"]).where(box).withColumn("dist_m", geo.haversine_m(F.col("ty"), F.col("tx"), F.col("hy"), F.col("hx"))).where(F.col("dist_m") <= radius_m)


def nearest_within(targets: DataFrame, key: str, things: DataFrame, thing: str, radius_m: float, n: int = 1, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(key, thing, dist_m, rank): the ``n`` nearest things within the radius of each target, ties by id.

    Targets stay in one cell; things, the fewer, enter the nine cells around theirs, so ``radius_m`` must be at most the cell.
    A box of the radius is tested before the distance.
    """
    near = _met(targets, key, _around(things, thing, lat, lng), radius_m, lat, lng)
    if n == 1:  # a partial minimum, no sort
        got = near.groupBy("__k").agg(F.min(F.struct("dist_m", "thing")).alias("b")).select("__k", F.col("b.thing").alias("thing"), F.col("b.dist_m").alias("dist_m"), F.lit(1).alias("rank"))
    else:
        best = near.groupBy("__k").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist_m", "thing"))), 1, n).alias("b"))
        got = best.select("__k", F.posexplode("b").alias("p", "s")).select("__k", F.col("s.thing").alias("thing"), F.col("s.dist_m").alias("dist_m"), (F.col("p") + 1).alias("rank"))
    return got.withColumnsRenamed({"__k": key, "thing": thing})


def _nearest_in_rings(places: DataFrame, things: DataFrame, radius_m: float) -> DataFrame:
    """(py, px, thing, dist_m): the nearest thing (thing, hy, hx) within the radius of each place, ties by id, searched outwards.

    The first ring has cells of a third of the radius: whatever lies within a cell's width is in the nine cells around, so
    a place that finds a thing that near is done. The others go on with cells of the whole radius.
    """
    left, out, around = places, None, F.array(*[F.lit(d) for d in (-1, 0, 1)])
    for reach in (radius_m / 3, radius_m):
        lat_size = reach * 1.001 / geo.DEGREE_M
        lng_size = lat_size / 0.57  # wide enough below 55 degrees
        h = things.select("thing", "hy", "hx", (geo.cell(F.col("hy"), lat_size)).alias("cy"), geo.cell(F.col("hx"), lng_size).alias("cx"))
        h = h.withColumn("cy", F.explode(F.transform(around, lambda d: F.col("cy") + d))).withColumn("cx", F.explode(F.transform(around, lambda d: F.col("cx") + d)))
        t = left.withColumns({"cy": geo.cell(F.col("py"), lat_size), "cx": geo.cell(F.col("px"), lng_size)})
        # a box of the reach before the distance
        box = (F.abs(F.col("py") - F.col("hy")) <= lat_size) & (F.abs(F.col("px") - F.col("hx")) * F.cos(F.radians("py")) <= lat_size * 1.01)
        m = t.join(h, ["cy", "cx"]).where(box).select("py", "px", "thing", geo.haversine_m(F.col("py"), F.col("px"), F.col("hy"), F.col("hx")).alias("dist_m")).where(F.col("dist_m") <= reach)
        got = m.groupBy("py", "px").agg(F.min(F.struct("dist_m", "thing")).alias("b")).select("py", "px", F.col("b.thing").alias("thing"), F.col("b.dist_m").alias("dist_m"))
        if out is None:
            out = saved(got)
            left = left.join(out.select("py", "px"), ["py", "px"], "left_anti")
        else:
            out = out.unionByName(got)
    return out


def nearest_hydrants(targets: DataFrame, hydrants: DataFrame, key: str = "dispatch_id") -> DataFrame:
    """SPJ-12: nearest usable city hydrant within 800 m and nearest private one (no flow class) within 400 m, nulls where none.

    Each different place is looked up once, in rings. Targets without a coordinate get nulls.
    """
    usable = hydrants.where(~F.coalesce(F.upper("status"), F.lit("")).isin(*OUT_OF_USE) & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    usable = usable.select(F.col("object_id").alias("thing"), F.col("lat").alias("hy"), F.col("lng").alias("hx"), F.col("flow_class").isNull().alias("private"))
    own = targets.select(key, F.col("lat").alias("py"), F.col("lng").alias("px"))
    places = saved(own.select("py", "px").where("py is not null and px is not null").distinct())
    city = _nearest_in_rings(places, usable.where("not private"), CITY_M).select("py", "px", F.col("thing").alias("city_id"), F.col("dist_m").alias("city_m"))
    private = _nearest_in_rings(places, usable.where("private"), PRIVATE_M).select("py", "px", F.col("thing").alias("private_id"), F.col("dist_m").alias("private_m"))
    found = city.join(private, ["py", "px"], "full_outer")
    return own.join(found, ["py", "px"], "left").select(key, "city_id", "city_m", "private_id", "private_m")


def in_grid(points: DataFrame, zones: DataFrame, grid: str = "map_grid", lat: str = "lat", lng: str = "lng", out: str = "in_grid") -> DataFrame:
    """SPJ-03: whether each point lies strictly inside the zone it names ("GRID 7" and "ZONE 7" are 7); unknown names and null places are not."""
    z = zones.select(F.upper(F.trim("map_name")).alias("__g"), geo.ring_edges(F.col("rings")).alias("__edges"))
    p = points.withColumn("__g", F.upper(F.trim(F.regexp_replace(F.trim(grid), r"(?i)^(?:GRID|ZONE)\s*", ""))))
    x, y, e = F.col(lng), F.col(lat), F.col("__edges")
    return p.join(z, "__g", "left").withColumn(out, F.coalesce(geo.inside(x, y, e) & ~geo.on_edge(x, y, e), F.lit(False))).drop("__g", "__edges")


def _pair_cell(s: DataFrame) -> float:
    """A cell's width for pairs of segments: half of their mean extent, where long ones meet in few cells and cells stay small."""
    wide = s.agg(*[F.avg(F.abs(F.col(f"{k}2") - F.col(f"{k}1"))) for k in "xy"]).first()
    return max(PAIR_CELL, sum(w or 0.0 for w in wide) / 4)


def _boxes(s: DataFrame, size: float, pad: float) -> DataFrame:
    """Segments with their padded box, once in each cell of the box."""
    s = s.withColumns({f"{k}lo": F.least(f"{k}1", f"{k}2") - pad for k in "xy"} | {f"{k}hi": F.greatest(f"{k}1", f"{k}2") + pad for k in "xy"})
    for k in "xy":
        s = s.withColumn(f"c{k}", F.explode(F.sequence(geo.cell(F.col(f"{k}lo"), size), geo.cell(F.col(f"{k}hi"), size))))
    return s


def segment_pairs(segments: DataFrame, size: float | None = None, pad: float = 0.0) -> DataFrame:
    """Pairs of segments of two different streets whose boxes, each padded, meet: canon_a, canon_b, ax1 .. by2, each pair once.

    A pair meets in every cell that both boxes touch; it is kept in the one that holds the lower left corner of what the
    boxes share, so no pair is told apart by a shuffle. Repeats of a segment add no pair.
    """
    s = saved(segments.select("canon", "x1", "y1", "x2", "y2").dropna().distinct())
    size = size or _pair_cell(s)
    s = _boxes(s, size, pad)
    a, b = s.alias("a"), s.alias("b")
    col = lambda t, c: F.col(f"{t}.{c}")
    at = lambda k: geo.cell(F.greatest(col("a", f"{k}lo"), col("b", f"{k}lo")), size) == col("a", f"c{k}")
    meet = (col("a", "cx") == col("b", "cx")) & (col("a", "cy") == col("b", "cy")) & (col("a", "canon") < col("b", "canon"))
    for k in "xy":
        meet = meet & (col("a", f"{k}lo") <= col("b", f"{k}hi")) & (col("b", f"{k}lo") <= col("a", f"{k}hi")) & at(k)
    m = a.join(b, meet)
    return m.select(col("a", "canon").alias("canon_a"), col("b", "canon").alias("canon_b"), *[col(t, f"{k}{n}").alias(f"{t}{k}{n}") for t in "ab" for k in "xy" for n in "12"])


def _at(x: Column, y: Column) -> Column:
    return F.struct(geo.rounded(x, 6).alias("x"), geo.rounded(y, 6).alias("y"))


def _crossing() -> Column:
    """Where a pair's segments cross; null if they do not."""
    ax, ay, bx, by = F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1"), F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    det, ox, oy = ax * by - ay * bx, F.col("bx1") - F.col("ax1"), F.col("by1") - F.col("ay1")
    t, u = F.try_divide(ox * by - oy * bx, det), F.try_divide(ox * ay - oy * ax, det)
    return F.when((F.abs(det) > 1e-18) & t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9), _at(F.col("ax1") + t * ax, F.col("ay1") + t * ay))


def _points(pairs: DataFrame, at: Column) -> DataFrame:
    return pairs.select("canon_a", "canon_b", at.alias("p")).where("p is not null").select("canon_a", "canon_b", "p.x", "p.y").distinct()


def line_crossings(segments: DataFrame, size: float | None = None) -> DataFrame:
    """SPJ-09: (canon_a, canon_b, x, y): points where segments of two different streets cross, each once.

    ``segments``: canon, x1, y1, x2, y2. Parallel segments give none here; see ``street_nodes``.
    """
    return _points(segment_pairs(segments, size, 1e-9), _crossing())


def _stretch() -> Column:
    """The middle of what a pair's collinear segments share; null if they share nothing."""
    ax, ay = F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1")
    n = ax * ax + ay * ay
    on = lambda i: F.try_divide((F.col(f"bx{i}") - F.col("ax1")) * ax + (F.col(f"by{i}") - F.col("ay1")) * ay, n)
    off = lambda i: F.abs((F.col(f"bx{i}") - F.col("ax1")) * ay - (F.col(f"by{i}") - F.col("ay1")) * ax) <= geo.EDGE * F.sqrt(n)
    lo, hi = F.greatest(F.lit(0.0), F.least(on(1), on(2))), F.least(F.lit(1.0), F.greatest(on(1), on(2)))
    t = (lo + hi) / 2
    return F.when((n > 0) & off(1) & off(2) & (hi - lo >= -1e-9), _at(F.col("ax1") + t * ax, F.col("ay1") + t * ay))


def shared_stretches(segments: DataFrame, size: float | None = None) -> DataFrame:
    """SPJ-09: (canon_a, canon_b, x, y): the middle of each stretch that collinear segments of two streets share (a common end is one too)."""
    return _points(segment_pairs(segments, size, 1e-8), _stretch())


def _snap() -> Column:
    """(m, x, y): metres and middle of the shortest link from an end of one of a pair's segments to the other one."""
    ends = []
    for p, q in (("a", "b"), ("b", "a")):
        k = F.cos(F.radians(F.col(f"{p}y1")))
        dx, dy = (F.col(f"{q}x2") - F.col(f"{q}x1")) * k, F.col(f"{q}y2") - F.col(f"{q}y1")
        n = dx * dx + dy * dy
        for i in "12":
            px, py = F.col(f"{p}x{i}"), F.col(f"{p}y{i}")
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - F.col(f"{q}x1")) * k * dx + (py - F.col(f"{q}y1")) * dy, n), F.lit(0.0))))
            fx, fy = F.col(f"{q}x1") + t * (F.col(f"{q}x2") - F.col(f"{q}x1")), F.col(f"{q}y1") + t * (F.col(f"{q}y2") - F.col(f"{q}y1"))
            ends.append(F.struct((F.sqrt(F.pow((px - fx) * k, 2) + F.pow(py - fy, 2)) * geo.DEGREE_M).alias("m"), ((px + fx) / 2).alias("x"), ((py + fy) / 2).alias("y")))
    return F.least(*ends)


def _snaps(links: DataFrame, met: DataFrame, snap_m: float) -> DataFrame:
    apart = links.where(F.col("e.m") <= snap_m).join(met.select("canon_a", "canon_b").distinct(), ["canon_a", "canon_b"], "left_anti")
    best = apart.groupBy("canon_a", "canon_b").agg(F.min("e").alias("e"))
    return best.select("canon_a", "canon_b", geo.rounded(F.col("e.x"), 6).alias("x"), geo.rounded(F.col("e.y"), 6).alias("y"))


def endpoint_snaps(segments: DataFrame, met: DataFrame, size: float | None = None, snap_m: float = SNAP_M) -> DataFrame:
    """SPJ-09: (canon_a, canon_b, x, y): for streets that come within ``snap_m`` of each other and do not meet (``met``: canon_a, canon_b), the middle of their shortest link.

    Segments that do not cross are closest at an end of one of them.
    """
    pairs = segment_pairs(segments, size, snap_m / geo.DEGREE_M * 2)
    return _snaps(pairs.select("canon_a", "canon_b", _snap().alias("e")), met, snap_m)


def street_nodes(segments: DataFrame, size: float | None = None) -> DataFrame:
    """SPJ-09 with SET-04: crossings, middles of shared stretches and endpoint snaps of all pairs of streets, each point once.

    The pairs of segments whose boxes meet are gone through once; only what they have of the three kinds of points is written.
    """
    pairs = segment_pairs(segments, size, SNAP_M / geo.DEGREE_M * 2)
    found = F.struct(F.array_compact(F.array(_crossing(), _stretch())).alias("p"), _snap().alias("e"))
    # behind a generator, so that the filter does not compute the points once more
    got = pairs.select("canon_a", "canon_b", F.explode(F.array(found)).alias("f")).select("canon_a", "canon_b", "f.p", F.when(F.col("f.e.m") <= SNAP_M, F.col("f.e")).alias("e"))
    got = saved(got.where("size(p) > 0 or e is not null"))
    meets = saved(got.select("canon_a", "canon_b", F.explode("p").alias("p")).select("canon_a", "canon_b", "p.x", "p.y").distinct())
    return meets.unionByName(_snaps(got, meets, SNAP_M))


def number_candidates(nodes: DataFrame) -> DataFrame:
    """WIN-01: candidate_index from 0 per street pair, by (x, y)."""
    from pyspark.sql import Window

    w = Window.partitionBy("canon_a", "canon_b").orderBy("x", "y")
    return nodes.withColumn("candidate_index", F.row_number().over(w) - 1)
