"""Many requests for one thing and many copies of it: rows of a step grow with what differs, not with requests times copies."""

from pyspark.sql import functions as F

from sirenflow.functions import geo
from sirenflow.operators import geocode, spatial, streets
from sirenflow.operators import junction_lookup as jl

N = 40
STRAIGHT = ("0.0D AS x1", "0.0D AS y1", "0.01D AS x2", "0.0D AS y2")


def _most_rows(df):
    """(rows, the most rows that one step of the plan that ran gives out)."""
    got, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            m = p.metrics().get("numOutputRows")
            most = max(most, m.get().value() if m.isDefined() else 0)
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return got, most


def _parcels(spark):
    return spark.range(N).selectExpr("id AS parcel_id", "'7' AS house", "'Oak' AS street", "'ST' AS street_type", "1.0D * id AS lat", "2.0D AS lng", *[f"cast(null as double) AS {k}_{c}" for k in ("front", "entrance") for c in ("lat", "lng")])


def _requests(spark):
    return spark.range(N).selectExpr("id AS request_id", "'7' AS house", "'OAK' AS street", "'ST' AS street_type")


def test_exact_parcel(spark):
    got, most = _most_rows(geocode.exact_parcel(_requests(spark), _parcels(spark)))
    assert {(r.request_id, r.lat, r.confidence) for r in got} == {(i, 0.0, 100) for i in range(N)} and most <= 2 * N


def test_block_range(spark):
    roads = spark.range(N).selectExpr("id AS road_id", "'OAK ST' AS fullname", "'Oak' AS roadname", "1 AS left_begin", "13 AS left_end", "2 AS right_begin", "14 AS right_end", *STRAIGHT)
    got, most = _most_rows(geocode.block_range(_requests(spark), roads))
    assert {(r.request_id, round(r.lng, 9)) for r in got} == {(i, 0.005) for i in range(N)} and most <= 4 * N


def test_intersection_lookup(spark):
    r = spark.range(N).selectExpr("id AS request_id", "'A & B' AS key", "CASE WHEN id < 10 THEN '3' WHEN id < 20 THEN '9' END AS map_grid")
    i = spark.range(N).selectExpr("'A & B' AS key", "cast(id as int) AS candidate_index", "1.0D * id AS lat", "2.0D AS lng", "cast(id % 4 as string) AS zone_id")
    got, most = _most_rows(geocode.intersection_lookup(r, i))
    assert {(g.request_id, g.candidates, g.grid_conflict, g.lat) for g in got} == {(k, 10 if k < 10 else N, 10 <= k < 20, 3.0 if k < 10 else 0.0) for k in range(N)} and most <= 4 * N


def test_suggestions(spark):
    r = spark.range(N).selectExpr("id AS request_id", "'STREAT1' AS street_a", "'STREET2' AS street_b")
    i = spark.range(N).selectExpr("'STREET1 & STREET2' AS key", "cast(id as int) AS candidate_index", "1.0D * id AS lat", "2.0D AS lng")
    got, most = _most_rows(jl.suggestions(r, i))
    assert {(g.request_id, g.candidate_index, g.rank) for g in got} == {(k, j, j + 1) for k in range(N) for j in range(6)} and most <= 6 * N


def test_narrow_by_roads(spark):
    c = spark.range(N).selectExpr("id AS request_id", "0 AS candidate_index", "0.001D AS lat", "0.005D AS lng")
    got, most = _most_rows(jl.narrow_by_roads(c, c.selectExpr("request_id", "'OAK' AS cross"), spark.range(N).selectExpr("'OAK' AS canon", *STRAIGHT)))
    assert {(g.request_id, round(g.road_m, 6)) for g in got} == {(k, round(0.001 * geo.DEGREE_M, 6)) for k in range(N)} and most <= 2 * N


def test_parcel_lookup(spark):
    q = spark.range(N).selectExpr("CASE WHEN id % 2 = 0 THEN '7 oak st' ELSE 'AK ST' END AS query")
    got, most = _most_rows(geocode.parcel_lookup(q, spark.range(N).selectExpr("id AS parcel_id", "concat('G', id) AS gis_id", "'7 OAK ST' AS address")))
    assert sorted((g.query, g.parcel_id, g.match) for g in got) == sorted([("7 oak st", 0, "clean"), ("AK ST", 0, "contains")] * (N // 2)) and most <= 3 * N


def test_parcel_hydrants(spark):
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    t = spark.range(N).select(F.col("id").alias("dispatch_id"), F.lit(0.001).alias("lat"), F.lit(0.0).alias("lng"), none.alias("ring"), none.alias("route"))
    got, most = _most_rows(streets.parcel_hydrants(t, spark.range(N).selectExpr("id AS object_id", "0.0D AS lat", "0.0D AS lng")))
    assert {(g.dispatch_id, g.object_id, g.dist_m, g.rank) for g in got} == {(k, j, 111, j + 1) for k in range(N) for j in range(3)} and most <= 3 * N


def test_repeated_segments_make_no_pairs(spark):
    s = spark.range(N).selectExpr("'A' AS canon", *STRAIGHT).unionByName(spark.range(N).selectExpr("'B' AS canon", "0.005D AS x1", "-0.01D AS y1", "0.005D AS x2", "0.01D AS y2"))
    assert spatial.segment_pairs(s).count() == 1
    assert [(r.x, r.y) for r in spatial.line_crossings(s).collect()] == [(0.005, 0.0)] == [(r.x, r.y) for r in spatial.street_nodes(s).collect()]


def test_repeated_segments_and_places_of_nearest_road(spark):
    s = spark.range(N).selectExpr("id + 5 AS road_id", "'OAK ST' AS fullname", *STRAIGHT)
    assert [r.road_id for r in streets._first_of_each(s).collect()] == [5]
    p = spark.range(N).selectExpr("id AS parcel_id", "'Oak' AS street", "'St' AS street_type", "0.001D AS lat", "0.005D AS lng")
    for got in (streets.nearest_road(p, "parcel_id", s), streets.own_street_front(p, s)):
        assert {(r.parcel_id, r.road_id, round(r.dist_m, 3)) for r in got.collect()} == {(k, 5, 111.195) for k in range(N)}


def test_distances_and_rounding_as_in_sql(spark):
    r = spark.sql("SELECT 0.285D AS a, -0.285D AS b").select(geo.rounded(F.col("a"), 2), geo.rounded(F.col("b"), 2)).first()
    assert tuple(r) == (0.28, -0.28)
    # DuckDB: 221.92458749986454 to road 3700 and 221.92458750081067 to road 1220, a difference in the order of the operations
    s = spark.createDataFrame([(1220, -122.78, 49.24, -122.81333333333333, 49.190000000000005), (3700, -122.82000000000001, 49.28, -122.78666666666668, 49.230000000000004)], "road_id long, x1 double, y1 double, x2 double, y2 double").withColumn("fullname", F.lit("OAK ST"))
    p = spark.createDataFrame([(17500, "OAK", "ST", 49.230000000000004, -122.79)], "parcel_id long, street string, street_type string, lat double, lng double")
    assert [(x.road_id, x.exact_m) for x in streets.own_street_front(p, s).collect()] == [(3700, 221.92458749986454)]


def test_sections_count_every_segment_and_each_request_once(spark):
    zone = "array(array(struct(0.0D AS x, 0.0D AS y), struct(1.0D AS x, 0.0D AS y), struct(1.0D AS x, 1.0D AS y), struct(0.0D AS x, 1.0D AS y)))"
    z = spark.range(1).selectExpr("'7' AS map_name", f"{zone} AS rings")
    # two roads that run through the zone on one line
    s = spark.sql("SELECT 'OAK' AS canon, 0.5D AS x1, -0.5D AS y1, 0.5D AS x2, 1.5D AS y2 UNION ALL SELECT 'OAK', 0.5D, -0.25D, 0.5D, 1.25D")
    r = spark.range(2).selectExpr("'r' AS request_id", "'Oak' AS street", "'Grid 7' AS map_grid")
    got = streets.street_sections(r, s, z).collect()
    assert [(g.request_id, g.pieces, g.length_m) for g in got] == [("r", 2, round(2 * geo.DEGREE_M))]


def test_closure_zone_without_the_sliver_rule(spark):
    box = lambda x0, x1: f"array(array(struct({x0}D AS x, 0.0D AS y), struct({x1}D AS x, 0.0D AS y), struct({x1}D AS x, 0.01D AS y), struct({x0}D AS x, 0.01D AS y)))"
    z = spark.sql(f"SELECT '1' AS map_name, '1' AS hall_id, {box(-0.01, -0.001)} AS rings UNION ALL SELECT '2', '2', {box(0.00002, 0.01)}")
    c = spark.sql("SELECT 'R' AS closure_id, array(struct(-0.005D AS x, 0.005D AS y), struct(0.005D AS x, 0.005D AS y)) AS points")
    zone = lambda **kw: streets.closure_zones(c, z, **kw).first().zone_id
    assert zone() == "2" and zone(sliver_m=0.0) == "1"
