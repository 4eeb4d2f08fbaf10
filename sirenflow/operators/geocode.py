"""Bulk geocoding: each step answers (request_id, step, lat, lng, confidence, note); the lowest step wins; unknown stays null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sirenflow.functions.fuzzy import token_set_ratio
from sirenflow.functions.text import lookup_address
from sirenflow.operators.chains import points_at
from sirenflow.operators.lineage import saved

STEPS = ("exact", "intersection", "block", "cross", "nearest civic", "street centroid", "road centroid")
ANSWER = ("request_id", "step", "lat", "lng", "confidence", "note")
FUZZY_MIN = 80


def _answer(df: DataFrame, step: str, confidence, note=None) -> DataFrame:
    c = confidence if hasattr(confidence, "cast") else F.lit(confidence)
    return df.select("request_id", F.lit(STEPS.index(step)).alias("step"), "lat", "lng", c.cast("int").alias("confidence"), (note if note is not None else F.lit(None)).cast("string").alias("note"))


def _point(kind: str):
    return F.coalesce(f"front_{kind}", f"entrance_{kind}", kind)


def exact_parcel(requests: DataFrame, parcels: DataFrame) -> DataFrame:
    """JN-01: same house number and the best street; equal names first, then token-set score of 80 or more, then lowest parcel id.

    Requests: request_id, house, street. Parcels: parcel_id, house, street, lat, lng, front_*, entrance_*. Of parcels with
    one house number and street the lowest id alone can win, and each different address asked for is looked up once. Only
    distinct (request street, parcel street) pairs that share a house number and are not equal are scored.
    """
    p = parcels.select("house", F.upper("street").alias("p_street"), F.struct("parcel_id", _point("lat").alias("lat"), _point("lng").alias("lng")).alias("p"))
    p = saved(p.where("house is not null and p_street is not null").groupBy("house", "p_street").agg(F.min("p").alias("p")).select("house", "p_street", "p.*"))
    every = requests.select("request_id", "house", F.upper("street").alias("r_street"))
    r = saved(every.select("house", "r_street").where("house is not null and r_street is not null").distinct())
    asked = ["house", "r_street"]
    same = r.join(p.withColumnRenamed("p_street", "r_street"), asked).select(*asked, "parcel_id", "lat", "lng", F.lit(100).alias("score"))
    rest = r.join(same.select(*asked), asked, "left_anti")
    pairs = rest.join(p.select("house", "p_street").distinct(), "house").select("r_street", "p_street").distinct()
    scored = pairs.withColumn("score", token_set_ratio("r_street", "p_street")).where(F.col("score") >= FUZZY_MIN)
    fuzzy = rest.join(scored, "r_street").join(p, ["house", "p_street"]).select(*asked, "parcel_id", "lat", "lng", "score")
    best = same.unionByName(fuzzy).groupBy(*asked).agg(F.min(F.struct((-F.col("score")).alias("s"), "parcel_id", "lat", "lng")).alias("b"))
    best = every.join(best, asked)  # requests with one id: the best of theirs
    best = best.groupBy("request_id").agg(F.min("b").alias("b"))
    return _answer(best.select("request_id", F.col("b.lat").alias("lat"), F.col("b.lng").alias("lng"), (-F.col("b.s")).alias("score")), "exact", F.col("score"))


def block_range(requests: DataFrame, roads: DataFrame) -> DataFrame:
    """JN-02 with LIN-02: the house number's place in a road's left or right range, either direction.

    Roads: road_id, fullname, roadname, left_begin, left_end, right_begin, right_end, and lines (array of parts, each an
    array of lng, lat) or the ends of a straight road as x1, y1, x2, y2. The left side is preferred, then the lowest
    road id. Equal ends put the point in the middle. Each different number and name asked for is looked up once.
    """
    every = requests.select("request_id", F.expr("try_cast(house as int)").alias("n"), F.upper("street").alias("name"), F.upper(F.concat_ws(" ", "street", "street_type")).alias("full"))
    asked = ["n", "name", "full"]
    r = saved(every.where("n is not null").select(*asked).distinct().withColumn("__k", F.monotonically_increasing_id()))
    by_full = r.join(roads.withColumn("full", F.upper("fullname")), "full").drop("name", "full")
    by_name = r.join(roads.withColumn("name", F.upper("roadname")), "name").drop("name", "full")
    both, hits = by_full.unionByName(by_name), None
    shape = F.lit(0) if "lines" in roads.columns else F.struct("x1", "y1", "x2", "y2")
    for rank, side in enumerate(("left", "right")):
        a, b = F.col(f"{side}_begin"), F.col(f"{side}_end")
        f = F.when(a == b, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("n") - a) / (b - a))))
        one = both.where(F.col("n").between(F.least(a, b), F.greatest(a, b))).select("__k", F.struct(F.lit(rank).alias("side"), "road_id", f.alias("f"), shape.alias("shape")).alias("b"))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy("__k").agg(F.min_by("b", F.struct("b.side", "b.road_id")).alias("b"))
    same = (F.col("e.n") == F.col("k.n")) & F.col("e.name").eqNullSafe(F.col("k.name")) & F.col("e.full").eqNullSafe(F.col("k.full"))
    best = every.alias("e").join(best.join(r, "__k").alias("k"), same).groupBy("e.request_id").agg(F.min_by("k.b", F.struct("k.b.side", "k.b.road_id")).alias("b"))
    if "lines" in roads.columns:
        at = points_at(best.select("request_id", "b.road_id", "b.f"), roads)
    else:
        best = best.select("request_id", F.col("b.f").alias("f"), F.col("b.shape").alias("s"))
        on = lambda k: F.col(f"s.{k}1") + F.col("f") * (F.col(f"s.{k}2") - F.col(f"s.{k}1"))
        at = best.select("request_id", on("y").alias("lat"), on("x").alias("lng"))
    return _answer(at, "block", 70)


def nearest_civic(requests: DataFrame, parcels: DataFrame) -> DataFrame:
    """JN-04: the parcel without unit (null or blank) whose number on the street is closest, then lowest; confidence 70, 60 or 55 by distance.

    A request without a street type (null or blank) takes parcels of any type. Requests and parcels of a street are sorted
    by number together, and each number asked for looks at the next one below and above it, so a street's requests never
    meet all its parcels.
    """
    digits = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("int"))
    p = parcels.where("(unit is null or trim(unit) = '') and lat is not null and lng is not null").select(digits("house").alias("n"), F.upper("street").alias("name"), F.upper(F.coalesce("street_type", F.lit(""))).alias("kind"), F.struct("parcel_id", "lat", "lng").alias("p")).where("n is not null")
    p = p.select("n", "name", F.explode(F.array_distinct(F.array("kind", F.lit("")))).alias("kind"), "p").groupBy("name", "kind", "n").agg(F.min("p").alias("p"))
    r = requests.select("request_id", digits("house").alias("n"), F.upper("street").alias("name"), F.upper(F.trim(F.coalesce("street_type", F.lit("")))).alias("kind")).where("n is not null and name is not null")
    # one row a number asked for: a street's group is bounded by its different numbers, however often they are asked
    asked = r.select("name", "kind", "n").distinct()
    both = asked.withColumn("p", F.lit(None).cast(p.schema["p"].dataType)).unionByName(p)
    near = F.when(F.col("p").isNotNull(), F.struct("n", "p"))
    seen = lambda order: F.last(near, ignorenulls=True).over(Window.partitionBy("name", "kind").orderBy(order, F.col("p").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    m = both.withColumns({"below": seen(F.asc("n")), "above": seen(F.desc("n"))}).where("p is null").drop("p")
    m = r.join(m, ["name", "kind", "n"])
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("n") - F.col(f"{c}.n")).alias("gap"), F.col(f"{c}.n").alias("p_n"), F.col(f"{c}.p.parcel_id").alias("parcel_id"), F.col(f"{c}.p.lat").alias("lat"), F.col(f"{c}.p.lng").alias("lng")))
    best = m.select("request_id", F.least(side("below"), side("above")).alias("b")).where("b is not null")
    g = F.col("b.gap")
    note = F.concat(F.lit("nearest civic number "), F.col("b.p_n").cast("string"))
    return _answer(best.select("request_id", F.col("b.lat").alias("lat"), F.col("b.lng").alias("lng"), F.when(g <= 20, 70).when(g <= 100, 60).otherwise(55).alias("c"), note.alias("why")), "nearest civic", F.col("c"), F.col("why"))


def street_centroid(requests: DataFrame, parcels: DataFrame) -> DataFrame:
    """AGG-05: mean place of the parcels on the street and type, of all types for a request without one; confidence 50."""
    kind = F.upper(F.trim(F.coalesce("street_type", F.lit(""))))
    p = parcels.where("lat is not null and lng is not null").select(F.upper("street").alias("name"), kind.alias("kind"), "lat", "lng").groupBy("name", "kind").agg(F.sum("lat").alias("la"), F.sum("lng").alias("lo"), F.count("*").alias("k"))
    mean = p.select("name", F.explode(F.array_distinct(F.array("kind", F.lit("")))).alias("kind"), "la", "lo", "k").groupBy("name", "kind").agg((F.sum("la") / F.sum("k")).alias("lat"), (F.sum("lo") / F.sum("k")).alias("lng"))
    r = requests.select("request_id", F.upper("street").alias("name"), kind.alias("kind"))
    return _answer(r.join(mean, ["name", "kind"]), "street centroid", 50)


def road_centroid(requests: DataFrame, roads: DataFrame) -> DataFrame:
    """AGG-06: length-weighted middle of the street's roads, confidence 45."""
    length = F.sqrt(F.pow((F.col("x2") - F.col("x1")) * F.cos(F.radians("y1")), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    w = roads.withColumn("len", length).groupBy(F.upper("roadname").alias("name")).agg((F.sum((F.col("y1") + F.col("y2")) / 2 * F.col("len")) / F.sum("len")).alias("lat"), (F.sum((F.col("x1") + F.col("x2")) / 2 * F.col("len")) / F.sum("len")).alias("lng"))
    return _answer(requests.select("request_id", F.upper("street").alias("name")).join(w, "name").where("lat is not null"), "road centroid", 45)


def with_raw_keys(intersections: DataFrame, raw: str = "raw_key") -> DataFrame:
    """JN-05: the index of intersections: each row under its normal key and, where it differs, under its raw key too."""
    keys = F.array_distinct(F.array_compact(F.array("key", F.upper(F.trim(raw)))))
    return intersections.select(F.explode(keys).alias("key"), *[c for c in intersections.columns if c not in ("key", raw)]).distinct()


def intersection_lookup(requests: DataFrame, intersections: DataFrame) -> DataFrame:
    """JN-05, JN-07, JN-09: candidates by key, narrowed by map grid, decided.

    Requests: request_id, key, map_grid, and match_score where the key is a suggestion. Intersections: key,
    candidate_index, lat, lng, zone_id. One row per request with a candidate: candidates, grid_conflict (a grid was given and
    no candidate is in it), resolved (an exact key, one candidate, no conflict), the lowest candidate's place, its
    match_score (100 for an exact key) and a note.
    """
    score = F.col("match_score") if "match_score" in requests.columns else F.lit(None)
    # a request meets the zones of its candidates, not each candidate
    zones = intersections.groupBy("key", "zone_id").agg(F.count("*").alias("n"), F.min(F.struct("candidate_index", "lat", "lng")).alias("first"))
    m = requests.withColumn("score", score.cast("int")).join(zones, "key")
    w = Window.partitionBy("request_id")
    m = m.withColumn("fits", F.coalesce(F.col("zone_id") == F.col("map_grid"), F.lit(False)))
    m = m.withColumn("any_fits", F.max("fits").over(w)).where("fits or not any_fits")
    best = m.groupBy("request_id").agg(F.sum("n").alias("candidates"), F.max(F.col("map_grid").isNotNull() & ~F.col("any_fits")).alias("grid_conflict"), F.max("score").alias("score"), F.min("first").alias("b"))
    exact = F.col("score").isNull()
    note = F.when(~exact, "suggested street names").when(F.col("grid_conflict"), "no junction of these streets in the map grid").when(F.col("candidates") > 1, F.concat(F.col("candidates").cast("string"), F.lit(" junctions of these streets")))
    return best.select("request_id", "candidates", "grid_conflict", (exact & (F.col("candidates") == 1) & ~F.col("grid_conflict")).alias("resolved"), F.col("b.lat").alias("lat"), F.col("b.lng").alias("lng"), F.coalesce("score", F.lit(100)).alias("match_score"), note.alias("note"))


def intersection_step(found: DataFrame) -> DataFrame:
    """The cascade's intersection step from ``intersection_lookup``: resolved requests answer with confidence 100, ambiguous ones with their score and note."""
    return _answer(found.withColumn("why", F.col("note")), "intersection", F.when(F.col("resolved"), 100).otherwise(F.col("match_score")), F.col("why"))


def cascade(requests: DataFrame, *steps: DataFrame) -> DataFrame:
    """WIN-03: the answer of the lowest step per request; a request that no step answers keeps nulls."""
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    best = every.where("lat is not null and lng is not null").groupBy("request_id").agg(F.min(F.struct("step", "lat", "lng", "confidence", "note")).alias("b"))
    return requests.select("request_id").join(best, "request_id", "left").select("request_id", "b.*")


def parcel_lookup(queries: DataFrame, parcels: DataFrame) -> DataFrame:
    """JN-11: (query, parcel_id, match): equality of the cleaned, raw or normal address or the id, in that order, then an address that
    contains the cleaned query; lowest id.

    Only queries without an equal parcel go to the last step; there a query meets the addresses that hold its
    rarest three-letter piece, its rarest by the number of addresses. Parcels of one address count as their lowest id.
    """
    lots = parcels.groupBy("address").agg(F.min("parcel_id").alias("parcel_id"))
    p = saved(lots.select("parcel_id", F.upper("address").alias("raw"), lookup_address(F.col("address")).alias("clean"), F.lower("address").alias("normal")))
    q = queries.select("query").distinct().select("query", F.upper("query").alias("raw"), lookup_address(F.col("query")).alias("clean"), F.lower("query").alias("normal"), F.col("query").alias("gis_id"))
    q = saved(q)
    hits = None
    for rank, col in enumerate(("clean", "raw", "normal", "gis_id")):
        one = q.select("query", col).where(F.col(col) != "").join((parcels if col == "gis_id" else p).groupBy(col).agg(F.min("parcel_id").alias("parcel_id")), col).select("query", F.lit(rank).alias("rank"), F.lit(col).alias("match"), "parcel_id")
        hits = one if hits is None else hits.unionByName(one)
    best = saved(hits.groupBy("query").agg(F.min(F.struct("rank", "parcel_id", "match")).alias("b")))
    pieces_of = lambda c, sizes: F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, k)))))
    held = p.where("raw is not null").select("parcel_id", "raw", F.explode(pieces_of("raw", F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("g"))
    rest = q.join(best, "query", "left_anti").where("clean != ''").select("query", F.upper("clean").alias("part"))
    pieces = rest.select("query", "part", F.explode(pieces_of("part", F.array(F.least(F.length("part"), F.lit(3))))).alias("g")).join(held.groupBy("g").agg(F.count("*").alias("n")), "g", "left")
    rare = pieces.groupBy("query", "part").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    found = rare.join(held, "g").where(F.contains("raw", "part")).groupBy("query").agg(F.min("parcel_id").alias("parcel_id")).select("query", "parcel_id", F.lit("contains").alias("match"))
    got = best.select("query", "b.parcel_id", "b.match").unionByName(found)
    return queries.select("query").join(got, "query", "left")
