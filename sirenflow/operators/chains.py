"""Lines of several parts joined where exactly two ends meet (LIN-02): list ranking by pointer doubling over DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenflow.functions.lines import point_at
from sirenflow.operators.lineage import cut, saved

_ID = ["road_id", "part", "o"]


def _length(points: Column) -> Column:
    """Length in the plane of the coordinates."""
    step = lambda i: F.hypot(F.get(points, i + 1)["lng"] - F.get(points, i)["lng"], F.get(points, i + 1)["lat"] - F.get(points, i)["lat"])
    return F.aggregate(F.sequence(F.lit(0), F.size(points) - 2), F.lit(0.0), lambda s, i: s + step(i))


def _ranked(links: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """``links`` (road_id, part, o, next or null, ahead: length of the next) with to: the last that is reached, hops, ahead: the
    length of all after it, low, the lowest part on the way, and ring, whether it goes round for ever; and whether any does."""
    me = F.struct("part", "o")
    s = links.select(*_ID, F.coalesce("next", me).alias("to"), F.col("next").isNotNull().cast("long").alias("hops"), F.coalesce("ahead", F.lit(0.0)).alias("ahead"), F.least("part", F.coalesce("next.part", "part")).alias("low"))
    s = cut(s)
    for _ in range(rounds):
        t = s.select("road_id", F.struct("part", "o").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("ahead").alias("ahead2"), F.col("low").alias("low2"))
        s = s.join(t, ["road_id", "to"]).select(*_ID, F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("ahead") + F.col("ahead2")).alias("ahead"), F.least("low", "low2").alias("low"), (F.col("to") != F.col("to2")).alias("moved"))
        s = cut(s)
        if s.where("moved").isEmpty():
            break
    ends = links.where("next is null").select("road_id", me.alias("to"), F.lit(True).alias("ends"))
    s = cut(s.join(ends, ["road_id", "to"], "left").withColumn("ring", F.col("ends").isNull()).drop("ends"))
    return s, not s.where("ring").isEmpty()


def chained(roads: DataFrame) -> DataFrame:
    """(road_id, chain, seq, part, forward, len, before, total) for each part of ``roads`` (road_id, lines: array of parts, each an array
    of lng, lat): the parts in the order in which they make up lines.

    Two parts are joined at a place where exactly two ends of the road's parts meet. A line runs from its end with the
    lower part number (its own direction if it is one part); a ring begins with its lowest part. ``chain`` is the number of
    the first part; ``before`` is the length ahead of a part and ``total`` that of its line, in degrees. Parts of
    less than two points are left out; numbers are the places in ``lines``. Null roads or lines give nothing.
    """
    p = roads.where("road_id is not null").select("road_id", F.posexplode("lines").alias("part", "p")).where("size(p) > 1")
    p = saved(p.select("road_id", "part", F.get("p", F.lit(0)).alias("head"), F.element_at("p", -1).alias("tail"), _length(F.col("p")).alias("len")))
    most = p.groupBy("road_id").count().agg(F.max("count")).first()[0] or 1
    rounds = math.ceil(math.log2(most)) + 1
    turn = lambda o, enter, leave: p.select("road_id", "part", F.lit(o).alias("o"), F.col(enter).alias("enter"), F.col(leave).alias("leave"), "len")
    half = turn(0, "head", "tail").unionByName(turn(1, "tail", "head"))
    ends = p.select("road_id", "part", F.explode(F.array("head", "tail")).alias("node")).groupBy("road_id", "node").agg(F.count("*").alias("n"), F.min("part").alias("a"), F.max("part").alias("b")).where("n = 2 and a != b")
    out = half.join(ends.select("road_id", F.col("node").alias("leave"), "a", "b"), ["road_id", "leave"]).select(*_ID, "leave", F.when(F.col("part") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    into = half.select("road_id", F.col("part").alias("other"), F.col("enter").alias("leave"), F.col("o").alias("o2"), F.col("len").alias("ahead"))
    follow = out.join(into, ["road_id", "other", "leave"]).select(*_ID, F.struct(F.col("other").alias("part"), F.col("o2").alias("o")).alias("next"), "ahead")
    links = saved(half.select(*_ID, "len").join(follow, _ID, "left"))
    s, rings = _ranked(links, rounds)
    if rings:
        # rings are cut in front of their lowest part, in both directions
        low = s.where("ring").select(*_ID, F.col("low").alias("c"))
        l = links.join(low, _ID, "left")
        gone = F.coalesce(((F.col("next.part") == F.col("c")) & (F.col("next.o") == 0)) | ((F.col("part") == F.col("c")) & (F.col("o") == 1)), F.lit(False))
        links = saved(l.withColumns({"next": F.when(~gone, F.col("next")), "ahead": F.when(~gone, F.col("ahead"))}).drop("c"))
        s, _ = _ranked(links, rounds)
    back = s.select("road_id", "part", (1 - F.col("o")).alias("o"), F.col("to.part").alias("fp"), (1 - F.col("to.o")).alias("fo"))
    h = s.join(back, _ID).join(links.select(*_ID, "len"), _ID)
    # of the two directions the one whose first part is lower
    h = h.where(F.struct(F.col("fp").alias("a"), F.col("fo").alias("b")) < F.struct(F.col("to.part").alias("a"), (1 - F.col("to.o")).alias("b")))
    whole = h.groupBy("road_id", F.col("fp").alias("chain")).agg(F.sum("len").alias("total"), F.max("hops").alias("last"))
    h = h.withColumnRenamed("fp", "chain").join(whole, ["road_id", "chain"])
    return h.select("road_id", "chain", (F.col("last") - F.col("hops")).alias("seq"), "part", (F.col("o") == 0).alias("forward"), "len", (F.col("total") - F.col("ahead") - F.col("len")).alias("before"), "total")


def points_at(asked: DataFrame, roads: DataFrame) -> DataFrame:
    """LIN-02: (request_id, lat, lng) at a fraction f (cut to 0..1) of the length of the longest line of each asked road (request_id, road_id, f).

    Of lines of one length the one with the lowest first part counts. Only the part that holds the place is looked into.
    """
    some = roads.join(asked.select("road_id").distinct(), "road_id", "left_semi").select("road_id", "lines")
    c = saved(chained(some))
    best = c.groupBy("road_id").agg(F.max(F.struct("total", (-F.col("chain")).alias("c"))).alias("b")).select("road_id", (-F.col("b.c")).alias("chain"))
    own = asked.where("f is not null").join(c.join(best, ["road_id", "chain"]), "road_id")
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f"))) * F.col("total")
    gap = F.greatest(F.lit(0.0), F.col("before") - at, at - F.col("before") - F.col("len"))
    part = own.groupBy("request_id", "road_id").agg(F.min(F.struct(F.round(gap, 12).alias("gap"), "seq", "part", "forward", F.when(F.col("len") > 0, (at - F.col("before")) / F.col("len")).otherwise(0.0).alias("t"))).alias("b"))
    shapes = some.select("road_id", F.posexplode("lines").alias("part", "p"))
    part = part.select("request_id", "road_id", "b.part", "b.forward", "b.t").join(shapes, ["road_id", "part"])
    place = point_at(F.array(F.when(F.col("forward"), F.col("p")).otherwise(F.reverse("p"))), F.col("t"))
    return part.select("request_id", place.alias("q")).select("request_id", "q.lat", "q.lng")
