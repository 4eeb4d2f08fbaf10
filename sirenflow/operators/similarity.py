"""Similarity join of names (FN-07): an exact candidate search on the rarest character pairs, and the ratio as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenflow.operators.lineage import saved

#: Characters of one name that a long has bits for; longer names take several longs.
_BITS = 62


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: an expression inside a lambda would be computed anew for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings; null if one is null.

    A bit stands for each character of ``a``, in blocks of 62; a character of ``b`` clears the bits that it matches by an
    addition whose carry runs from block to block. The cleared bits are the length.
    """
    long = lambda x: F.lit(x).cast("long")
    shift = lambda x, n: F.call_function("shiftleft", x, n)

    def masks(chars: Column, ch: Column, size: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), size - 1), long(0), lambda m, i: m.bitwiseOR(F.when(F.get(chars, i) == ch, shift(long(1), i)).otherwise(long(0))))

    def over(pair: Column) -> Column:
        blocks, other = pair["blocks"], pair["b"]
        start = F.transform(blocks, lambda c: shift(long(1), F.size(c)) - 1)

        def block(acc: Column, k: Column, v: Column, ch: Column) -> Column:
            now = F.struct(F.get(v, k).alias("v"), F.get(blocks, k).alias("c"))

            def add(x: Column) -> Column:
                n = F.size(x["c"])
                u = x["v"].bitwiseAND(masks(x["c"], ch, n))
                return _bound(F.struct((x["v"] + u + acc["carry"]).alias("sum"), (x["v"] - u).alias("rest"), n.alias("n")), lambda y: F.struct(
                    F.call_function("shiftrightunsigned", y["sum"], y["n"]).alias("carry"),
                    F.concat(acc["v"], F.array(y["sum"].bitwiseOR(y["rest"]).bitwiseAND(shift(long(1), y["n"]) - 1))).alias("v"),
                ))

            return _bound(now, add)

        def step(v: Column, ch: Column) -> Column:
            none = F.struct(long(0).alias("carry"), F.array().cast("array<bigint>").alias("v"))
            return F.aggregate(F.sequence(F.lit(0), F.size(blocks) - 1), none, lambda acc, k: block(acc, k, v, ch))["v"]

        left = F.aggregate(other, start, step)
        return F.aggregate(blocks, F.lit(0), lambda n, c: n + F.size(c)) - F.aggregate(left, F.lit(0), lambda n, v: n + F.bit_count(v).cast("int"))

    def short(pair: Column) -> Column:
        chars, n = F.get(pair["blocks"], 0), F.size(F.get(pair["blocks"], 0))
        full = shift(long(1), n) - 1
        step = lambda v, ch: _bound(v.bitwiseAND(masks(chars, ch, n)), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(full))
        return n - F.bit_count(F.aggregate(pair["b"], full, step)).cast("int")

    n = F.length(a)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BITS).cast("int")), lambda k: F.split(F.substr(a, k * _BITS + 1, F.lit(_BITS)), ""))
    pair = F.struct(blocks.alias("blocks"), F.split(b, "").alias("b"))
    none = (n == 0) | (F.length(b) == 0)
    return F.when(none, 0).when(n.isNull() | F.length(b).isNull(), F.lit(None).cast("int")).when(n <= _BITS, _bound(pair, short)).otherwise(_bound(pair, over))


def ratio(a: Column, b: Column) -> Column:
    """FN-07, 0 to 100: twice the common subsequence over both lengths, rounded half to even; 100 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100).otherwise(F.bround(common_length(a, b) * 200 / total).cast("int"))


def _grams(name: str) -> Column:
    """Pairs of neighbouring characters, a mark before the first, each with its number among equal ones: as many as characters."""
    padded = F.concat(F.lit("\0"), F.col(name))
    pairs = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(padded, i, F.lit(2)))
    return _bound(pairs, lambda ps: F.transform(ps, lambda g, i: F.concat(g, F.size(F.filter(F.slice(ps, 1, i + 1), lambda x: x == g)).cast("string"))))


def near_names(wanted: DataFrame, known: DataFrame, floor: int, left: str = "street", right: str = "known") -> DataFrame:
    """(left, right, score) of all pairs of names whose ratio is ``floor`` (over 67) or more, each pair once.

    With n and m characters and a common subsequence of L, two names share 3 L - n - m of their character pairs at least: each
    character that only one of them has breaks one pair of the common part. At the floor that is a fixed share of n + m, so
    if the pairs of all names are ordered from rare to common, two such names share one among the first n - t + 1 and
    m - t + 1 of theirs. Only names that do meet; lengths are compared before the ratio. Null and empty names match nothing.
    """
    if floor < 68:
        raise ValueError("the search is exact for floors above 67 only")
    low = (floor - 0.5) / 100
    share = 1.5 * low - 1
    w, k = wanted.select(F.col(left).alias("name")), known.select(F.col(right).alias("name"))
    names = w.withColumn("side", F.lit(1)).unionByName(k.withColumn("side", F.lit(2))).where("name != ''").groupBy("name").agg(F.bit_or("side").alias("side"))
    grams = saved(names.select("name", "side", F.explode(_grams("name")).alias("g")))
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    # the shortest partner that the floor allows has low / (2 - low) of the length
    least = F.greatest(F.lit(1), F.ceil(share * 2 / (2 - low) * F.length("name") - 1e-9))
    order = grams.join(often, "g").groupBy("name", "side").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("gs"))
    some = F.slice("gs", F.lit(1), (F.length("name") - least + 1).cast("int"))
    first = saved(order.select("name", "side", F.explode(F.transform(some, lambda x: x["g"])).alias("g")))
    a = first.where("side & 1 > 0").select(F.col("name").alias(left), "g")
    b = first.where("side & 2 > 0").select(F.col("name").alias(right), "g")
    n, m = F.length(left), F.length(right)
    near = F.least(n, m) * 2 >= low * (n + m) - 1e-9
    pairs = a.join(b, "g").where(near).select(left, right).distinct()
    # behind a generator, so that the filter does not compute the ratio once more
    return pairs.select(left, right, F.explode(F.array(ratio(F.col(left), F.col(right)))).alias("score")).where(F.col("score") >= math.ceil(floor))
