"""Merkle manifest of a table: leaves, a subroot a group, one root, and a proof for every row.

Rows are ranked inside their group by a range sort and counts. The base-8 digits of the rank are then grouped away one after
the other, deepest first: each group becomes a struct that holds its digest and, nested, its children. A block nests three
digits (512 leaves), which bounds a row of nested structs however large a group is; the digests of the blocks are the
next table of nodes, a 512th in size. Inside a block, proofs come out of the nested structs by explode, without a join;
the path above a block is joined once to the block's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sirenflow.llm.common import saved

FAN = 8
#: Rank digits nested in one row.
DIGITS = 3
BLOCK = FAN**DIGITS
_HEX = 64


def digest(c: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, a colon and the value (integers decimal)."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*fields: Column) -> Column:
    return digest(F.concat(*[field(c) for c in fields]))


def siblings(path: Column) -> Column:
    """Digests of the siblings on a path, level by level and left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` plus i (rank from 0 inside the group g, by ``order``, nulls first) and n (rows of the group).

    The rows are range-sorted by group and order (a row number as last key, so equal rows spread too) and written. A row's
    rank is its place in its task plus the group's rows in the tasks before, from a table of a row a task and group that
    meet; no window sees the rows of a group.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g", *[F.col(c).asc_nulls_first() for c in order], "row"]
    placed = nodes.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = saved(placed.drop("row").withColumn("place", F.monotonically_increasing_id()).withColumn("task", F.shiftright("place", 33)))
    parts = placed.groupBy("g", "task").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before, n = F.sum("rows").over(W.partitionBy("g").orderBy("task")), F.sum("rows").over(W.partitionBy("g"))
    parts = saved(parts.select("g", "task", (before - F.col("rows") - F.col("first")).alias("shift"), n.alias("n")))
    return placed.join(parts, ["g", "task"]).withColumn("i", F.col("place") + F.col("shift")).drop("place", "task", "shift")


def _count(level: int) -> Column:
    """Nodes of a group at a level of the present table (level 0: its n)."""
    return F.ceil(F.col("n") / FAN**level)


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(g, b, n, h, run, kids) from nodes (g, i, n, h, payload): one row a block, its nodes nested in ``kids``.

    ``run`` is the digests of the kids in one string. A level at which the group has one node only passes it on.
    """
    digit = [F.shiftright("i", 3 * k).bitwiseAND(FAN - 1).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    at = nodes.select("g", F.shiftright("i", 3 * DIGITS).alias("b"), "n", *digit, "h", *payload).repartition("g", "b")
    inner = ["h", *payload]
    for k in range(DIGITS):
        above = [f"d{x}" for x in range(k + 1, DIGITS)]
        kid = F.struct(F.col(f"d{k}").alias("d"), *inner)
        at = at.groupBy("g", "b", "n", *above).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        at = at.withColumn("run", F.array_join(F.transform("kids", lambda x: x["h"]), ""))
        at = at.withColumn("h", F.when(_count(k) > 1, digest(F.col("run"))).otherwise(F.col("kids")[0]["h"]))
        inner = ["h", "run", "kids"]
    return at.select("g", "b", "n", "h", "run", "kids")


def rolled(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Tables of blocks from the leaves up to one block a group, whose h is the group's root."""
    out = [saved(blocks(nodes, payload))]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        nodes = out[-1].select("g", F.col("b").alias("i"), F.ceil(F.col("n") / BLOCK).alias("n"), "h")
        out.append(saved(blocks(nodes, [])))
    return out


def unrolled(table: DataFrame, payload: list[str], carried: list[str]) -> DataFrame:
    """(g, i, h, path, payload, carried) for each node in a table of blocks that have the ``path`` above them."""
    at = table.withColumn("i", F.col("b"))
    for k in reversed(range(DIGITS)):
        last = k == 0
        at = at.select("g", "n", "i", "path", "run", *carried, F.explode("kids").alias("x"))
        d = F.col("x.d")
        step = F.struct(F.substr("run", F.lit(1), d * _HEX).alias("left"), F.substr("run", (d + 1) * _HEX + 1, F.lit(FAN * _HEX)).alias("right"))
        path = F.when(_count(k) > 1, F.concat(F.array(step), "path")).otherwise(F.col("path"))
        held = [F.col(f"x.{c}").alias(c) for c in (["h", *payload] if last else ["run", "kids"])]
        at = at.select("g", "n", (F.col("i") * FAN + d).alias("i"), path.alias("path"), *carried, *held)
    return at.drop("n")


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), also: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``key``, the columns of ``also``, leaf, subroot, root, path.

    A leaf is the digest of ``fields``. Leaves ascend by key inside their group; while there are several nodes, every eight
    consecutive ones become their digest. The groups' subroots, ordered by group (null first, bytewise), give the root
    likewise. ``path`` has a struct (left, right: digests of the siblings on either side, joined) for each level from the
    leaf to the root; :func:`fold` recomputes the root from it. ``also`` are small columns computed where the row is read.

    Null keys come first, rows of one key are ordered by leaf; equal rows have a leaf each. A null group is a group,
    an empty one another. Null values are ``-``, so they differ from empty ones. An empty table gives no rows. Texts are read
    once and never shuffled; other columns of the input are not read and clash with nothing.
    """
    also = also or {}
    held = {f"p{k}": c for k, c in enumerate([F.col(key), *also.values()])}
    # the order of this column is the order of the groups: null first, then bytewise
    g = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit(""))
    leaves = saved(rows.select(g.alias("g"), leaf_digest(*[F.col(c) for c in fields]).alias("h"), *[c.alias(k) for k, c in held.items()]))
    low = rolled(ranked(leaves, ["p0", "h"]), list(held))
    top = low[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("h"))
    high = rolled(ranked(top, ["of"]), ["of"])
    at = high[-1].select("*", F.col("h").alias("root"), F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    for below in reversed(high[:-1]):
        up = unrolled(at, [], ["root"]).select("g", F.col("i").alias("b"), "root", "path")
        at = below.join(up, ["g", "b"])
    subs = unrolled(at, ["of"], ["root"]).select(F.col("of").alias("g"), F.col("h").alias("subroot"), "root", "path")
    at = low[-1].join(subs, "g")
    for below in reversed(low[:-1]):
        up = unrolled(at, [], ["subroot", "root"]).select("g", F.col("i").alias("b"), "subroot", "root", "path")
        at = below.join(up, ["g", "b"])
    out = unrolled(at, list(held), ["subroot", "root"])
    names = [key, *also]
    return out.select(*[F.col(k).alias(c) for k, c in zip(held, names, strict=True)], F.col("h").alias("leaf"), "subroot", "root", "path")
