"""Mixing sources to target weights: DataFrame functions only.

Every document gets a hash-random key. Within a source the documents are dealt into key ranges (the key is
uniform, so equal ranges hold equal shares, however hot the source) of at most about ``rows_per_range`` rows, and of
fewer where the table is so small that its ranges would not occupy all tasks; they are sorted inside each range, and the ranges' totals are prefix-summed, which gives each document its exact position
in the source's random order. A source whose target exceeds its size repeats whole epochs; the rest of
the target is cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenflow.llm.common import WORD, cut, saved

MAX_EPOCHS = 3
#: Rows of a key range, at most and at least.
ROWS_PER_RANGE, LEAST_ROWS = 20_000, 200


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` with target: the word budget of each source.

    ``sizes`` has one row a source, with source and source_size. Sources in code-point order, null last, weigh
    ``weights``, repeated, and share the sum of all sizes; a target stops at ``max_epochs`` times its source's
    size and the excess is reshared by weight. Ordered by (cap / weight), the capped sources are a prefix, so
    one running sum finds the level. The table has a row a source, never a row a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns({
        "left_words": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_need), F.lit(0)),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_need), F.lit(0)),
    })
    s = s.withColumn("full", F.col("cap") * F.col("left_weight") <= F.col("left_words") * F.col("weight"))
    # the first source that is not full sets the level for all that follow
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), "left_words", "left_weight"))).over(every)
    s = s.withColumn("level", first)
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("level.left_words").cast("double") * F.col("weight") / F.col("level.left_weight"))
    return s.select(*sizes.columns, target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE, seed: str = "mix") -> DataFrame:
    """One row per document: id, size (words), source_size, target (its source's), taken (words taken, repeats counted), source.

    ``taken`` is ``size`` times the whole epochs, plus what the last, partial epoch takes: everything before
    the budget's cut in key order, and the part of one document that reaches it. So a source's ``taken`` sums
    to its target rounded down. Null text has size 0; null sources are one source, null ids one key. Ties in
    the key fall back on size, so reruns agree. Empty input gives an empty result; extra columns are not read.
    """
    src = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    d = cut(docs.select(F.col(id_col).alias("id"), src.alias("src"), words_in(text).alias("size"), key.alias("key")))
    sizes = d.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    plan = source_targets(sizes.withColumn("source", F.when(~F.col("src.none"), F.col("src.name"))), weights, max_epochs)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.least(F.lit(rows_per_range), F.greatest(F.lit(LEAST_ROWS), F.sum("n").over(Window.partitionBy()) / (2 * tasks)))  # a row a source
    plan = saved(plan.select("src", F.ceil(F.col("n") / each).alias("ranges"), "source_size", "target"))
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    d = d.join(plan, "src").withColumn("range", F.floor(head * F.col("ranges") / F.lit(1 << 32)).cast("long"))
    totals = d.groupBy("src", "range").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("src", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("src", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(within)).join(starts, ["src", "range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - (F.col("start") + F.col("upto") - F.col("size")), F.lit(0)), F.col("size"))
    return d.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(~F.col("src.none"), F.col("src.name")).alias("source"))
