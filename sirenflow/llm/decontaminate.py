"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Items are partitioned by their number of shingles (powers of two). A partition's sketch length is one more
than the number of shingles that an item of its largest size may lack at the containment threshold, and an
item's sketch is that many of its smallest shingle hashes. A document with the asked containment lacks fewer
shingles than the sketch holds, so it shares at least one minimum with the item: the search loses nothing,
even for a 15-word item in a 20,000-word document, where banded signatures would. Each candidate is then
verified by exact containment of the item's whole shingle set: by the shingles' hashes, then by the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import cut, saved, text_key

SHINGLE = 5
CONTAINMENT = 0.8
#: The minima and the shingles of a benchmark are broadcast up to this many minima and bytes (measured on the table); above either the joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


#: What separates words: ASCII other than letters and digits, and the blocks of Latin-1, general, CJK and full-width signs.
BREAK = "[\\x00-/:-@\\[-`{-\\u00BF\\u2000-\\u206F\\u3000-\\u303F\\uFF00-\\uFF0F]+"


def normal_words(text: str) -> Column:
    """Words of the lower-cased text without punctuation; null has none."""
    return F.coalesce(F.array_remove(F.split(F.lower(F.col(text)), BREAK), ""), F.array().cast("array<string>"))


def shingle_array(words: str, k: int) -> Column:
    """Hashes of the runs of ``k`` words of an array column; empty if it has fewer."""
    w = F.col(words)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<long>"))


def shingle_texts(words: str, k: int) -> Column:
    """The distinct runs of ``k`` words of an array column, space-joined; empty if it has fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))
    return F.when(F.size(words) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def item_sketches(items: DataFrame, id_col: str = "item_id", text: str = "text", k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """(item, k, need, sh, texts, minima): per item its shingle length, the shingles to be found, all its shingles (hashes, texts) and its sketch."""
    w = items.select(F.col(id_col).alias("item"), normal_words(text).alias("w")).where(F.size("w") > 0)
    sized = w.withColumn("k", F.least(F.size("w"), F.lit(k)))
    sets = F.coalesce(*[F.when(F.col("k") == n, shingle_array("w", n)) for n in range(1, k + 1)])
    texts = F.coalesce(*[F.when(F.col("k") == n, shingle_texts("w", n)) for n in range(1, k + 1)])
    s = sized.select("item", "k", F.array_sort(F.array_distinct(sets)).alias("sh"), texts.alias("texts"))
    n = F.size("sh")
    top = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")
    lacks = F.floor(F.round(top * (1 - containment), 9)).cast("int")
    return s.select("item", "k", F.ceil(F.round(n * containment, 9)).cast("int").alias("need"), "sh", "texts", F.slice("sh", 1, lacks + 1).alias("minima"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, tk, item, n_found, n_shingles): documents that hold at least ``containment`` of an item's distinct ``k``-word shingles.

    ``tk`` is the text's digest; repeated rows (same id, same text) give one row. Items of fewer than ``k`` words
    are one shingle of their whole length; items and documents without a word match nothing. Null ids keep
    their row. Extra columns are not read.
    """
    sk = cut(item_sketches(items, item_id, item_text, k, containment))
    lengths = [r["k"] for r in sk.select("k").distinct().orderBy("k").collect()]  # at most k values
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = rows.select("id", text_key().alias("tk"), normal_words("text").alias("w"))
    bytes_of = F.octet_length(F.col("item").cast("string")) * (F.size("minima") + 1) + 8 * (F.size("minima") + F.size("sh")) + F.aggregate("texts", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    total = sk.agg(F.coalesce(F.sum(F.size("minima")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.coalesce(bytes_of, F.lit(16))), F.lit(0)).alias("b")).first()
    small = total["n"] <= broadcast_rows and total["b"] <= broadcast_bytes
    sized = F.broadcast if small else lambda df: df
    out = None
    for n in lengths:
        own = sk.where(F.col("k") == n).select("item", "need", "sh", "texts", "minima")
        minima = own.select("item", F.explode("minima").alias("low"))
        # explode_outer: for explode, the optimizer would test the set's size below the projection that splits the
        # words, and so split the text once a shingle
        probe = rows.select("id", "tk", "w", F.explode_outer(shingle_array("w", n)).alias("low"))
        if small:  # a single pass: the document's words travel along and are only looked at on a hit
            hit = probe.join(sized(minima), "low").select("id", "tk", "w", "item")
        else:
            pairs = cut(probe.select("id", "tk", "low").join(minima, "low").select("id", "tk", "item").distinct())
            hit = pairs.join(rows.withColumnsRenamed({"id": "i2", "tk": "t2"}), F.col("id").eqNullSafe(F.col("i2")) & F.col("tk").eqNullSafe(F.col("t2"))).select("id", "tk", "w", "item")
        hit = hit.withColumnRenamed("item", "met")
        met = hit.join(sized(own.select("item", "need", "sh", "texts")), F.col("met").eqNullSafe(F.col("item")))
        near = met.where(F.size(F.array_intersect("sh", shingle_array("w", n))) >= F.col("need"))
        found = near.select("id", "tk", "item", F.size(F.array_intersect("texts", shingle_texts("w", n))).alias("n_found"), F.size("texts").alias("n_shingles"), "need")
        found = found.where("n_found >= need").drop("need")
        out = found if out is None else out.union(found)
    if out is None:
        return rows.select("id", "tk", F.lit(None).cast(items.schema[item_id].dataType).alias("item"), F.lit(0).alias("n_found"), F.lit(0).alias("n_shingles")).limit(0)
    return out.groupBy("id", "tk", "item").agg(F.max("n_found").alias("n_found"), F.max("n_shingles").alias("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item (see ``contained``). Null texts and ids stay; all columns stay."""
    bad = saved(contained(docs, items, id_col, text, **how).select("id", "tk").distinct())
    named = docs.withColumns({"__id": F.col(id_col), "__tk": text_key(text)})
    return named.join(bad, named["__id"].eqNullSafe(bad.id) & named["__tk"].eqNullSafe(bad.tk), "left_anti").drop("__id", "__tk")
