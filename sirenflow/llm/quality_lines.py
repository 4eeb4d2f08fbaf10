"""Quality rules: per-text counts, and the frequency of lines across the documents of a host."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import GAP, ascii_lower, saved

SYMBOLS = "#*$%&|<>"  # fixed values
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is boilerplate of its host if it stands in more different texts than both of these allow.
MAX_DOCS, MAX_PERCENT = 10, 2
#: A document is depleted if less than this percentage of its words is left.
MIN_LEFT_PERCENT = 50

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; null has none."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(b"".join(words).decode()) if n else 0
    symbols = sum(map((text or "").count, SYMBOLS))
    lines = Counter(x for x in raw.split(b"\n") if x.split())
    repeated = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        v = len(ids) + 1
        pair = np.unique(w[:-1] * v + w[1:], return_inverse=True)[1]
        window = pair[:-1] * v + w[2:]
        _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
        hit = np.zeros(n, bool)
        twice = count[inverse] > 1
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        repeated = int(hit.sum())
    return n, chars, symbols, sum(lines.values()) - len(lines), repeated


def _counts(texts):
    return pd.DataFrame([base_counts(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def host_lines(docs: DataFrame) -> DataFrame:
    """(id, tk, host, pos, line, n): the normalised lines with a word of each text, hashed, with their places and words."""
    rows = docs.select("id", "tk", "host", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    rows = rows.select("id", "tk", "host", "pos", F.trim(F.regexp_replace(ascii_lower(F.col("raw")), GAP, " ")).alias("norm")).where("norm != ''")
    return rows.select("id", "tk", "host", "pos", F.xxhash64("norm").alias("line"), F.size(F.split("norm", " ")).alias("n"))


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, max_percent: int = MAX_PERCENT, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, n_left (words outside boilerplate lines), kept.

    Lines are normalised (A-Z lower-cased, white space squeezed) and hashed. A line above the limits is one
    that stands in more than ``max_docs`` different texts of a host and in more than ``max_percent`` percent of
    the host's different texts. Copies of a text are one document here. A document whose base rules fail, or
    that keeps less than ``min_left_percent`` percent of its words without such lines, is not kept. Null or empty
    text: counts of 0, base_failed. A null host is a host of its own; null ids and repeated rows get rows of
    their own. Extra columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tk"), F.col(host).alias("host"), F.col(text).alias("text"))
    src = src.withColumn("host", F.when(F.col("host").isNull(), F.lit("n")).otherwise(F.concat(F.lit("h"), "host")))
    lines = host_lines(src)
    per_host = src.select("host", "tk").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    spread = lines.select("host", "line", "tk").distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    over = saved(spread.join(per_host, "host").where(F.col("docs") * 100 > F.col("host_docs") * max_percent).select("host", "line"))
    hits = lines.join(over, ["host", "line"]).groupBy("id", "tk", "host").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    lost = hits.select("id", "tk", "host", F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("lost"))
    counts = F.pandas_udf(_counts, _BASE)
    base = src.select("id", "tk", "host", counts("text").alias("b")).select("id", "tk", "host", "b.*")
    out = base.join(lost, base.id.eqNullSafe(lost.id) & base.tk.eqNullSafe(lost.tk) & (base.host == lost.host), "left").select(base["*"], lost["lost"])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias(id_col), *cols, failed.alias("base_failed"), left.alias("n_left"), (~failed & (left * 100 >= F.col("n_words") * min_left_percent)).alias("kept"))
