"""JSON files of any size as rows of their objects: Spark cuts a file into byte ranges, the state of the parse is carried from range to range.

The text source splits at closing braces, so a piece is what lies between two of them and ranges need no line breaks. Whether a
piece begins inside a string, and how deep, is known once the ranges ahead are summed up: a first pass gives a row a range for
either answer (one row for each 128 MB goes to the driver), a second one joins pieces to objects. Objects that lie in several
ranges are put together by a shuffle of those alone.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sirenflow.operators.lineage import saved

_SPLIT = "spark.sql.files.maxPartitionBytes"
_PART = "file string, block long, n long, member string, text string, begun boolean, ended boolean"
_TOKEN = re.compile(r'\\.|["{]', re.S)
_LEAD = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\[?\s*\Z', re.S)


@contextmanager
def _blocks_of(spark: SparkSession, size: int | None):
    before = spark.conf.get(_SPLIT)
    try:
        if size:
            spark.conf.set(_SPLIT, str(size))
        yield
    finally:
        spark.conf.set(_SPLIT, before)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    p = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    p = p.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))
    outside = F.regexp_replace("plain", r'"[^"]*("|\z)', "")
    return p.select("file", "block", "value", count(F.col("plain"), '"').alias("quotes"), count(F.col("plain"), "{").alias("opens"), count(outside, "{").alias("opens_outside"))


def _runs(b: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    f, k = b["file"].to_numpy(), b["block"].to_numpy()
    at = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (k[1:] != k[:-1])) + 1), len(b)]
    for i, j in zip(at, at[1:], strict=False):
        if j > i:
            yield (f[i], int(k[i])), b.iloc[i:j]


def _walk(rows: pd.DataFrame, inside: int, depth: int):
    """(in a string before each piece, depth before, after its opening braces, after its closing one; whether that one counts)."""
    q = rows["quotes"].to_numpy() & 1
    after = (inside + np.cumsum(q)) & 1
    before = after ^ q
    outside = rows["opens_outside"].to_numpy()
    opens, closes = np.where(before == 0, outside, rows["opens"].to_numpy() - outside), after == 0
    low = depth + np.cumsum(opens - closes)
    return before, low - opens + closes, low + closes, low, closes, int(after[-1])


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, head, either = None, None, []
    rows = lambda: pd.DataFrame({"file": [key[0]], "block": [key[1]], "head": [head], "summary": [json.dumps([[s, d, list(c.items())] for s, d, c in either])]})
    for b in batches:
        for k, run in _runs(b):
            if k != key:
                if key is not None:
                    yield rows()
                key, head, either = k, run["head"].iloc[0], [(0, 0, Counter()), (1, 0, Counter())]
            for s, (inside, depth, ends) in enumerate(either):
                _, _, _, low, closes, last = _walk(run, inside, depth)
                for level, times in zip(*np.unique(low[closes], return_counts=True), strict=True):
                    ends[int(level)] += int(times)
                either[s] = (last, int(low[-1]), ends)
    if key is not None:
        yield rows()


def _states(rows) -> dict[tuple[str, int], tuple[int, int, int, int]]:
    """(in a string, depth, objects ended, depth of the objects' list) where each range begins."""
    out, file = {}, None
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside, depth, n, level = r["file"], 0, 0, 0, 0 if r["head"] == "[" else 1
        out[file, r["block"]] = inside, depth, n, level
        last, delta, ends = json.loads(r["summary"])[inside]
        n += dict(map(tuple, ends)).get(level - depth, 0)
        inside, depth = last, depth + delta
    return out


def _brace(text: str, inside: int, k: int) -> int:
    """Where the k-th opening brace outside strings stands."""
    for m in _TOKEN.finditer(text):
        if m[0] == '"':
            inside ^= 1
        elif m[0] == "{" and not inside:
            k -= 1
            if k == 0:
                return m.start()
    raise ValueError("no such brace")


def _joined(states):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, begun, member = None, [], False, None
        for b in batches:
            out = []
            for k, rows in _runs(b):
                if k != key:
                    if held:
                        out.append((*key, n, member, "".join(held), begun, False))
                    key, held, begun, member = k, [], False, None
                    if k not in states:
                        raise RuntimeError("the ranges of a file differ from those summed up; read again")
                    inside, depth, n, level = states[k]
                before, high, peak, low, closes, inside = _walk(rows, inside, depth)
                for i in np.flatnonzero(peak > level):
                    text = rows["value"].iat[i]
                    if high[i] <= level:
                        at = _brace(text, before[i], level - high[i] + 1)
                        lead = _LEAD.search(text, 0, at)
                        begun, member = True, lead[1] if lead else "" if high[i] < level or (level == 0 and n == 0) else None
                        text = text[at:]
                    held.append(text + "}")
                    if closes[i] and low[i] == level:
                        out.append((*key, n, member, "".join(held), begun, True))
                        held, begun, member, n = [], False, None, n + 1
                depth = int(low[-1])
            yield pd.DataFrame(out, columns=["file", "block", "n", "member", "text", "begun", "ended"])
        if held:
            yield pd.DataFrame([(*key, n, member, "".join(held), begun, False)], columns=["file", "block", "n", "member", "text", "begun", "ended"])

    return run


def json_objects(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """(file, n, member, text): the objects of a file's lists, numbered in order, and the name of the list they stand in.

    Objects are those in a top-level list (member '') or in the lists and members of a top-level object; deeper ones are part of
    their texts. A file without objects gives no row. A file that breaks off inside an object loses that object, unless one brace
    alone is missing, which is then added. ``block_bytes`` makes ranges smaller than the session's. Reads the files twice.
    """
    with _blocks_of(spark, block_bytes):
        p = _pieces(spark, path)
        slim = p.select("file", "block", F.substring(F.ltrim(F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")), 1, 1).alias("head"), "quotes", "opens", "opens_outside")
        states = _states(slim.mapInPandas(_summaries, "file string, block long, head string, summary string").collect())
        parts = saved(p.mapInPandas(_joined(states), _PART))
    whole = parts.where("begun and ended").select("file", "n", "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "")
    cut = parts.where("not (begun and ended)").groupBy("file", "n").agg(text.alias("text"), F.bool_or("begun").alias("b"), F.bool_or("ended").alias("e")).where("b and e").select("file", "n", "text")
    # a list is named once, where it begins: a few rows a file, written so that the planner knows their size
    named = parts.where("member is not null").select("file", F.col("n").alias("since"), "member")
    named = saved(named.withColumn("until", F.lead("since").over(Window.partitionBy("file").orderBy("since"))))
    ahead = (F.col("n") >= F.col("since")) & (F.col("until").isNull() | (F.col("n") < F.col("until")))
    return whole.union(cut).join(named.withColumnRenamed("file", "of"), (F.col("file") == F.col("of")) & ahead).select("file", "n", "member", "text")
