"""Substring dedup by hashing lines, and sentences inside lines, over the whole corpus.

Digests are grouped twice: first 64 bits of them alone, to learn which repeat, then whole ones with their places, only
of units that may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import KeyFilter, batches_of, saved, text_key

#: A shorter sentence inside a line repeats by chance; it counts only as part of a run of sentences that has as many words.
MIN_WORDS = 8
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000
_END = re.compile(r"[.!?]+(?=\s)")
_SPAN = "array<struct<start:int,stop:int>>"


def _pieces(line: str) -> Iterator[tuple[int, int]]:
    """Offsets of the sentences of a line: a run of . ! ? that white space follows ends one."""
    start = 0
    for m in _END.finditer(line):
        yield start, m.end()
        start = m.end()
    if start < len(line):
        yield start, len(line)


def _short_runs(sizes: list[int], min_words: int) -> Iterator[tuple[int, int]]:
    """For each sentence below ``min_words`` words: the shortest runs (first, last) from it on, and up to it, with as many words."""
    for k, n in enumerate(sizes):
        if 0 < n < min_words:
            for step in (1, -1):
                total, at = n, k
                while total < min_words and 0 <= at + step < len(sizes):
                    at += step
                    total += sizes[at]
                if total >= min_words:
                    yield min(k, at), max(k, at)


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, stop, digest) of each line with a word, each sentence of a longer line with at least ``min_words`` words, and
    the runs of sentences of a line that reach as many words around each shorter sentence.

    Offsets are code points of the original text. A unit is normalised by case folding and by turning white
    space into single spaces; the digest has 128 bits.
    """
    at = 0
    for line in text.split("\n"):
        words = line.lower().split()
        if words:
            yield at, at + len(line), xxhash.xxh3_128_digest(" ".join(words))
        if len(words) >= min_words:
            pieces = list(_pieces(line))
            parts = [line[s:e].lower().split() for s, e in pieces] if len(pieces) > 1 else []
            for (s, e), part in zip(pieces, parts, strict=False):
                if len(part) >= min_words:
                    yield at + s, at + e, xxhash.xxh3_128_digest(" ".join(part))
            for a, b in sorted(set(_short_runs([len(x) for x in parts], min_words))):
                if (a, b) != (0, len(parts) - 1):
                    yield at + pieces[a][0], at + pieces[b][1], xxhash.xxh3_128_digest(" ".join(" ".join(x) for x in parts[a : b + 1]))
        at += len(line) + 1


def _short(u: bytes) -> int:
    return int.from_bytes(u[:8], "little", signed=True)


def _digests(rows: DataFrame, min_words: int) -> DataFrame:
    """(short): the first 64 bits of each unit of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                yield pd.DataFrame({"short": np.array([_short(u) for x in pdf["text"].iloc[i : i + 500] for _, _, u in units(x, min_words)], np.int64)})

    return rows.select("text").mapInPandas(run, "short long")


def _unit_rows(rows: DataFrame, min_words: int, wanted: KeyFilter) -> DataFrame:
    """(id, tk, start, stop, unit): the occurrences of the units that may be wanted."""
    schema = "id string, tk binary, start int, stop int, unit binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                found = [(j, s, e, u) for j, x in enumerate(part["text"]) for s, e, u in units(x, min_words)]
                ok = wanted.may_hold(np.fromiter((_short(f[3]) for f in found), np.int64, len(found)))
                found = [f for f, o in zip(found, ok.tolist(), strict=True) if o]
                at = np.fromiter((f[0] for f in found), np.int64, len(found))
                out = pd.DataFrame({"start": [f[1] for f in found], "stop": [f[2] for f in found], "unit": [f[3] for f in found]}, columns=["start", "stop", "unit"])
                ids = part[["id", "tk"]].iloc[at].reset_index(drop=True)
                yield pd.concat([ids, out.astype({"start": "int32", "stop": "int32"})], axis=1)

    return rows.select("id", "tk", "text").mapInPandas(run, schema)


def cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a line that is removed whole takes its line break along."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
        if at < len(text) and text[at] == "\n" and (s == 0 or text[s - 1] == "\n"):
            at += 1
    out.append(text[at:])
    return "".join(out)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated units cut out of ``text``, plus ``removed`` (original offsets, code points) and ``removed_chars``.

    Of all occurrences of a unit, the one with the smallest (id, text digest, start) stays and the rest go;
    null ids rank last. Null and empty texts stay as they are. Repeated rows (same id, same text) count as
    one document and get the same result, so a document is never cut because of its own second row. Extra
    columns are kept, whatever their names, except that ``removed`` and ``removed_chars`` are replaced.
    """
    kind = docs.schema[id_col].dataType  # ids travel as text, so that any type of id and null ones come through
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.unhex(text_key(text)).alias("tk"), F.col(text).alias("text")).where("text != ''")
    # a unit that stands but once in all rows is settled here; repeated rows and chance equality of 64 bits are sorted out by rank below
    with batches_of(docs.sparkSession, BATCH_ROWS):
        often = saved(_digests(src, min_words).groupBy("short").count().where("count > 1").select("short"))  # the filter asks it twice
        occ = saved(_unit_rows(src, min_words, KeyFilter(often, "short")))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").cast(kind).alias("id"), "tk", "start")
    first = occ.groupBy("unit").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first != last").select("unit", "first")
    gone = occ.join(first, "unit").where(rank != F.col("first")).groupBy("id", "tk").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    gone = saved(gone)

    keep = [c for c in docs.columns if c not in (text, "removed", "removed_chars")]
    row = docs.select(F.struct(*keep).alias("__row"), F.col(text).alias("__text"), F.col(id_col).cast("string").alias("__id"), F.unhex(text_key(text)).alias("__tk"))
    # rows that lose nothing are passed on where they are read
    key = lambda i, t: F.xxhash64(i, t)
    row = row.withColumn("__in", KeyFilter(gone.select(key(F.col("id"), F.col("tk")).alias("key")), "key").column(key(F.col("__id"), F.col("__tk"))))
    none = {text: F.col("__text"), "removed": F.array().cast(_SPAN), "removed_chars": F.lit(0)}
    cut_ = F.pandas_udf(_rewrite, f"text string, removed {_SPAN}, removed_chars int")
    hit = row.where("__in").join(gone, F.col("__id").eqNullSafe(gone.id) & F.col("__tk").eqNullSafe(gone.tk), "left")
    hit = hit.withColumn("__new", cut_("__text", "spans"))
    new = {text: F.col("__new.text"), "removed": F.col("__new.removed"), "removed_chars": F.col("__new.removed_chars")}

    def shaped(part: DataFrame, new: dict) -> DataFrame:
        own = [c for c in docs.columns if c not in ("removed", "removed_chars")]
        return part.select(*[new[c].alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in own], new["removed"].alias("removed"), new["removed_chars"].alias("removed_chars"))

    # written here: read later, texts would reach Python in batches of the session's size
    with batches_of(docs.sparkSession, BATCH_ROWS):
        changed = saved(hit.select(F.struct("__row", "__new").alias("__both")))
    changed = changed.select("__both.__row", "__both.__new")
    return shaped(row.where(~F.col("__in")), none).union(shaped(changed, new))


def _rewrite(texts, spans):
    rows = []
    for t, found in zip(texts, spans, strict=True):
        cuts = cover([(x["start"], x["stop"]) for x in found]) if t is not None and found is not None else []
        rows.append((without(t, cuts) if cuts else t, [{"start": s, "stop": e} for s, e in cuts], sum(e - s for s, e in cuts)))
    return pd.DataFrame(rows, columns=["text", "removed", "removed_chars"])
