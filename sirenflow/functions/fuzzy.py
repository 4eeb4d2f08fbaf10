"""Similarity helpers that Spark lacks: Arrow functions, meant for distinct pairs (FN-07, AGG-08, FN-04)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(codes) + 1, np.int64)
    for ch in a:
        take = np.concatenate(([0], row[:-1] + (codes == ord(ch))))
        row = np.maximum.accumulate(np.maximum(row, take))
    return int(row[-1])


def indel(a: str, b: str) -> int:
    """0 to 100: twice the common subsequence over both lengths, rounded."""
    total = len(a) + len(b)
    return round(200 * _common(a, b) / total) if total else 100


def token_set(a: str, b: str) -> int:
    """Best indel ratio among the shared words and the shared words with each side's rest; 0 if a side has no word."""
    x, y = (set(re.sub(r"[\W_]+", " ", s.lower()).split()) for s in (a, b))
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 100
    pairs = [(left, right)] + ([(both, left), (both, right)] if both else [])
    return max(indel(*p) for p in pairs)


def _edit(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def wer(ref: str, hyp: str) -> float:
    """Word edits over the reference's words; an empty reference gives 0 or 1."""
    a, b = ref.split(), hyp.split()
    return (float(bool(b)) if not a else _edit(a, b) / len(a))


def polyline(text: str) -> list[tuple[float, float]]:
    """Points (lat, lng) of an encoded polyline of five decimals."""
    out, at, last = [], 0, [0, 0]
    while at < len(text):
        for k in (0, 1):
            shift = value = 0
            while True:
                byte = ord(text[at]) - 63
                at += 1
                value |= (byte & 31) << shift
                shift += 5
                if byte < 32:
                    break
            last[k] += ~(value >> 1) if value & 1 else value >> 1
        out.append((last[0] / 1e5, last[1] / 1e5))
    return out


def _pairwise(fn):
    def run(a, b):
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)])

    return run


def fuzzy_ratio(a, b):
    """FN-07 as a column function."""
    return F.pandas_udf(_pairwise(indel), "int")(a, b)


def token_set_ratio(a, b):
    """FN-07 as a column function."""
    return F.pandas_udf(_pairwise(token_set), "int")(a, b)


def word_error_rate(ref, hyp):
    """AGG-08 as a column function."""
    return F.pandas_udf(_pairwise(wer), "double")(ref, hyp)


def char_error_rate(ref, hyp):
    """AGG-08: character edits over the reference's length."""
    empty = F.length(ref) == 0
    return F.when(empty, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def best_of(terms, floor: int):
    """Arrow function: the term of the best token-set score at or above ``floor``, ties by place; each distinct text of a batch is scored once."""
    terms = list(terms)

    def best(t: str) -> str | None:
        score, place = max(((token_set(t, x), -i) for i, x in enumerate(terms)), default=(0, 0))
        return terms[-place] if terms and score >= floor else None

    @F.pandas_udf("string")
    def pick(text: pd.Series) -> pd.Series:
        known = {t: best(t) for t in text.dropna().unique()}
        return text.map(lambda t: known.get(t))

    return pick


def register(spark) -> None:
    """SQL names of the helpers."""
    for name, fn, kind in (("fuzzy_ratio", indel, "int"), ("token_set_ratio", token_set, "int"), ("word_error_rate", wer, "double")):
        spark.udf.register(name, F.pandas_udf(_pairwise(fn), kind))
