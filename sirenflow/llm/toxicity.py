"""Toxicity by non-negative positive-unlabelled learning.

Numpy classifiers are trained from confirmed toxic examples and unlabelled text. With class prior pi, the risk is
``pi R_p+ + max(0, R_u- - pi R_p-)``; where the second part turns negative its gradient is reversed, which keeps
a flexible model from fitting the unlabelled positives as negatives. Features are counted over the whole training
sample by all tasks, and only those that tell toxic text apart are kept, so a training row is a short sparse vector,
however long its text. Several classifiers are trained, one task each, on the toxic examples and disjoint bags of
unlabelled text, and their scores are averaged.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from sirenflow.llm.common import cut

#: Bounds of the training sample, both of rows of the labels table: confirmed toxic rows, and rows whose label is not looked at.
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 18_000
BAGS = 3
FEATURES = 1 << 20
#: Features the classifiers look at: those whose rates in toxic and in unlabelled text differ most.
TOP = 1_000
#: Standard errors by which a feature's rates must differ; keeps a small sample's chance features out.
MIN_Z = 4.0
THRESHOLD = 0.7
_PUNCT = string.punctuation
_CACHE_WORDS = 50_000


def _word_ids(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself, its beginnings of 4 to 7 letters."""
    keys = [word, *(f"{word[:n]}^" for n in range(4, 8) if n < len(word))]
    return tuple(zlib.crc32(k.encode()) % FEATURES for k in keys)


def features(text: str | None, cache: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of a whole text and their weights; nothing for null or empty text."""
    words = Counter(w for w in (x.strip(_PUNCT) for x in (text or "").lower().split()) if w)
    ids, reps = [], []
    for w, n in words.items():
        f = cache.get(w)
        if f is None:
            if len(cache) >= _CACHE_WORDS:
                cache.clear()
            f = cache[w] = _word_ids(w)
        ids.extend(f)
        reps.extend([n] * len(f))
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    u, inv = np.unique(np.array(ids, np.int32), return_inverse=True)
    return u, np.log1p(np.bincount(inv, weights=reps)).astype(np.float32)


class Rows:
    """Sparse rows: for each row the places of its features and their weights."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray]):
        self.n, self.row = len(places), np.repeat(np.arange(len(places)), np.array([len(x) for x in places], np.int64))
        self.col = np.concatenate(places).astype(np.int64) if places else np.empty(0, np.int64)
        self.val = np.concatenate(values).astype(np.float64) if values else np.empty(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def grad(self, c: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.val * c[self.row], size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def pu_risk(w: np.ndarray, b: float, p: Rows, u: Rows, prior: float) -> tuple[float, float]:
    """The two parts of the risk, with logistic loss: of the toxic rows as toxic, and of the unlabelled ones as not, less the toxic share among them."""
    gp, gu = p.dot(w) + b, u.dot(w) + b
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def pu_gradient(w: np.ndarray, b: float, p: Rows, u: Rows, prior: float) -> np.ndarray:
    """Gradient of the risk by (w, b); where its second part is negative, that part's gradient reversed instead."""
    gp, gu = p.dot(w) + b, u.dot(w) + b
    up, uu = _sigmoid(gp), _sigmoid(gu)
    c_pos, c_p, c_u = -prior * (1 - up) / p.n, -prior * up / p.n, uu / u.n
    if pu_risk(w, b, p, u, prior)[1] < 0:  # gone below its bound: step back from it
        c_pos, c_p, c_u = np.zeros(p.n), -c_p, -c_u
    return np.append(p.grad(c_pos + c_p, len(w)) + u.grad(c_u, len(w)), (c_pos + c_p).sum() + c_u.sum())


def train_nnpu(p: Rows, u: Rows, size: int, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a logistic model of ``size`` features under the non-negative PU risk, by full-batch Adam."""
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not p.n or not u.n:
        return w, b
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = pu_gradient(w, b, p, u, prior)
        g[:-1] += decay * w * prior
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def _rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and how many unlabelled rows of a task hold each feature."""
    cache: dict[str, tuple[int, ...]] = {}
    seen = np.zeros((2, FEATURES), np.int64)
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            seen[0 if toxic else 1, features(text, cache)[0]] += 1
    ids = np.flatnonzero(seen.any(axis=0))
    yield pd.DataFrame({"f": ids.astype(np.int32), "cp": seen[0, ids], "cu": seen[1, ids]})


def telling_features(sample: DataFrame, n_p: int, n_u: int, top: int = TOP, min_z: float = MIN_Z) -> np.ndarray:
    """Ids of the at most ``top`` features whose rates in toxic and in unlabelled rows differ most, by ``min_z`` standard errors at least."""
    seen = sample.select("text", "toxic").mapInPandas(_rates, "f int, cp long, cu long").groupBy("f").agg(F.sum("cp").alias("cp"), F.sum("cu").alias("cu")).where("cp >= 3")
    spread = F.sqrt((F.col("cp") + F.col("cu") + 1.0) / (n_p + n_u) * (1 / n_p + 1 / n_u))
    gain = F.abs(F.col("cp") / n_p - F.col("cu") / n_u) / spread
    rows = seen.select("f", gain.alias("gain")).where(F.col("gain") >= min_z).orderBy(F.desc("gain"), "f").limit(top).collect()  # bounded
    return np.sort(np.array([r["f"] for r in rows], np.int32))


def _vectors(chosen: np.ndarray):
    """Each row of the sample on the chosen features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[int, ...]] = {}
        for pdf in batches:
            at, val = [], []
            for text in pdf["text"]:
                ids, weight = features(text, cache)
                place = np.minimum(np.searchsorted(chosen, ids), len(chosen) - 1)
                ok = chosen[place] == ids
                at.append(place[ok].astype(np.int32)), val.append(weight[ok])
            yield pd.DataFrame({"bag": pdf["bag"], "toxic": pdf["toxic"], "at": at, "val": val})

    return run


def _bag(prior: float, steps: int, size: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        toxic = pdf["toxic"].to_numpy(bool)
        part = lambda on: Rows(pdf["at"][on].tolist(), pdf["val"][on].tolist())
        w, b = train_nnpu(part(toxic), part(~toxic), size, prior, steps)
        return pd.DataFrame({"bag": [int(key[0])], "w": [w], "b": [b]})

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, bags: int = BAGS, steps: int = 300) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Classifiers (feature ids, weights, intercept) from rows of the training folds (crc32 mod 3 is not 1) of the labels table.

    Toxic rows are the confirmed examples; rows taken without a look at their label are the unlabelled text. The
    sample takes the rows with the smallest hash of their id, at most ``max_positive`` and ``max_unlabelled``.
    ``prior``: share of toxic text; by default its share among the labelled rows of the training folds.
    Contradicting labels of one id count as toxic. Without a toxic label every score is the prior.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(toxic).alias("y")).where(F.col("y").isNotNull() & (fold("id") != 1)).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    prior = min(0.9, max(1e-3, prior if prior is not None else share or 0.05))
    none = [(np.empty(0, np.int32), np.empty(0), float(np.log(prior / (1 - prior))))]
    order = F.xxhash64("id", F.lit("pu"))
    pos = known.where("y = 1").orderBy(order, "id").limit(max_positive).select("id", F.lit(True).alias("toxic"))
    unl = known.orderBy(order, "id").limit(max_unlabelled).select("id", F.lit(False).alias("toxic"))
    wanted = F.broadcast(cut(pos.union(unl)))  # at most max_positive + max_unlabelled ids
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(wanted, "id")
    own = F.array(F.pmod(F.xxhash64("id"), F.lit(bags)).cast("int"))
    sample = cut(sample.select("text", "toxic", F.when(F.col("toxic"), F.sequence(F.lit(0), F.lit(bags - 1))).otherwise(own).alias("bag")))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(n) < 2:
        return none
    chosen = telling_features(sample, n[True], n[False])
    if not len(chosen):
        return none
    rows = sample.mapInPandas(_vectors(chosen), "bag array<int>, toxic boolean, at array<int>, val array<float>")
    rows = rows.select(F.explode("bag").alias("bag"), "toxic", "at", "val")
    got = rows.groupBy("bag").applyInPandas(_bag(prior, steps, len(chosen)), "bag int, w array<double>, b double").orderBy("bag").collect()  # one row a bag
    return [(chosen, np.array(r["w"]), r["b"]) for r in got]


def scorer(models: list[tuple[np.ndarray, np.ndarray, float]]):
    """A column function: score (0 to 1) of whole texts. Null and empty texts get the intercepts' score."""
    every = np.unique(np.concatenate([m[0] for m in models]))
    table = np.zeros((len(every), len(models)))
    for k, (ids, w, _) in enumerate(models):
        table[np.searchsorted(every, ids), k] = w
    bias = np.array([m[2] for m in models])

    def run(batches):
        place = {f: i for i, f in enumerate(every.tolist())}
        cache: dict[str, list[int]] = {}  # places of a token's features in the table; most tokens have none
        for texts in batches:
            out = []
            for t in texts:
                reps: dict[int, int] = {}
                for token, n in Counter((t or "").lower().split()).items():
                    hits = cache.get(token)
                    if hits is None:
                        if len(cache) >= _CACHE_WORDS:
                            cache.clear()
                        word = token.strip(_PUNCT)
                        hits = cache[token] = [place[f] for f in set(_word_ids(word)) if f in place] if word else []
                    for i in hits:
                        reps[i] = reps.get(i, 0) + n
                z = bias + np.log1p(np.fromiter(reps.values(), float, len(reps))) @ table[list(reps)] if reps else bias
                out.append(float(_sigmoid(z).mean()))
            yield pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double", PandasUDFType.SCALAR_ITER)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per document: id, held_out (crc32 mod 3 is 1; false for a null id), score, predicted (1 if score >= threshold).

    Repeated rows get equal scores; extra columns are not read.
    """
    of = scorer(train(docs, labels, id_col, text, **how))
    scored = docs.select(F.col(id_col), of(F.col(text)).alias("score"))
    return scored.select(id_col, F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; all columns stay."""
    of = scorer(train(docs, labels, id_col, text, **how))
    return docs.where(of(F.col(text)) < threshold)
