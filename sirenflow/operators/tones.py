"""Tone clips: spectral peaks, fingerprints, loudness, and clips with their dispatch (SIG-01, 02, 04, JN-16)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: filter, peak and match settings, and the known tones
CUTOFF_HZ, ORDER, APART_HZ, PROMINENT = 300.0, 5, 15.0, 0.05
PEAKS, PURE_Z = 10, 30.0
TOLERANCE_HZ, MATCH_MIN = 8.0, 0.5
TONES = {"PA Tone": (595.00, 647.00), "Chief Tone": (440.20, 660.34), "Engine Tone": (600.00, 1350.00), "Rescue Tone": (727.09, 891.99), "Dispatch Announcement": (1000.00,)}
CATEGORIES = (("Engine", ("E1", "E2", "E3", "E4")), ("Rescue", ("R2", "R1")), ("Chief", ("C6", "C1", "C9")), ("Ladder", ("L1",)))


def _high_pass(size: int, rate: int) -> np.ndarray:
    """Response of a Butterworth high pass of order 5 at the bins of a real transform (bilinear form)."""
    w = np.tan(np.pi * np.arange(size // 2 + 1) / max(size, 1))
    edge = np.tan(np.pi * CUTOFF_HZ / rate)
    with np.errstate(divide="ignore", over="ignore"):
        return 1 / np.sqrt(1 + (edge / np.maximum(w, 1e-12)) ** (2 * ORDER))


def _peaks(mag: np.ndarray, apart: int) -> np.ndarray:
    """Local maxima of enough prominence, the higher of two that are closer than ``apart`` bins, highest first."""
    at = np.flatnonzero((mag[1:-1] > mag[:-2]) & (mag[1:-1] >= mag[2:])) + 1
    at = at[mag[at] >= PROMINENT * mag.max()]  # a lower peak cannot be prominent enough
    kept: list[int] = []
    for i in at[np.argsort(-mag[at], kind="stable")]:
        if all(abs(i - j) >= apart for j in kept):
            kept.append(int(i))

    def prominence(i: int) -> float:
        left, right = np.flatnonzero(mag[:i] > mag[i]), np.flatnonzero(mag[i + 1 :] > mag[i])
        lo, hi = (left[-1] if len(left) else 0), (i + 1 + right[0] if len(right) else len(mag))
        return mag[i] - max(mag[lo : i + 1].min(), mag[i:hi].min())

    return np.array([i for i in kept if prominence(i) >= PROMINENT * mag.max()], int)


def spectrum(pcm: bytes, rate: int) -> tuple[list[int], float]:
    """Whole hertz of the strongest peaks and the z-score of the highest bin; silence and empty clips have none and zero.

    The high pass is applied to the windowed spectrum, so its start-up transient is not part of it.
    """
    x = np.frombuffer(pcm, "<i2").astype(float)
    if len(x) < 3 or rate <= 0:
        return [], 0.0
    mag = np.abs(np.fft.rfft(x * np.hamming(len(x)))) * _high_pass(len(x), rate)
    if not mag.std() > 0:
        return [], 0.0
    best = _peaks(mag, max(1, int(APART_HZ * len(x) / rate)))[:PEAKS]
    return sorted({int(i * rate / len(x)) for i in best}), float((mag.max() - mag.mean()) / mag.std())


def peaks(clips: DataFrame, min_z: float = PURE_Z) -> DataFrame:
    """SIG-01: (clip_id, freqs, z) of clips (clip_id, rate, pcm as 16-bit); clips that are not pure enough have no frequency."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [spectrum(p or b"", int(r or 0)) for p, r in zip(b["pcm"], b["rate"].fillna(0), strict=True)]
            yield pd.DataFrame({"clip_id": b["clip_id"], "freqs": [f if z >= min_z else [] for f, z in got], "z": [z for _, z in got]})

    return clips.select("clip_id", "rate", "pcm").mapInPandas(run, "clip_id string, freqs array<int>, z double")


def tone_matches(freqs: Column, tones: dict[str, tuple[float, ...]] = TONES) -> Column:
    """SIG-02: array of struct(tone, score) of the tones half of whose frequencies are within 8 Hz, best first, ties in the tones' order."""
    near = lambda g: F.exists(freqs, lambda f: F.abs(f - F.lit(g)) <= TOLERANCE_HZ).cast("int")
    rows = [F.struct((-sum((near(g) for g in gs), F.lit(0)) / len(gs)).alias("s"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (t, gs) in enumerate(tones.items()) if gs]
    best = F.array_sort(F.filter(F.array(*rows), lambda r: -r["s"] >= MATCH_MIN))
    return F.when(freqs.isNotNull(), F.transform(best, lambda r: F.struct(r["t"].alias("tone"), (-r["s"]).alias("score"))))


def loudness(clips: DataFrame, block: int = 1024) -> DataFrame:
    """SIG-04: (clip_id, block, rms): root mean square of every block of samples; an empty clip is one block of 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, p in zip(b["clip_id"], b["pcm"], strict=True):
                x = np.frombuffer(p or b"", "<i2").astype(np.float32)
                parts = [x[i : i + block] for i in range(0, max(len(x), 1), block)]
                yield pd.DataFrame({"clip_id": k, "block": range(len(parts)), "rms": [float(np.sqrt(np.mean(q * q))) if len(q) else 0.0 for q in parts]})

    return clips.select("clip_id", "pcm").mapInPandas(run, "clip_id string, block int, rms double")


def clip_categories(clips: DataFrame, dispatches: DataFrame) -> DataFrame:
    """JN-16: the columns of ``clips`` with units, incident and category, for reviewed dispatches with units.

    Dispatches: dispatch_id (the clip_id), feedback_submitted, verified_units, responding_units, tone_name, incident_type.
    The recorded tone decides, then the units, else All.
    """
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    d = dispatches.where("feedback_submitted").select(F.col("dispatch_id").alias("clip_id"), F.coalesce(some("verified_units"), some("responding_units")).alias("units"), F.coalesce("incident_type", F.lit("Unknown")).alias("incident"), "tone_name")
    said, cat = F.upper(F.array_join("units", " ")), F
    for name in ("Engine", "Rescue", "Chief", "PA"):
        cat = cat.when(F.col("tone_name").contains(name), name)
    for name, codes in CATEGORIES:
        cat = cat.when(said.rlike("|".join(codes)), name)
    j = clips.join(d.where("units is not null"), "clip_id")
    return j.withColumn("category", cat.otherwise("All")).drop("tone_name")
