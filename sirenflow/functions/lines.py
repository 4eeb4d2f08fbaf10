"""Lines of several parts: merging, and the place at a fraction of the length (LIN-02)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merged_line(parts: list[list[tuple[float, float]]]) -> list[tuple[float, float]]:
    """Parts joined where exactly two ends meet; the longest line if several are left, the first of equals."""
    lines = [list(p) for p in parts if len(p) > 1]
    while True:
        ends: dict[tuple[float, float], list[int]] = {}
        for i, p in enumerate(lines):
            for e in (p[0], p[-1]):
                ends.setdefault(e, []).append(i)
        pair = next((v for v in ends.values() if len(v) == 2 and v[0] != v[1]), None)
        if pair is None:
            break
        a, b = lines[pair[0]], lines[pair[1]]
        at = next(e for e, v in ends.items() if v is pair)
        a = a if a[-1] == at else a[::-1]
        b = b if b[0] == at else b[::-1]
        lines = [p for i, p in enumerate(lines) if i not in pair] + [a + b[1:]]
    size = lambda p: sum(np.hypot(x2 - x1, y2 - y1) for (x1, y1), (x2, y2) in zip(p, p[1:]))
    return max(lines, key=size, default=[])


def _at_fraction(lines: pd.Series, fraction: pd.Series) -> pd.DataFrame:
    out = []
    for parts, f in zip(lines, fraction):
        line = merged_line([[(q["lng"], q["lat"]) for q in p] for p in parts]) if parts is not None and f is not None and f == f else []
        if not line:
            out.append((None, None))
            continue
        x, y = np.array(line).T
        far = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
        at = min(1.0, max(0.0, f)) * far[-1]
        out.append((float(np.interp(at, far, y)), float(np.interp(at, far, x))))
    return pd.DataFrame(out, columns=["lat", "lng"])


_at_fraction.__annotations__ = {}


def point_at(lines: Column, fraction: Column) -> Column:
    """LIN-02: struct(lat, lng) at a fraction (cut to 0..1) of a road's length in degrees, its parts merged; null without a line."""
    return F.pandas_udf(_at_fraction, "lat double, lng double")(lines, fraction)
