"""Scans over the sorted rows of a key, in parallel inside a key: what a row needs from the rows before it is carried from task to task."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.operators.lineage import cut


class Scan(Protocol):
    """A fold over a key's rows in order, of which blocks can be summed up before what comes ahead of them is known."""

    columns: list[str]

    def start(self):
        """The state before a key's first row."""

    def read(self, summary, rows: pd.DataFrame):
        """The summary (None at first) of a block with more rows read; of bounded size."""

    def absorb(self, state, summary):
        """The state after a block, from that before it and the block's summary."""

    def write(self, state, rows: pd.DataFrame):
        """(output rows, state after them)."""


def _runs(pdf: pd.DataFrame, key: str) -> Iterator[tuple[str, pd.DataFrame]]:
    keys = pdf[key].to_numpy()
    at = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            yield keys[a], pdf.iloc[a:b]


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _summaries(scan: Scan, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, summary = [], None, None
        for pdf in batches:
            for k, rows in _runs(pdf, key):
                if k != now:
                    if now is not None and not out:
                        out.append((_task(), now, pickle.dumps(summary)))
                    now, summary = k, None
                summary = scan.read(summary, rows)
        if now is not None and not (out and out[0][1] == now):
            out.append((_task(), now, pickle.dumps(summary)))
        yield pd.DataFrame(out, columns=["task", "key", "summary"]).astype({"task": "int32"})

    return run


def _writer(scan: Scan, key: str, states: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, now, state = _task(), None, None
        for pdf in batches:
            parts = []
            for k, rows in _runs(pdf, key):
                if k != now:
                    now, state = k, states.get((task, k), scan.start())
                out, state = scan.write(state, rows)
                parts.append(out)
            if parts:
                yield pd.concat(parts)

    return run


def scanned(df: DataFrame, key: str, order: list[str], scan: Scan, schema: str, tasks: int | None = None) -> DataFrame:
    """Output rows of ``scan`` over the rows of each ``key`` (a string column without nulls) in ``order`` (nulls first).

    The rows are range-sorted by key and order, with a row number last, and checkpointed, so a key of any size lies in many
    tasks. A first pass sums up the first and the last key of each task; these summaries, two a task at most, are combined in
    order, and a second pass writes each task's rows from the state before them. Other keys lie in one task.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order, "__row"]
    t = cut(df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(tasks, *by).sortWithinPartitions(*by).drop("__row"))
    edges = t.select(key, *scan.columns).mapInPandas(_summaries(scan, key), "task int, key string, summary binary").collect()  # two rows a task at most
    states, state, now = {}, None, None
    for e in sorted(edges, key=lambda e: (e["key"], e["task"])):
        if e["key"] != now:
            now, state = e["key"], scan.start()
        states[e["task"], e["key"]] = state
        state = scan.absorb(state, pickle.loads(e["summary"]))
    return t.mapInPandas(_writer(scan, key, states), schema)
