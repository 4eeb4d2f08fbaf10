"""Shared helpers: word rule, shared checkpoints, column-name hygiene."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF, CR. ``bytes.split()`` follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bits of a key filter: 16 a key, within these powers of two. The largest has 32 MB.
LEAST_BITS, MOST_BITS = 16, 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or one beside the warehouse where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and read back: cuts lineage, and the planner knows the size and so
    broadcasts the table in joins only below ``spark.sql.autoBroadcastJoinThreshold``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside: bounds what a Python worker holds of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(int(old), rows) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_key(text: str = "text") -> Column:
    """128-bit digest of the text as hex; null and empty text count as different texts."""
    return F.md5(F.col(text).cast("binary"))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on columns of the same name."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


class KeyFilter:
    """Fixed-size summary of a set of long keys: tells which keys are certainly not in it.

    Built by the tasks, it goes to the driver in blobs of 64 KB and on to the tasks that ask it, so that rows whose key is
    not in the set need no shuffle to find out. A full filter lets rows through; it loses none. It never decides
    alone: what it lets through is joined exactly.
    """

    def __init__(self, keys: DataFrame, key: str, most_bits: int = MOST_BITS):
        bits = min(most_bits, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, keys.count())))))
        self.mask = (1 << bits) - 1
        at = F.col(key).bitwiseAND(F.lit(self.mask))
        one = F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))")
        words = keys.select(F.shiftright(at, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).withColumn("chunk", F.shiftright("w", 13))

        def blob(pdf: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(8192, np.int64)
            out[pdf["w"].to_numpy() & 8191] = pdf["b"].to_numpy()
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "blob": [out.tobytes()]})

        self.words = np.zeros(max(8192, (1 << bits) // 64), np.int64)
        for r in words.groupBy("chunk").applyInPandas(blob, "chunk long, blob binary").collect():  # at most 512 blobs of 64 KB
            self.words[r["chunk"] * 8192 : (r["chunk"] + 1) * 8192] = np.frombuffer(r["blob"], np.int64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the set."""
        return (self.words[(keys & self.mask) >> 6] >> (keys & 63)) & 1 == 1

    def column(self, key: Column) -> Column:
        def run(keys: pd.Series) -> pd.Series:
            return pd.Series(self.may_hold(keys.to_numpy(np.int64)))

        run.__annotations__ = {}
        return F.pandas_udf(run, "boolean")(key)
