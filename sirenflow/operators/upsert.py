"""Snapshots merged by key: full outer joins with a stated winner per column (SNK-01..04, JN-12, JN-13, JN-18, QC-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    o = old.select(F.col(key), F.struct("*").alias("o"))
    n = new.select(F.col(key), F.struct("*").alias("n"))
    return o.join(n, key, "full_outer")


def upsert(old: DataFrame, new: DataFrame, key: str, refresh: list[str], keep: list[str]) -> DataFrame:
    """SNK-01 and SNK-02: ``refresh`` columns come from the new row where there is one, nulls too; ``keep`` columns stay.

    A new key takes its ``keep`` columns from the new row if it has them, else null.
    """
    b = _both(old, new, key)
    there = F.col("n").isNotNull()
    cols = [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in refresh]
    for c in keep:
        own = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        cols.append(F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(own).alias(c))
    return b.select(key, *cols)


def patch(old: DataFrame, patches: DataFrame, key: str, fields: list[str], present: str = "present") -> DataFrame:
    """SNK-04: only the fields named in a patch's ``present`` array change, to null as well; unknown keys are inserted."""
    b = _both(old, patches, key)
    has = lambda c: F.coalesce(F.array_contains(F.col(f"n.{present}"), c), F.lit(False))
    return b.select(key, *[F.when(has(c), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields])


def keep_manual(derived: DataFrame, manual: DataFrame, key: list[str]) -> DataFrame:
    """JN-12: derived rows give way to manual rows of the same key."""
    return derived.join(manual, key, "left_anti").unionByName(manual)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JN-18 and QC-05: (key, change, fields): added, deleted or modified rows, with the names of the changed fields."""
    b = _both(old, new, key)
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in fields]))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.size(changed) > 0, "modified")
    return b.select(key, change.alias("change"), F.when(change == "modified", F.array_join(changed, ",")).otherwise("").alias("fields")).where("change is not null")
