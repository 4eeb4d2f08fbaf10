"""Tables that change in place (SNK-01 to 04, SNK-08): copies of the touched buckets, and a numbered pointer that names what is current."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


class BucketedTable:
    """A keyed table in a folder: ``data/<commit>/__bucket=<k>`` holds the rows of a bucket as one commit left them, and
    ``pointers/<number>`` says, as JSON, which commit holds each bucket now.

    A pointer is written once and never changed; creating it is the commit, and fails if another writer has taken its number.
    Readers take the newest pointer and keep reading its files whatever comes later; files go only by :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _pointers(self) -> list[int]:
        at = self._path(f"{self.path}/pointers")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def version(self) -> int | None:
        """Number of the newest commit."""
        return (self._pointers() or [None])[-1]

    def pointer(self, version: int | None = None) -> dict:
        number = self.version() if version is None else version
        if number is None:
            return {"runs": [], "schema": None, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{number}", wholetext=True).first()[0])

    def _commit(self, number: int, pointer: dict) -> None:
        """Creates the pointer under its number; an error if there is one already."""
        at, draft = self._path(f"{self.path}/pointers/{number}"), self._path(f"{self.path}/drafts/{number}-{self._jvm.java.util.UUID.randomUUID()}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            raise RuntimeError(f"commit {number} was made by another writer")

    def _bucket(self) -> object:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table at a commit (the newest by default), or some of its buckets; None if there is nothing yet."""
        p = self.pointer(version)
        if p["schema"] is None:
            return None
        files = [f"{self.path}/data/{commit}/{BUCKET}={b}" for b, commit in p["buckets"].items() if only is None or int(b) in only]
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(p["schema"])
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def merge(self, changes: DataFrame, into: Callable[[DataFrame | None, DataFrame], DataFrame], run: str) -> list[int]:
        """Applies ``into(rows, changes)`` (say :func:`operators.upsert.upsert`) to the buckets that ``changes`` touch; their numbers.

        ``run`` names the change: a run that is committed already changes nothing, so a retry is harmless even
        if its rows come out differently. ``into`` must keep a row's key. Rows of ``changes`` with a null key are a key's.
        """
        before = self.version()
        old = self.pointer(before)
        if run in old["runs"]:
            return []
        keyed = changes.withColumn(BUCKET, self._bucket())
        touched = sorted(r[0] for r in keyed.select(BUCKET).distinct().collect())  # at most one row a bucket
        if not touched:
            return []
        number = 0 if before is None else before + 1
        rows = into(self.read(before, touched), changes)
        commit = f"{number}-{self._jvm.java.util.UUID.randomUUID()}"
        out = rows.withColumn(BUCKET, self._bucket())
        out.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{commit}")
        there = {s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(self._path(f"{self.path}/data/{commit}")) if s.isDirectory()}
        if not there <= {str(b) for b in touched}:
            raise ValueError("the merged rows have keys outside the buckets of the changes")
        kept = {b: c for b, c in old["buckets"].items() if int(b) not in touched}
        self._commit(number, {"runs": [*old["runs"], run], "schema": json.loads(rows.schema.json()), "buckets": kept | dict.fromkeys(sorted(there), commit)})
        return touched

    def vacuum(self, keep: int = 2) -> None:
        """Removes pointers but the last ``keep``, and the files that none of these names. Readers of older ones lose them."""
        pointers = self._pointers()
        live = {c for n in pointers[-keep:] for c in self.pointer(n)["buckets"].values()}
        for n in pointers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/pointers/{n}"), False)
        for s in self._fs.listStatus(self._path(f"{self.path}/data")):
            if s.getPath().getName() not in live:
                self._fs.delete(s.getPath(), True)
