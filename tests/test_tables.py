"""Tables that change in place: only touched buckets are written, readers keep what they read, retries change nothing."""

import pytest

from sirenflow.operators.upsert import patch, upsert
from sirenflow.sources.tables import BucketedTable

ROW = "id int, a string, b string"


def _merge(old, new):
    return new if old is None else upsert(old, new, "id", ["a"], ["b"])


def _rows(df):
    return sorted((r.id if r.id is not None else -1, r.a, r.b) for r in df.collect())


def _bytes(path):
    return sum(p.stat().st_size for p in (path / "data").rglob("*.parquet"))


def test_a_small_change_writes_its_buckets_only(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=32)
    assert t.read() is None and t.version() is None
    first = spark.createDataFrame([(k, f"a{k} " + "x" * 50, f"b{k}") for k in range(6000)], ROW)
    assert len(t.merge(first, _merge, "load")) == 32
    whole, reader = _bytes(tmp_path / "t"), t.read()
    touched = t.merge(spark.createDataFrame([(5, "new", "ignored"), (9999, "born", "own")], ROW), _merge, "day 1")
    assert 1 <= len(touched) <= 2 and _bytes(tmp_path / "t") - whole < whole / 8
    got = {r.id: (r.a, r.b) for r in t.read().collect()}
    assert len(got) == 6001 and got[5] == ("new", "b5") and got[9999] == ("born", "own") and got[6] == ("a6 " + "x" * 50, "b6")
    # a reader from before, and a reader of the old number, see the old rows
    assert {r.id: r.a for r in reader.where("id = 5").collect()} == {5: "a5 " + "x" * 50} and t.read(0).where("id = 9999").count() == 0


def test_retries_and_other_writers(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=4)
    t.merge(spark.createDataFrame([(1, "x", "y"), (None, "none", "n")], ROW), _merge, "load")
    t.merge(spark.createDataFrame([(1, "z", None)], ROW), _merge, "day")
    # the retry of a run has other rows: still nothing changes
    assert t.merge(spark.createDataFrame([(1, "other", None)], ROW), _merge, "day") == [] and t.version() == 1
    assert _rows(t.read()) == [(-1, "none", "n"), (1, "z", "y")]
    assert t.merge(spark.createDataFrame([], ROW), _merge, "nothing") == []
    # a writer that began at the same commit loses and leaves the table as it is
    other = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=4)

    def slow(old, new):
        other.merge(spark.createDataFrame([(2, "theirs", "b")], ROW), _merge, "theirs")
        return _merge(old, new)

    with pytest.raises(RuntimeError):
        t.merge(spark.createDataFrame([(3, "mine", "b")], ROW), slow, "mine")
    assert _rows(t.read()) == [(-1, "none", "n"), (1, "z", "y"), (2, "theirs", "b")]
    t.merge(spark.createDataFrame([(3, "mine", "b")], ROW), _merge, "mine")
    before = _rows(t.read())
    t.vacuum(keep=1)
    assert _rows(t.read()) == before and len(list((tmp_path / "t" / "pointers").glob("[0-9]*"))) == 1


def test_rows_may_go_and_patches_apply(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), "id", buckets=2)
    t.merge(spark.createDataFrame([(k, "a", "b") for k in range(4)], ROW), _merge, "load")
    t.merge(spark.createDataFrame([(k,) for k in range(4)], "id int"), lambda old, gone: old.join(gone, "id", "left_anti"), "clear")
    assert t.read().count() == 0
    p = spark.createDataFrame([(1, "new", None, ["a"])], ROW + ", present array<string>")
    t.merge(p, lambda old, new: patch(old, new, "id", ["a", "b"]), "patch")
    assert _rows(t.read()) == [(1, "new", None)]
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(1, "x", "y")], ROW), lambda old, new: new.selectExpr("explode(sequence(1, 50)) as id", "a", "b"), "wrong keys")
