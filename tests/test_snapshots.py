"""Snapshot tables: commits, readers in between, crashes, conflicts, expiry."""

import pytest

from roadlens.sources import sinks as SK
from roadlens.sources import snapshots as SN


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, n=40, buckets=8):
    path = SK.scratch_dir(spark, "snapshot")
    SN.create_snapshot_table(spark.range(n).selectExpr("concat('k', id) AS k", "id AS v"), path, ["k"], buckets)
    return path


def test_upserts_keep_older_versions_and_open_readers(spark):
    path = table(spark)
    before = SN.read_snapshot(spark, path)
    source = spark.createDataFrame([(-1, "k3"), (-2, "new")], "v long, k string")
    done = SN.upsert_snapshot(source, path)
    assert done["version"] == 1 and done["buckets_rewritten"] == 1 and done["buckets_added_to"] <= 1
    want = {f"k{i}": i for i in range(40)}
    assert dict(rows(before)) == want and dict(rows(SN.read_snapshot(spark, path, 0))) == want
    want |= {"k3": -1, "new": -2}
    assert dict(rows(SN.read_snapshot(spark, path))) == want
    SN.upsert_snapshot(spark.createDataFrame([("new", 7), ("k39", 8)], "k string, v long"), path)
    want |= {"new": 7, "k39": 8}
    assert dict(rows(SN.read_snapshot(spark, path))) == want and SN.read_snapshot(spark, path).count() == 41
    assert SN.versions(spark, path) == [0, 1, 2]


def test_files_of_other_buckets_are_not_rewritten(spark):
    path = table(spark)
    files = lambda v: {f for f in SN.read_snapshot(spark, path, v).inputFiles()}
    SN.upsert_snapshot(spark.createDataFrame([("k3", 0)], "k string, v long"), path)
    assert len(files(0) - files(1)) == len(files(1) - files(0)) == 1


def test_a_crash_before_the_commit_leaves_the_table(spark, monkeypatch):
    path = table(spark)
    want = rows(SN.read_snapshot(spark, path))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(SN, "_commit", dies)
        with pytest.raises(OSError):
            SN.upsert_snapshot(spark.createDataFrame([("k3", 0)], "k string, v long"), path)
    assert rows(SN.read_snapshot(spark, path)) == want and SN.versions(spark, path) == [0]
    assert SN.expire_snapshots(spark, path, 1) == 1
    assert rows(SN.read_snapshot(spark, path)) == want


def test_two_writers_from_one_version(spark, monkeypatch):
    path = table(spark)
    known, real = SN.versions(spark, path), SN.versions
    SN.upsert_snapshot(spark.createDataFrame([("k1", -1)], "k string, v long"), path)
    with monkeypatch.context() as m:
        m.setattr(SN, "versions", lambda *_: known)
        with pytest.raises(SN.CommitConflict):
            SN.upsert_snapshot(spark.createDataFrame([("k1", -5)], "k string, v long"), path)
    assert dict(rows(SN.read_snapshot(spark, path)))["k1"] == -1 and real(spark, path) == [0, 1]


def test_expiry_keeps_the_last_versions(spark):
    path = table(spark)
    for i in range(3):
        SN.upsert_snapshot(spark.createDataFrame([("k3", -i), (f"n{i}", i)], "k string, v long"), path)
    want = rows(SN.read_snapshot(spark, path))
    assert SN.expire_snapshots(spark, path, 1) > 0 and SN.versions(spark, path) == [3]
    assert rows(SN.read_snapshot(spark, path)) == want
    with pytest.raises(FileNotFoundError):
        SN.read_snapshot(spark, path, 0)


def test_odd_rows(spark):
    path = table(spark, 0)
    assert SN.read_snapshot(spark, path).count() == 0
    SN.upsert_snapshot(spark.createDataFrame([(None, 1), ("a", 2)], "k string, v long"), path)
    SN.upsert_snapshot(spark.createDataFrame([(None, 3), ("a", 4)], "k string, v long"), path)
    SN.upsert_snapshot(spark.createDataFrame([], "k string, v long"), path)
    assert sorted(SN.read_snapshot(spark, path).collect(), key=lambda r: r.v) == [(None, 1), (None, 3), ("a", 4)]
    with pytest.raises(ValueError):
        SN.upsert_snapshot(spark.createDataFrame([("b", 1), ("b", 2)], "k string, v long"), path)
    assert SN.versions(spark, path)[-1] == 3
    with pytest.raises(FileNotFoundError):
        SN.read_snapshot(spark, SK.scratch_dir(spark, "none"))
