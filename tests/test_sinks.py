"""Upserts that follow one another, and the manifest of a failing run."""

import pytest

from roadlens.sources import sinks as SK


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_upserts_in_a_row(spark):
    path = SK.scratch_dir(spark, "upsert")
    spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int").write.parquet(path)
    first = SK.upsert(spark, path, spark.createDataFrame([("b", 20), ("d", 4)], "k string, v int"), ["k"])
    assert rows(first) == [("a", 1), ("b", 20), ("c", 3), ("d", 4)]
    SK.upsert(spark, path, spark.createDataFrame([(5, "e"), (30, "c"), (40, "d")], "v int, k string"), ["k"])
    assert rows(spark.read.parquet(path)) == [("a", 1), ("b", 20), ("c", 30), ("d", 40), ("e", 5)]


def test_upsert_rejects_repeated_keys_and_keeps_the_table(spark):
    path = SK.scratch_dir(spark, "upsert")
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(path)
    with pytest.raises(ValueError):
        SK.upsert(spark, path, spark.createDataFrame([("b", 1), ("b", 2)], "k string, v int"), ["k"])
    assert rows(spark.read.parquet(path)) == [("a", 1)]


def test_manifest_records_a_failed_stage(spark):
    manifest, out = SK.scratch_dir(spark, "manifest"), SK.scratch_dir(spark, "out")
    good = ("good", lambda: (spark.range(7), lambda d: d.write.parquet(out)), ["in/a"], [out])

    def bad():
        raise RuntimeError("x" * 2000)

    with pytest.raises(RuntimeError):
        SK.run_manifest(spark, [good, ("bad", bad, ["in/b"], []), ("never", bad)], manifest, "run-1")
    found = {r.stage: r for r in spark.read.parquet(manifest).collect()}
    assert set(found) == {"good", "bad"}
    assert (found["good"].status, found["good"].rows, found["good"].inputs, found["good"].outputs) == ("success", 7, ["in/a"], [out])
    assert found["bad"].status == "failed" and found["bad"].rows is None and found["bad"].error == "RuntimeError: " + "x" * 2000
    assert all(r.run_id == "run-1" and r.duration_s >= 0 for r in found.values())


def test_manifest_appends_runs(spark):
    manifest = SK.scratch_dir(spark, "manifest")
    stage = ("s", lambda: (spark.range(2), lambda d: d.write.format("noop").mode("overwrite").save()))
    SK.run_manifest(spark, [stage], manifest, "run-1")
    second = SK.run_manifest(spark, [stage, ("t", stage[1])], manifest, "run-2")
    assert [r.stage for r in second.orderBy("stage").collect()] == ["s", "t"]
    assert spark.read.parquet(manifest).count() == 3


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from roadlens.session import ensure_checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
