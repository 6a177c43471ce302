"""Streams that keep state: late rows, state let go, changes only, restarts, observed counts."""

import json

import pytest

from roadlens.plans import catalog, q_io  # noqa: F401  (the catalog loads the modules in order)
from roadlens.sources.sinks import scratch_dir
from roadlens.streaming import ingest as ST


def message(i, segment, time, speed):
    return json.dumps({"message_id": str(i), "run_id": "r", "city": "hanoi", "segment_id": segment, "event_time": time, "currentSpeed": str(speed), "freeFlowSpeed": "50", "jamFactor": "1"})


def feed(spark, path, *messages):
    spark.createDataFrame([(m,) for m in messages], "value string").coalesce(1).write.mode("append").text(path)


def stream(spark, path):
    return ST.stream_normalize(spark.readStream.schema(ST.TOPIC_SCHEMAS["traffic"]).option("maxFilesPerTrigger", 1).json(path))


def test_windows_are_emitted_and_let_go(spark):
    src = scratch_dir(spark, "state_src")
    feed(spark, src, *[message(i, f"S{i}", "2024-01-01T00:10:00", 10 + i) for i in range(20)])
    feed(spark, src, message(100, "S0", "2024-01-02T00:00:00", 30))
    feed(spark, src, message(101, "S0", "2024-01-02T01:00:00", 40), message(102, "S1", "2024-01-01T00:20:00", 99))
    feed(spark, src, message(103, "S0", "2024-01-02T02:00:00", 50), message(104, "S1", "2024-01-01T00:20:00", 99))
    out, q = q_io.run_appending(ST.bucket_means(stream(spark, src), 60, "2 hours"), spark, "state_out")
    rows = {(r.segment_id, str(r.bucket_start)): (r.avg_speed, r.messages) for r in out.collect()}
    # windows of the first hour: their state goes after the third trigger, which still counts its message; that of the fourth is late
    assert rows == {**{(f"S{i}", "2024-01-01 00:00:00"): (10.0 + i, 1) for i in range(20)}, ("S1", "2024-01-01 00:00:00"): (55.0, 2)}
    states = [p.stateOperators[0] for p in q.recentProgress if p.stateOperators]
    assert sum(s.numRowsDroppedByWatermark for s in states) == 1
    assert max(s.numRowsTotal for s in states) >= 20 and states[-1].numRowsTotal <= 3


def test_dedup_lets_keys_go(spark):
    src = scratch_dir(spark, "dedup_src")
    feed(spark, src, *[message(i % 10, f"S{i % 10}", "2024-01-01T00:10:00", 10) for i in range(20)])
    feed(spark, src, message(100, "S0", "2024-01-03T00:00:00", 30), message(3, "S3", "2024-01-01T00:10:00", 10))
    feed(spark, src, message(101, "S0", "2024-01-04T00:00:00", 30), message(4, "S4", "2024-01-01T00:10:00", 10))
    from pyspark.sql import functions as F

    out, q = q_io.run_appending(ST.stream_dedup(stream(spark, src).withColumn("topic", F.lit("traffic")), "1 hour"), spark, "dedup_out")
    assert sorted(r.message_id for r in out.collect()) == sorted([str(i) for i in range(10)] + ["100", "101"])
    states = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(states) >= 10 and states[-1] <= 1


def test_latest_emits_changes_only_and_restarts(spark):
    src, out, ckpt = (scratch_dir(spark, n) for n in ("latest_src", "latest_out", "latest_ckpt"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)

    def run():
        q = ST.latest_state(stream(spark, src)).writeStream.outputMode("update").foreachBatch(ST.append_each_batch(out))
        q = q.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    spark.conf.set(key, ST.STATE_STORE)
    try:
        feed(spark, src, *[message(i, f"S{i}", "2024-01-01T00:10:00", 10 + i) for i in range(5)])
        run()
        # newer for S1, older for S2, no number for S3, no time for S4
        feed(spark, src, message(9, "S1", "2024-01-01T00:20:00", 44), message(10, "S2", "2024-01-01T00:00:00", 45), message(11, "S3", "2024-01-01T00:30:00", "much"), message(12, "S4", "never", 1))
        run()
    finally:
        spark.conf.set(key, before)
    changes = spark.read.parquet(out)
    assert sorted(r.segment_id for r in changes.filter("_batch_id = 1").collect()) == ["S1", "S3"]
    latest = {r.segment_id: (str(r.event_ts), r.currentSpeed) for r in ST.latest_of_changes(changes).collect()}
    assert latest == {"S0": ("2024-01-01 00:10:00", 10.0), "S1": ("2024-01-01 00:20:00", 44.0), "S2": ("2024-01-01 00:10:00", 12.0), "S3": ("2024-01-01 00:30:00", None), "S4": ("2024-01-01 00:10:00", 14.0)}


def test_report_reads_what_the_batches_observed(spark):
    src, bronze, dlq, ckpt, metrics = (scratch_dir(spark, n) for n in ("rep_src", "rep_bronze", "rep_dlq", "rep_ckpt", "rep_metrics"))

    def run():
        q = ST.stream_validate(stream(spark, src)).writeStream.foreachBatch(ST.route_to_sinks(bronze, dlq, metrics))
        q = q.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return tuple(ST.stream_counts(spark.read.parquet(metrics)).first())

    feed(spark, src, *[message(i, "S1", "2024-01-01T00:10:00", 10) for i in range(7)], message(8, "S1", "2024-01-01T00:10:00", -4))
    assert run() == (8, 7, 1, "PASS")
    feed(spark, src, message(9, "S2", "2024-01-01T00:10:00", -1))
    assert run() == (9, 7, 2, "PASS")
    plan = ST.stream_counts(spark.read.parquet(metrics))._jdf.queryExecution().executedPlan().toString()
    assert bronze not in plan and dlq not in plan


@pytest.mark.parametrize("name", ["q_stream_dedup", "q_stream_bucket_agg", "q_stream_latest_segment"])
def test_registered_streams_keep_bounded_state(name):
    import inspect

    text = inspect.getsource(getattr(q_io, name)) + inspect.getsource(q_io.run_latest) + inspect.getsource(q_io.run_appending)
    assert "complete" not in text and "3650" not in text


def test_all_cores_write_the_messages_and_two_triggers_read_them(spark):
    from pathlib import Path
    from types import SimpleNamespace

    events = spark.range(400).selectExpr("id AS event_id", "id % 20 AS user_id", "timestamp_ntz '2024-01-05' + make_dt_interval(0, 0, int(id)) AS ts", "'view' AS event_type", "double(id % 50) AS value")
    from roadlens.plans.views import VIEW_SQL
    path = q_io._write_messages(spark, SimpleNamespace(traffic_obs=spark.sql(VIEW_SQL["traffic_obs"], events=events)), "many_files")
    files = [f for f in Path(path.removeprefix("file:")).glob("part-*")]
    assert len(files) == 2 * q_io._trigger_files(spark) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
