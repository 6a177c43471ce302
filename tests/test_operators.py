"""Operator properties on small frames: exactness of windows and as-of joins, dedup
signatures, components, clustering, quality checks and streaming = batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from roadlens.operators import cluster as CL
from roadlens.operators import components as CC
from roadlens.operators import dedup as D
from roadlens.operators import joins as J
from roadlens.operators import quality as Q
from roadlens.operators import windows as W


def _ts(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_exact_lags_match_brute_force_on_random_gaps(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for _ in range(400):
        t += rng.choice([5, 5, 5, 10, 15, 60])
        rows.append(("hanoi", "S1" if rng.random() < 0.7 else "S2", _ts(t), float(rng.randint(5, 80)), 0.1))
    df = spark.createDataFrame(rows, "city string, segment_id string, time_bucket timestamp_ntz, currentSpeed double, congestion_ratio double")
    df = df.dropDuplicates(["city", "segment_id", "time_bucket"])
    got = {(r.segment_id, r.time_bucket): (r.speed_lag_1, r.speed_lag_3) for r in W.exact_lag_join(df, 5, 3).collect()}
    base = {(r.segment_id, r.time_bucket): r.currentSpeed for r in df.collect()}
    for (seg, ts), (l1, l3) in got.items():
        assert l1 == base.get((seg, ts - dt.timedelta(minutes=5)))
        assert l3 == base.get((seg, ts - dt.timedelta(minutes=15)))


def test_time_blocks_do_not_change_results(spark):
    rows = [("c", "S", _ts(m), float(m % 17)) for m in range(0, 3000, 5)]
    df = spark.createDataFrame(rows, "city string, segment_id string, time_bucket timestamp_ntz, currentSpeed double")
    specs = [("lag", "currentSpeed", -300), ("lead", "currentSpeed", 600)]
    small = W.exact_offsets(df, ["city", "segment_id"], "time_bucket", specs, block_s=900)
    large = W.exact_offsets(df, ["city", "segment_id"], "time_bucket", specs, block_s=10 ** 9)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_asof_never_picks_a_future_row(spark):
    rng = random.Random(7)
    traffic = spark.createDataFrame([("hanoi", "W1", _ts(rng.randint(0, 2000)), i) for i in range(200)],
                                    "city string, weather_cell_id string, time_bucket timestamp_ntz, id int")
    weather = spark.createDataFrame([("hanoi", "W1", _ts(rng.randint(0, 2000)), float(i)) for i in range(60)],
                                    "city string, weather_cell_id string, time_bucket timestamp_ntz, temp double")
    out = J.asof_backward(traffic, weather, ("city", "weather_cell_id"), 120, ["temp"], tiebreak=("weather_cell_id",))
    wx = {r.temp: r.time_bucket for r in weather.collect()}
    for r in out.collect():
        if r.temp is not None:
            assert r.asof_time <= r.time_bucket
            assert r.time_bucket - r.asof_time <= dt.timedelta(minutes=120)
            later = [t for t in wx.values() if r.asof_time < t <= r.time_bucket]
            assert not later


def test_asof_falls_back_to_city_when_cell_has_no_weather(spark):
    traffic = spark.createDataFrame([("hanoi", "NOPE", _ts(10))], "city string, weather_cell_id string, time_bucket timestamp_ntz")
    weather = spark.createDataFrame([("hanoi", "W1", _ts(0), 21.0, 50.0, 0.0, 9000.0, 1.0)],
                                    "city string, weather_cell_id string, time_bucket timestamp_ntz, temp double, humidity double, "
                                    "rain_1h double, visibility double, wind_speed double")
    r = J.asof_weather_backward(traffic, weather, 30).collect()[0]
    assert r.weather_temperature == 21.0


def test_simhash_identical_texts_and_near_pairs(spark):
    df = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "the quick brown fox jumps"), (3, "completely different words here")],
                               "doc_id long, text string")
    sh = {r.doc_id: r.simhash for r in D.simhash64(df, "doc_id", "text").collect()}
    assert sh[1] == sh[2] and sh[1] != sh[3]
    pairs = {(r.a, r.b) for r in D.simhash_near_dups(spark.createDataFrame(list(sh.items()), "doc_id long, simhash long")).collect()}
    assert (1, 2) in pairs


def test_minhash_recall_at_threshold(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(60):
        base = rng.sample(vocab, 50)
        near = base[:47] + rng.sample(vocab, 3)  # Jaccard >= 47/53 ~ 0.887
        rows += [(2 * i, base), (2 * i + 1, near)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    pairs = {(r.a, r.b) for r in D.minhash_near_dups(df, threshold=0.8).collect()}
    expected = set()
    for i in range(60):
        a, b = set(rows[2 * i][1]), set(rows[2 * i + 1][1])
        if len(a & b) / len(a | b) >= 0.8:
            expected.add((2 * i, 2 * i + 1))
    assert expected <= pairs


def test_connected_components_chain(spark):
    v = spark.createDataFrame([(i,) for i in range(10)], "id long")
    e = spark.createDataFrame([(i, i + 1) for i in range(4)] + [(6, 7)], "src long, dst long")
    comp = {r.id: r.component for r in CC.connected_components(v, e).collect()}
    assert comp[4] == 0 and comp[7] == 6 and comp[9] == 9


def test_dbscan_core_border_noise(spark):
    pts = [(f"p{i}", "hanoi", 21.0 + 0.001 * i, 105.8) for i in range(6)] + [("far", "hanoi", 22.0, 106.5)]
    df = spark.createDataFrame(pts, "segment_id string, city string, lat double, lon double")
    lab = {r.segment_id: r for r in CL.dbscan_labels(df).collect()}
    assert lab["far"].point_type == "noise" and lab["far"].cluster_id is None
    assert lab["p2"].point_type == "core" and lab["p2"].cluster_id == "p0"


def test_contract_checks_flag_problems(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 500.0)], "k string, v double")
    c = Q.Contract(name="t", required=["k", "v", "missing"], nullable={"v": False}, key=["k"], ranges={"v": (0.0, 100.0)})
    res = {r.name: r.status for r in Q.dq_run_contract(df, c).collect()}
    assert res["required_columns"] == "FAIL" and res["duplicate_key"] == "FAIL"
    assert res["v_range"] == "FAIL" and res["nullable_contract"] == "FAIL"
    assert Q.dq_rollup(Q.dq_run_contract(df, c)).collect()[0].overall == "FAIL"


def test_blocked_row_shift_equals_plain_window(spark):
    from pyspark.sql import Window

    rng = random.Random(5)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([1, 2, 30, 200, 2000])
        rows.append(("S1" if rng.random() < 0.8 else "S2", _ts(t), float(i)))
    df = spark.createDataFrame(rows, "segment_id string, timestamp timestamp_ntz, v double")
    specs = [("l1", "v", -1), ("l3", "v", -3), ("f2", "v", 2), ("f7", "v", 7)]
    got = W.blocked_row_shift(df, ["segment_id"], ["timestamp"], specs, block_s=3600)
    w = Window.partitionBy("segment_id").orderBy("timestamp")
    ref = df.select("segment_id", "timestamp", "v", F.lag("v", 1).over(w).alias("l1"), F.lag("v", 3).over(w).alias("l3"),
                    F.lead("v", 2).over(w).alias("f2"), F.lead("v", 7).over(w).alias("f7"))
    key = lambda r: (r.segment_id, r.timestamp)
    assert sorted(map(tuple, got.select(*ref.columns).collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)


def test_inversions_across_sequence_blocks(spark):
    from pyspark.sql import Window

    rng = random.Random(9)
    rows = [("S1" if rng.random() < 0.6 else "S2", i, _ts(rng.randint(0, 500)) if i % 17 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "segment_id string, ord long, ts timestamp_ntz")
    got = {r.segment_id: r.inversions for r in W.timestamp_inversions(df, ["segment_id"], "ts", "ord", block=37).collect()}
    w = Window.partitionBy("segment_id").orderBy("ord")
    ref = df.withColumn("i", (F.col("ts") < F.lag("ts").over(w)).cast("int")).groupBy("segment_id").agg(F.coalesce(F.sum("i"), F.lit(0)).alias("n"))
    assert got == {r.segment_id: r.n for r in ref.collect()}


def test_stream_bucket_means_append_mode_equals_batch(spark):
    """Watermarked tumbling means in append mode: once a far-future sentinel moves the watermark
    past every window, the emitted windows equal the batch aggregate of the same rows."""
    import uuid

    from roadlens.sources.sinks import scratch_dir
    from roadlens.streaming import ingest as ST

    rng = random.Random(2)
    msgs = [(f"m{i}", "run_1", "hanoi", f"S{i % 3}", _ts(5 * i + rng.randint(0, 4)).isoformat(), str(float(rng.randint(5, 60))), "50.0", "1.0")
            for i in range(120)]
    cols = ["message_id", "run_id", "city", "segment_id", "event_time", "currentSpeed", "freeFlowSpeed", "jamFactor"]
    src = scratch_dir(spark, "append_src")
    body = spark.createDataFrame(msgs, cols)
    body.coalesce(1).select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(src + "/a")
    sentinel = spark.createDataFrame([("end", "run_1", "hanoi", "S_END", "2100-01-01T00:00:00", "1.0", "50.0", "0.0")], cols)
    sentinel.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(src + "/b")
    out, ckpt = scratch_dir(spark, "append_out"), scratch_dir(spark, f"append_ckpt_{uuid.uuid4().hex[:6]}")
    stream = spark.readStream.schema(ST.TOPIC_SCHEMAS["traffic"]).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(src)
    q = (ST.bucket_means(ST.stream_normalize(stream), 60, "30 minutes").writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.segment_id, r.bucket_start): r.messages for r in spark.read.parquet(out).collect()}
    batch = ST.bucket_means(ST.stream_normalize(body), 60, "30 minutes")
    want = {(r.segment_id, r.bucket_start): r.messages for r in batch.collect()}
    assert got == want
