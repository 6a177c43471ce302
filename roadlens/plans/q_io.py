"""Registered queries: sources, sinks and streaming, each writing the driver's rows to a fresh
folder under the shared checkpoint location and reading them back through the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources import snapshots as SN
from ..streaming import ingest as ST
from . import common as K
from .registry import oracle, register, round_sql, stage


def _lines(df, path, extra=("{not json", "")):
    """Write rows as JSON lines plus a malformed and a blank line."""
    spark = df.sparkSession
    bad = spark.createDataFrame([(x,) for x in extra], "value string")
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).unionByName(bad).write.mode("overwrite").text(path)


@register("read_traffic_jsonl", round_sql(oracle(
    "SELECT event_id, city, segment_id, event_time, currentSpeed, jamFactor FROM traffic_obs", "traffic_obs"), ["currentSpeed", "jamFactor"]))
def q_read_traffic_jsonl(spark, sf):
    t = K.tables(spark, sf)
    path = SK.scratch_dir(spark, "traffic_jsonl")
    _lines(t.traffic_obs.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), path)
    r = RD.read_traffic_jsonl(spark, path)
    return K.rounded(r.select("event_id", "city", "segment_id", F.to_timestamp("event_time").cast("timestamp_ntz").alias("event_time"),
                              "currentSpeed", "jamFactor"))


@register("read_weather_jsonl", round_sql(oracle("SELECT event_id, city, weather_cell_id, temp, rain_1h FROM weather_obs", "weather_obs"),
                                          ["temp", "rain_1h"]))
def q_read_weather_jsonl(spark, sf):
    t = K.tables(spark, sf)
    path = SK.scratch_dir(spark, "weather_jsonl")
    _lines(t.weather_obs.drop("event_time"), path)
    return K.rounded(RD.read_weather_jsonl(spark, path).select("event_id", "city", "weather_cell_id", "temp", "rain_1h"))


@register("read_news_jsonl", oracle("""
SELECT doc_id, title, 1 AS ord FROM news_raw
UNION ALL SELECT doc_id, title, 2 FROM news_raw WHERE doc_id % 25 = 0""", "news_raw"))
def q_read_news_jsonl(spark, sf):
    t = K.tables(spark, sf)
    n = t.news_raw.select("doc_id", "source", "external_id", "title", "summary", "source_url",
                          F.col("published_at").cast("string").alias("published_at"))
    # a line and its copy leave one task, so both are in one of the files
    line = F.to_json(F.struct(*n.columns))
    lines = n.select(F.explode(F.when(F.col("doc_id") % 25 == 0, F.array(line, line)).otherwise(F.array(line))).alias("value"))
    path = SK.scratch_dir(spark, "news_jsonl")
    lines.unionByName(spark.createDataFrame([("",)], "value string")).write.mode("overwrite").text(path)
    r = RD.read_news_jsonl(spark, path)
    # identical lines keep distinct record ids (file, line, ordinal): one row per id
    per = r.groupBy("doc_id", "title").agg(F.count_distinct("record_id").alias("n"))
    return per.select("doc_id", "title", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("ord"))


stage("dim_stamped", f"""
SELECT *, TIMESTAMP '{K.TEST_NOW}' AS _ingested_at, CAST(year(TIMESTAMP '{K.TEST_NOW}') AS INTEGER) AS _year,
  CAST(month(TIMESTAMP '{K.TEST_NOW}') AS INTEGER) AS _month, CAST(day(TIMESTAMP '{K.TEST_NOW}') AS INTEGER) AS _day FROM segment_dim""", "segment_dim")


@register("read_csv_bronze", round_sql(oracle("SELECT *, 'segment_dim_csv' AS _source FROM dim_stamped", "dim_stamped"),
                                       ["length_m", "speed_limit"]))
def q_read_csv_bronze(spark, sf):
    t = K.tables(spark, sf)
    path = SK.scratch_dir(spark, "dim_csv")
    t.segment_dim.write.mode("overwrite").option("header", True).csv(path)
    r = RD.read_csv_bronze(spark, path, "segment_dim_csv", K.TEST_NOW)
    return K.rounded(r.withColumns({"length_m": F.col("length_m").cast("double"), "speed_limit": F.col("speed_limit").cast("double"),
                                    "_year": F.col("_year").cast("int"), "_month": F.col("_month").cast("int"), "_day": F.col("_day").cast("int")}))


@register("read_parquet_bronze", round_sql(oracle("SELECT *, 'segment_dim_parquet' AS _source FROM dim_stamped", "dim_stamped"),
                                           ["length_m", "speed_limit"]))
def q_read_parquet_bronze(spark, sf):
    t = K.tables(spark, sf)
    path = SK.scratch_dir(spark, "dim_parquet")
    t.segment_dim.write.mode("overwrite").parquet(path)
    return K.rounded(RD.read_parquet_bronze(spark, path, "segment_dim_parquet", K.TEST_NOW))


@register("import_dataset", oracle("""
SELECT 'incidents' AS _source, count(*) AS rows FROM incident_obs UNION ALL SELECT 'weather', count(*) FROM weather_obs""",
                                   "incident_obs", "weather_obs"))
def q_import_dataset(spark, sf):
    t = K.tables(spark, sf)
    a, b = SK.scratch_dir(spark, "inc_csv"), SK.scratch_dir(spark, "wx_parquet")
    t.incident_obs.write.mode("overwrite").option("header", True).csv(a)
    t.weather_obs.write.mode("overwrite").parquet(b)
    got = RD.import_dataset(spark, {"incidents": {"format": "csv", "path": a}, "weather": {"format": "parquet", "path": b}}, K.TEST_NOW)
    out = None
    for df in got.values():
        one = df.groupBy("_source").agg(F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@register("load_road_edges", oracle("""
SELECT concat('hanoi_', CAST(row_number() OVER (ORDER BY segment_id) - 1 AS VARCHAR)) AS segment_id, road_class, wkt
FROM (SELECT segment_id, road_class, concat('LINESTRING (', CAST(segment_id AS VARCHAR), ')') AS wkt FROM segment_dim) x""", "segment_dim"))
def q_load_road_edges(spark, sf):
    t = K.tables(spark, sf)
    path = SK.scratch_dir(spark, "edges") + ".parquet"
    t.segment_dim.select(F.col("segment_id").alias("edge_order"), "road_class",
                         F.concat(F.lit("LINESTRING ("), F.col("segment_id"), F.lit(")")).alias("wkt")).write.mode("overwrite").parquet(path)
    r = RD.load_road_edges(spark, path, "Hanoi")
    return r.select("segment_id", "road_class", "wkt")


@register("load_percentile_lookup", round_sql(oracle(f"""
SELECT segment_id, CAST(hour_of_day AS INTEGER) AS hour_of_day, CAST(day_of_week AS INTEGER) AS day_of_week, p15, p50, p85,
  TIMESTAMP '{K.TEST_NOW}' AS _ingested_at, 'percentiles' AS _source, CAST(year(TIMESTAMP '{K.TEST_NOW}') AS INTEGER) AS _year,
  CAST(month(TIMESTAMP '{K.TEST_NOW}') AS INTEGER) AS _month, CAST(day(TIMESTAMP '{K.TEST_NOW}') AS INTEGER) AS _day FROM pct_lookup""", "pct_lookup"),
    ["p15", "p50", "p85"]))
def q_load_percentile_lookup(spark, sf):
    from ..operators import aggregates as A

    d = K.traffic_dedup(K.tables(spark, sf)).withColumns({"hour_of_day": F.hour("time_bucket"), "day_of_week": F.weekday("time_bucket")})
    return K.rounded(RD.load_percentile_lookup(A.speed_percentiles(d), "percentiles", K.TEST_NOW))


@register("read_dataset", oracle("SELECT event_id, category FROM (SELECT event_id, event_category AS category FROM incident_obs) x", "incident_obs"))
def q_read_dataset(spark, sf):
    t = K.tables(spark, sf)
    base = SK.scratch_dir(spark, "dataset")
    t.incident_obs.select("event_id", F.col("event_category").alias("category")).write.mode("overwrite").option("header", True).csv(base + ".csv")
    return RD.read_dataset(spark, base).select(F.col("event_id").cast("bigint"), "category")


# ---------------------------------------------------------------- sinks
@register("write_table", round_sql(oracle("SELECT event_id, city, temp FROM weather_obs", "weather_obs"), ["temp"]))
def q_write_table(spark, sf):
    t = K.tables(spark, sf)
    path = SK.scratch_dir(spark, "table")
    df = t.weather_obs.select("event_id", "city", "temp")
    SK.write_table(df.filter(F.col("event_id") % 2 == 0), path, "overwrite", ["city"])
    SK.write_table(df.filter(F.col("event_id") % 2 == 1), path, "append", ["city"])
    SK.write_table(df, path, "ignore", ["city"])
    return K.rounded(spark.read.parquet(path).select("event_id", "city", "temp"))


@register("write_dual_format", oracle("SELECT event_id, city, event_category FROM incident_obs UNION ALL SELECT event_id, city, event_category FROM incident_obs",
                                      "incident_obs"))
def q_write_dual_format(spark, sf):
    t = K.tables(spark, sf)
    base = SK.scratch_dir(spark, "dual")
    pq, csv = SK.write_dual_format(t.incident_obs.select("event_id", "city", "event_category"), base)
    a = spark.read.parquet(pq)
    b = spark.read.option("header", True).csv(csv).select(F.col("event_id").cast("bigint"), "city", "event_category")
    return a.unionByName(b)


@register("write_partitioned", oracle("SELECT city, date, count(*) AS rows FROM silver_traffic GROUP BY city, date", "silver_traffic"))
def q_write_partitioned(spark, sf):
    t = K.tables(spark, sf)
    path = SK.scratch_dir(spark, "partitioned")
    SK.write_partitioned(K.silver_traffic(t).select("event_id", "city", "date", "currentSpeed"), path)
    r = spark.read.parquet(path)
    return r.groupBy("city", F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("rows"))


@register("upsert", round_sql(oracle("""
SELECT segment_id, district, speed_limit FROM segment_dim
WHERE CAST(substr(segment_id, 5) AS INTEGER) % 2 = 0 AND CAST(substr(segment_id, 5) AS INTEGER) % 3 <> 0
UNION ALL SELECT segment_id, district, coalesce(speed_limit, 0e0) + 1 FROM segment_dim WHERE CAST(substr(segment_id, 5) AS INTEGER) % 3 = 0""",
    "segment_dim"), ["speed_limit"]))
def q_upsert(spark, sf):
    t = K.tables(spark, sf)
    num = F.substring("segment_id", 5, 12).cast("int")
    dim = t.segment_dim.select("segment_id", "district", "speed_limit")
    path = SK.scratch_dir(spark, "upsert_target")
    SN.create_snapshot_table(dim.filter(num % 2 == 0), path, ["segment_id"])
    src = dim.filter(num % 3 == 0).withColumn("speed_limit", F.coalesce(F.col("speed_limit"), F.lit(0.0)) + 1)
    SN.upsert_snapshot(src, path)
    return K.rounded(SN.read_snapshot(spark, path))


@register("load_stamps", oracle(f"""
SELECT event_id, TIMESTAMP '{K.TEST_NOW}' AS _ingested_at, 'weather' AS _source, 2024 AS _year, 1 AS _month, 31 AS _day FROM weather_obs""",
                                "weather_obs"))
def q_load_stamps(spark, sf):
    return SK.load_stamps(K.tables(spark, sf).weather_obs.select("event_id"), "weather", K.TEST_NOW)


@register("run_manifest", oracle("""
SELECT 'silver_traffic' AS stage, 'success' AS status, count(*) AS rows FROM silver_traffic
UNION ALL SELECT 'silver_weather', 'success', count(*) FROM silver_weather""", "silver_traffic", "silver_weather"))
def q_run_manifest(spark, sf):
    t = K.tables(spark, sf)
    a, b = SK.scratch_dir(spark, "m_traffic"), SK.scratch_dir(spark, "m_weather")
    stages = [("silver_traffic", lambda: (K.silver_traffic(t), lambda d: d.write.mode("overwrite").parquet(a))),
              ("silver_weather", lambda: (K.silver_weather(t), lambda d: d.write.mode("overwrite").parquet(b)))]
    return SK.run_manifest(spark, stages).select("stage", "status", "rows")


# ---------------------------------------------------------------- streaming
def _messages(t):
    """Kafka-shaped traffic messages from the view: ISO time, string numbers, one injected invalid
    message every 101 ids and a repeated message every 53 ids."""
    o = t.traffic_obs
    bad = F.col("event_id") % 101 == 0
    m = o.select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), F.lit("run_1").alias("run_id"), "city", "segment_id",
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_time"),
        F.when(bad, F.lit("-999")).otherwise(F.col("currentSpeed").cast("string")).alias("currentSpeed"),
        F.col("freeFlowSpeed").cast("string").alias("freeFlowSpeed"),
        F.when(bad, F.lit("99")).otherwise(K.fix_digits("jamFactor", 3).cast("string")).alias("jamFactor"), "event_id")
    return m.unionByName(m.filter(F.col("event_id") % 53 == 0))


stage("msgs", """
SELECT concat('m', CAST(event_id AS VARCHAR)) AS message_id, city, segment_id, event_time, event_id,
  CASE WHEN event_id % 101 = 0 THEN -999e0 ELSE currentSpeed END AS speed,
  CASE WHEN event_id % 101 = 0 THEN 99e0 ELSE floor(jamFactor * 1e3 + 5e-1) / 1e3 END AS jam, freeFlowSpeed AS free
FROM traffic_obs
UNION ALL SELECT concat('m', CAST(event_id AS VARCHAR)), city, segment_id, event_time, event_id,
  CASE WHEN event_id % 101 = 0 THEN -999e0 ELSE currentSpeed END,
  CASE WHEN event_id % 101 = 0 THEN 99e0 ELSE floor(jamFactor * 1e3 + 5e-1) / 1e3 END, freeFlowSpeed
FROM traffic_obs WHERE event_id % 53 = 0""", "traffic_obs")
stage("msgs_checked", """
SELECT *, error <> 'ok' AS bad FROM (SELECT *, CASE WHEN city IS NULL OR segment_id IS NULL OR speed IS NULL OR jam IS NULL
    THEN concat('missing=[', array_to_string(list_transform(list_filter([CASE WHEN city IS NULL THEN 'city' END,
      CASE WHEN segment_id IS NULL THEN 'segment_id' END, CASE WHEN speed IS NULL THEN 'currentSpeed' END,
      CASE WHEN jam IS NULL THEN 'jamFactor' END], lambda x: x IS NOT NULL), lambda x: concat(chr(39), x, chr(39))), ', '), ']')
  WHEN NOT (speed BETWEEN 0 AND 150 AND free BETWEEN 1 AND 180 AND jam BETWEEN 0 AND 10) THEN 'traffic numeric range invalid'
  ELSE 'ok' END AS error FROM msgs) x""", "msgs")


def _trigger_files(spark) -> int:
    """Message files per trigger: as many as a shuffle has tasks, so all cores write them."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _write_messages(spark, t, name):
    path = SK.scratch_dir(spark, name)
    m = _messages(t).drop("event_id")
    m.select(F.to_json(F.struct(*m.columns)).alias("value")).repartition(2 * _trigger_files(spark)).write.mode("overwrite").text(path)
    return path


def _stream(spark, t, name):
    """The messages as a stream of two triggers."""
    src_path = _write_messages(spark, t, name)
    return spark.readStream.schema(ST.TOPIC_SCHEMAS["traffic"]).option("maxFilesPerTrigger", _trigger_files(spark)).json(src_path)


def _run(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_bronze_stream(spark, t, metrics=None):
    bronze, dlq, ckpt = SK.scratch_dir(spark, "s_bronze"), SK.scratch_dir(spark, "s_dlq"), SK.scratch_dir(spark, "s_ckpt")
    s = ST.stream_validate(ST.stream_normalize(ST.stream_run_filter(_stream(spark, t, "s_src"), "run_1")))
    q = s.writeStream.foreachBatch(ST.route_to_sinks(bronze, dlq, metrics)).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    _run(q)
    return spark.read.parquet(bronze), spark.read.parquet(dlq)


@register("stream_to_bronze", round_sql(oracle("""
SELECT message_id, segment_id, event_time AS event_ts, speed AS currentSpeed FROM msgs_checked WHERE NOT bad""", "msgs_checked"),
    ["currentSpeed"]))
def q_stream_to_bronze(spark, sf):
    b, _ = run_bronze_stream(spark, K.tables(spark, sf))
    return K.rounded(b.select("message_id", "segment_id", "event_ts", F.col("currentSpeed").cast("double").alias("currentSpeed")))


@register("stream_route_dlq", oracle("""
SELECT message_id, error FROM msgs_checked WHERE bad""", "msgs_checked"))
def q_stream_route_dlq(spark, sf):
    _, d = run_bronze_stream(spark, K.tables(spark, sf))
    return d.select("message_id", "error")


@register("stream_validate", oracle("""
SELECT message_id, NOT bad AS is_valid FROM msgs_checked""", "msgs_checked"))
def q_stream_validate(spark, sf):
    m = _messages(K.tables(spark, sf)).drop("event_id")
    return ST.stream_validate(ST.stream_normalize(m)).select("message_id", "is_valid")


@register("stream_normalize", oracle("SELECT message_id, event_time AS event_ts, city, segment_id FROM msgs", "msgs"))
def q_stream_normalize(spark, sf):
    m = _messages(K.tables(spark, sf)).drop("event_id")
    return ST.stream_normalize(m).select("message_id", "event_ts", "city", "segment_id")


@register("stream_run_filter", oracle("SELECT message_id FROM msgs", "msgs"))
def q_stream_run_filter(spark, sf):
    m = _messages(K.tables(spark, sf))
    other = m.withColumn("run_id", F.lit("run_0"))
    return ST.stream_run_filter(m.unionByName(other), "run_1").select("message_id")


@register("stream_kafka_source", round_sql(oracle("""
SELECT 'traffic' AS topic, CAST(event_id % 3 AS INTEGER) AS partition, event_id AS offset, segment_id AS key, message_id, speed AS currentSpeed
FROM msgs""",
    "msgs"), ["currentSpeed"]))
def q_stream_kafka_source(spark, sf):
    m = _messages(K.tables(spark, sf))
    value = F.to_json(F.struct(*[c for c in m.columns if c != "event_id"]))
    env = m.select(F.lit("traffic").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"),
                   F.col("segment_id").cast("binary").alias("key"), value.cast("binary").alias("value"))
    p = ST.parse_messages(env, "traffic")
    return K.rounded(p.select("topic", "partition", "offset", "key", "message_id", F.col("currentSpeed").cast("double").alias("currentSpeed")))


# Messages in order of arrival: four bundles by day, some messages a bundle late, every repeated message a bundle after the first.  A
# last message far ahead in time moves the watermark past everything.
WATERMARK_HOURS = 48
ARRIVAL_FILES = 4
stage("arrivals", """
SELECT *, dense_rank() OVER (ORDER BY b) AS batch FROM (
  SELECT *, least(3, (day(event_time) - 1) // 8) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END
    + CASE WHEN row_number() OVER (PARTITION BY event_id) > 1 THEN 1 ELSE 0 END AS b FROM msgs) x""", "msgs")
# the watermark that late rows of a batch are told by: that of the state let go in the batch before it
stage("late_before", f"""
SELECT x.batch, date_trunc('millisecond', max(y.event_time)) - INTERVAL {WATERMARK_HOURS} HOUR AS late
FROM (SELECT DISTINCT batch FROM arrivals) x LEFT JOIN arrivals y ON y.batch <= x.batch - 2 GROUP BY x.batch""", "arrivals")


def _arriving(spark, t, name):
    """A stream of the messages, one bundle a trigger."""
    path = SK.scratch_dir(spark, name)
    m = _messages(t)
    first = m.dropDuplicates(["event_id"])
    again = m.filter(F.col("event_id") % 53 == 0).dropDuplicates(["event_id"])
    bundle = F.least(F.lit(3), F.floor((F.dayofmonth(F.to_timestamp("event_time")) - 1) / 8)) + (F.col("event_id") % 97 == 0).cast("int")
    rows = first.withColumn("b", bundle).unionByName(again.withColumn("b", bundle + 1))
    rows = rows.select("b", F.to_json(F.struct(*[c for c in m.columns if c != "event_id"])).alias("value"))
    for b in range(6):
        part = rows.filter(F.col("b") == b)
        if not part.isEmpty():
            part.select("value").repartition(ARRIVAL_FILES).write.mode("append").text(path)
    end = F.struct(F.lit("end").alias("message_id"), F.lit("none").alias("city"), F.lit("~end").alias("segment_id"), F.lit("2030-01-01T00:00:00").alias("event_time"))
    spark.range(0, ARRIVAL_FILES, 1, ARRIVAL_FILES).select(F.to_json(end).alias("value")).write.mode("append").text(path)
    return spark.readStream.schema(ST.TOPIC_SCHEMAS["traffic"]).option("maxFilesPerTrigger", ARRIVAL_FILES).json(path)


def run_appending(df, spark, name):
    """Run an append-mode stream to its end: (what it wrote, the query)."""
    out, ckpt = SK.scratch_dir(spark, name), SK.scratch_dir(spark, name + "_ckpt")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    _run(q)
    return spark.read.parquet(out), q


@register("stream_dedup", round_sql(oracle("""
SELECT DISTINCT message_id, segment_id, speed AS currentSpeed FROM arrivals JOIN late_before USING (batch)
WHERE late IS NULL OR event_time > late""", "arrivals", "late_before"), ["currentSpeed"]))
def q_stream_dedup(spark, sf):
    t = K.tables(spark, sf)
    s = ST.stream_dedup(ST.stream_normalize(_arriving(spark, t, "s_dedup_src")).withColumn("topic", F.lit("traffic")), f"{WATERMARK_HOURS} hours")
    out, _ = run_appending(s, spark, "s_dedup")
    return K.rounded(out.filter("message_id <> 'end'").select("message_id", "segment_id", F.col("currentSpeed").cast("double").alias("currentSpeed")))


@register("stream_bucket_agg", round_sql(oracle(f"""
SELECT city, segment_id, time_bucket(INTERVAL ({K.BUCKET}) MINUTE, event_time, TIMESTAMP '1970-01-01') AS bucket_start,
  avg(speed) AS avg_speed, avg(jam) AS avg_jam, count(*) AS messages FROM arrivals JOIN late_before USING (batch)
WHERE late IS NULL OR time_bucket(INTERVAL ({K.BUCKET}) MINUTE, event_time, TIMESTAMP '1970-01-01') + INTERVAL ({K.BUCKET}) MINUTE > late
GROUP BY ALL""", "arrivals", "late_before"), ["avg_speed", "avg_jam"]))
def q_stream_bucket_agg(spark, sf):
    t = K.tables(spark, sf)
    agg = ST.bucket_means(ST.stream_normalize(_arriving(spark, t, "s_bucket_src")), K.BUCKET, f"{WATERMARK_HOURS} hours")
    out, _ = run_appending(agg, spark, "s_bucket")
    return K.rounded(out)


@register("stream_latest_segment", round_sql(oracle("""
SELECT city, segment_id, event_ts, s.speed AS currentSpeed, s.jam AS jamFactor FROM (
  SELECT city, segment_id, max(event_time) AS event_ts, arg_max(struct_pack(speed := speed, jam := jam), event_time) AS s
  FROM msgs GROUP BY city, segment_id) x""", "msgs"), ["currentSpeed", "jamFactor"]))
def q_stream_latest_segment(spark, sf):
    t = K.tables(spark, sf)
    return K.rounded(ST.latest_of_changes(run_latest(spark, _stream(spark, t, "s_latest_src"))))


def run_latest(spark, stream):
    """The changes that a stream's messages make to the latest state."""
    out, ckpt = SK.scratch_dir(spark, "s_latest"), SK.scratch_dir(spark, "s_latest_ckpt")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ST.STATE_STORE)
    try:
        q = ST.latest_state(ST.stream_normalize(stream)).writeStream.outputMode("update").foreachBatch(ST.append_each_batch(out))
        _run(q.option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out)


@register("stream_report", oracle("""
SELECT count(*) AS produced, count(*) FILTER (WHERE NOT bad) AS written, count(*) FILTER (WHERE bad) AS dlq,
  CASE WHEN count(*) = count(*) FILTER (WHERE NOT bad) + count(*) FILTER (WHERE bad) THEN 'PASS' ELSE 'FAIL' END AS status FROM msgs_checked""",
                                  "msgs_checked"))
def q_stream_report(spark, sf):
    t = K.tables(spark, sf)
    metrics = SK.scratch_dir(spark, "s_metrics")
    run_bronze_stream(spark, t, metrics)
    return ST.stream_counts(spark.read.parquet(metrics))
