"""Structured Streaming ingestion: Kafka-shaped messages -> validated Bronze rows with a
dead-letter sink, bounded-state dedup, windowed bucket means and the live latest state.

The transforms are pure DataFrame functions (all but ``latest_state``, which keeps keyed state, work on batch and streaming frames alike);
sources and sinks are thin option maps. Without a broker here, tests feed the same
transforms from a file stream with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.timefn import epoch_micros

def _message(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _typed(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


_S, _I, _D, _B, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

# Messages as producers send them: all text, typed by the checks.
RAW_SCHEMAS = {
    "traffic": _message("message_id", "run_id", "city", "segment_id", "id", "event_time", "timestamp", "currentSpeed", "freeFlowSpeed", "jamFactor"),
    "weather": _message("message_id", "run_id", "city", "weather_cell_id", "cell_id", "event_time", "timestamp", "temp", "humidity", "rain_1h", "wind_speed"),
    "news": _message("message_id", "run_id", "city", "event_id", "url", "title", "event_time", "timestamp", "published_at_utc", "summary"),
}
TOPIC_SCHEMAS = RAW_SCHEMAS
# Fields of the topics that are loaded into Bronze as they come.
BRONZE_TOPIC_SCHEMAS = {
    "events.news": _typed(
        event_id=_S, source=_S, source_url=_S, crawled_at=_TS, published_at=_TS, title=_S, content=_S, event_type=_S, severity=_I, location_entity=_S,
        lat=_D, lon=_D, snapped_segment_id=_S, snap_distance_m=_D, event_confidence=_D, city=_S, mirrored_sources=_S, raw_html_path=_S),
    "traffic.realtime.tomtom": _typed(
        segment_id=_S, current_speed=_D, free_flow_speed=_D, jam_factor=_D, congestion_ratio=_D, confidence=_D, latitude=_D, longitude=_D,
        functional_road_class=_S, road_closure=_B, source=_S, timestamp=_S),
    "weather.current": _typed(
        city=_S, latitude=_D, longitude=_D, temperature=_D, feels_like=_D, humidity=_I, pressure=_I, visibility=_I, wind_speed=_D, wind_degree=_I,
        rain_1h=_D, rain_3h=_D, cloudiness=_I, description=_S, weather_main=_S, source=_S, timestamp=_S),
}
# Bronze table of a topic, required fields and the default city of a message.
TOPIC_TABLES = {"events.news": "bronze_events_raw", "traffic.realtime.tomtom": "bronze_traffic_raw", "weather.current": "bronze_weather_raw"}
REQUIRED_FIELDS = {
    "traffic": ("city", "segment_id", "currentSpeed", "freeFlowSpeed", "jamFactor"),
    "weather": ("city", "weather_cell_id"),
    "news": ("city",),
}
DEFAULT_CITY = "hanoi"
# The id of a message's subject, and what stands in for it, in order.
ENTITY = {"traffic": ("segment_id", ("id",)), "weather": ("weather_cell_id", ("cell_id", "city")), "news": ("event_id", ("url", "title"))}


def bronze_table(topic: str) -> str:
    return TOPIC_TABLES.get(topic, f"bronze_{topic.replace('.', '_')}_raw")


def load_stamped(df: DataFrame, topic: str) -> DataFrame:
    """Kafka envelope -> the topic's Bronze columns with load stamps and day parts (for partitioned writes)."""
    now = F.current_timestamp()
    rows = df.filter(F.col("topic") == topic).select(F.from_json(F.col("value").cast("string"), BRONZE_TOPIC_SCHEMAS[topic]).alias("m")).select("m.*")
    return rows.withColumns({"_ingested_at": now, "_source": F.col("source"), "_year": F.year(now), "_month": F.month(now), "_day": F.dayofmonth(now)})


def route_topics(base: str):
    """foreachBatch writer of a subscription to several topics: each topic's rows are appended to its own Bronze table
    under ``base``, by day; a replayed batch replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for topic in BRONZE_TOPIC_SCHEMAS:
            rows = load_stamped(batch, topic).withColumn("_batch_id", F.lit(batch_id))
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_year", "_month", "_day", "_batch_id")
             .parquet(f"{base}/{bronze_table(topic)}"))
        batch.unpersist()

    return write


def kafka_source(spark: SparkSession, servers: str, topics: str, max_offsets: int = 10_000) -> DataFrame:
    """Kafka subscription with latest offsets and at most ``max_offsets`` per trigger
    (needs the Kafka connector on the classpath)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
            .option("startingOffsets", "latest").option("maxOffsetsPerTrigger", max_offsets).load())


def parse_messages(df: DataFrame, topic: str) -> DataFrame:
    """Kafka envelope (topic, partition, offset, key, value) -> typed message columns."""
    body = F.from_json(F.col("value").cast("string"), TOPIC_SCHEMAS[topic])
    return df.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), body.alias("m")).select(
        "topic", "partition", "offset", "key", "m.*")


def stream_normalize(df: DataFrame, topic: str = "traffic") -> DataFrame:
    """Event time as UTC wall clock (``event_ts``, plus ``_wm_ts`` typed for watermarks), from the first
    time field that is there; default city; the subject's id, or what stands in for it, or the message's own id."""
    times = [F.col(c) for c in ("event_time", "timestamp", "published_at_utc") if c in df.columns]
    ts = F.try_to_timestamp(F.coalesce(*times))
    entity, others = ENTITY[topic]
    given = [F.col(c) for c in (entity, *others) if c in df.columns]
    own = [F.concat(F.lit(topic + "-"), F.col("message_id"))] if "message_id" in df.columns else []
    city = F.lower(F.trim(F.col("city")))
    return df.withColumns({
        "event_ts": ts.cast("timestamp_ntz"), "_wm_ts": ts,
        "city": F.coalesce(city, F.lit(DEFAULT_CITY)),
        entity: F.coalesce(*given, *own),
    })


def stream_validate(df: DataFrame, topic: str = "traffic") -> DataFrame:
    """Required fields of the topic and, for traffic, numeric castability and ranges (speed 0-150, free flow 1-180,
    jam 0-10) -> ``is_valid`` and the first failing reason."""
    miss = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in REQUIRED_FIELDS[topic]]))
    error = F.when(F.size(miss) > 0, F.concat(F.lit("missing=["), F.array_join(F.transform(miss, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")))
    if topic == "traffic":
        nums = {c: F.col(c).try_cast("double") for c in ("currentSpeed", "freeFlowSpeed", "jamFactor")}
        not_num = F.exists(F.array(*[nums[c].isNull() for c in nums]), lambda x: x)
        out_of_range = ~(nums["currentSpeed"].between(0, 150) & nums["freeFlowSpeed"].between(1, 180) & nums["jamFactor"].between(0, 10))
        error = error.when(not_num, F.lit("numeric traffic fields invalid")).when(out_of_range, F.lit("traffic numeric range invalid"))
    return df.withColumns({"is_valid": error.isNull(), "error": F.coalesce(error, F.lit("ok"))})


def message_key(topic: str = "topic", entity: str = "segment_id", ts: str = "event_time") -> Column:
    return F.sha1(F.concat_ws("|", F.col(topic), F.col(entity), F.col(ts)))


def stream_dedup(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First message per sha1(topic, entity, time); a key is let go ``delay`` after its event time, and a message that comes later
    than that is dropped as late (append mode)."""
    return df.withColumn("dedup_key", message_key()).withWatermark("_wm_ts", delay).dropDuplicatesWithinWatermark(["dedup_key"])


def stream_run_filter(df: DataFrame, run_id: str) -> DataFrame:
    return df.filter(F.col("run_id") == run_id)


def bronze_envelope(df: DataFrame, batch_id: int) -> DataFrame:
    day = F.to_date("event_ts")
    return df.withColumns({"_batch_id": F.lit(batch_id), "_date": day, "_year": F.year(day), "_month": F.month(day), "_day": F.dayofmonth(day)})


def route_to_sinks(bronze_path: str, dlq_path: str, metrics_path: str | None = None):
    """foreachBatch writer: valid rows -> Bronze by day of the event, invalid -> DLQ with the error. Each batch
    overwrites its own ``_batch_id`` partitions, so a replayed batch is idempotent.  With ``metrics_path`` the rows that came in and
    those that each writer wrote are observed while they pass, and kept as one row per batch: ``stream_counts`` reads these."""

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = {name: Observation() for name in ("produced", "written", "dlq")}
        one = F.count(F.lit(1)).alias("n")
        batch = bronze_envelope(batch.drop("_wm_ts"), batch_id).observe(seen["produced"], one).persist()
        (batch.filter("is_valid").drop("is_valid", "error").observe(seen["written"], one).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_year", "_month", "_day", "_batch_id").parquet(bronze_path))
        (batch.filter("NOT is_valid").observe(seen["dlq"], one).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch_id").parquet(dlq_path))
        if metrics_path is not None:
            counts = tuple(seen[k].get["n"] for k in seen)
            row = batch.sparkSession.createDataFrame([(batch_id, *counts)], "_batch_id long, produced long, written long, dlq long")
            row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(metrics_path)
        batch.unpersist()

    return write


def stream_counts(metrics: DataFrame) -> DataFrame:
    """(produced, written, dlq, status) of a stream from the counts that its batches observed; the sinks are not read."""
    total = metrics.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("produced", "written", "dlq")])
    return total.withColumn("status", F.when(F.col("produced") == F.col("written") + F.col("dlq"), "PASS").otherwise("FAIL"))


def bucket_means(df: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Tumbling ``minutes`` means per segment, append mode: a window is emitted, and its state let go, once the watermark passes its
    end; rows that come for a window gone by are dropped and counted by the query's progress."""
    return (df.withWatermark("_wm_ts", delay)
            .groupBy("city", "segment_id", F.window("_wm_ts", f"{minutes} minutes").alias("w"))
            .agg(F.avg(F.col("currentSpeed").try_cast("double")).alias("avg_speed"),
                 F.avg(F.col("jamFactor").try_cast("double")).alias("avg_jam"), F.count(F.lit(1)).alias("messages"))
            .select("city", "segment_id", F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "avg_speed", "avg_jam", "messages"))


_LATEST_STATE = "us long, speed double, jam double"
_LATEST_ROW = "city string, segment_id string, us long, currentSpeed double, jamFactor double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestProcessor(StatefulProcessor):
    """Keeps the newest message of a segment.  A message that is not newer than the state changes nothing and is not emitted; a state
    that gets no update for ``ttl_ms`` goes (0: never)."""

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", _LATEST_STATE, self.ttl_ms or None)

    def handleInputRows(self, key, rows, timer_values):
        before = self.newest.get()
        best = before
        for part in rows:
            us = part["us"].to_numpy()
            at = int(us.argmax())
            if best is None or us[at] > best[0]:
                best = (int(us[at]), part["speed"].iat[at], part["jam"].iat[at])
        if best is not before:
            best = tuple(None if v != v else v for v in best)  # NaN stands for null
            self.newest.update(best)
            speed, jam = (np.array([v], "float64") for v in best[1:])
            yield pd.DataFrame({"city": [key[0]], "segment_id": [key[1]], "us": [best[0]], "currentSpeed": speed, "jamFactor": jam})

    def close(self) -> None:
        pass


def latest_state(df: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Newest message per segment as keyed state (update mode): every trigger emits the segments that changed, nothing else.
    The session needs a state store with column families (``STATE_STORE``).  Rows without an event time are left out."""
    rows = df.filter("event_ts IS NOT NULL").select(
        "city", "segment_id", epoch_micros("event_ts").alias("us"), F.col("currentSpeed").try_cast("double").alias("speed"), F.col("jamFactor").try_cast("double").alias("jam"))
    out = rows.groupBy("city", "segment_id").transformWithStateInPandas(LatestProcessor(ttl_ms), _LATEST_ROW, "Update", "ProcessingTime" if ttl_ms else "None")
    return out.select("city", "segment_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("event_ts"), "currentSpeed", "jamFactor")


def append_each_batch(path: str):
    """foreachBatch writer of changes: every batch writes its own partition, so a replayed batch is idempotent and earlier
    batches are not touched."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch_id").parquet(path)

    return write


def latest_of_changes(changes: DataFrame) -> DataFrame:
    """The table that the changes of ``latest_state`` lead to: each segment's last change."""
    last = changes.groupBy("city", "segment_id").agg(F.max_by(F.struct("event_ts", "currentSpeed", "jamFactor"), "_batch_id").alias("s"))
    return last.select("city", "segment_id", "s.*")
