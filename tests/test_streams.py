"""Contracts of the three topics, routing to their tables, and a restart from the checkpoint."""

import json

import pytest
from pyspark.sql import functions as F

from roadlens.sources.sinks import scratch_dir
from roadlens.streaming import ingest as ST


def frame(spark, topic, *messages):
    names = ST.RAW_SCHEMAS[topic].names
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in messages], ST.RAW_SCHEMAS[topic])


def checked(spark, topic, *messages):
    return ST.stream_validate(ST.stream_normalize(frame(spark, topic, *messages), topic), topic).orderBy("message_id").collect()


def test_traffic_contract(spark):
    good = {"message_id": "1", "city": "hanoi", "segment_id": "HN_001", "currentSpeed": "30", "freeFlowSpeed": "45", "jamFactor": "2.5"}
    rows = checked(spark, "traffic", good, {**good, "message_id": "2", "currentSpeed": "-5", "jamFactor": "12"}, {**good, "message_id": "3", "jamFactor": "much"},
                   {**good, "message_id": "4", "segment_id": None, "id": "x", "city": None}, {**good, "message_id": "5", "freeFlowSpeed": None})
    assert [r.error for r in rows] == ["ok", "traffic numeric range invalid", "numeric traffic fields invalid", "ok", "missing=['freeFlowSpeed']"]
    assert (rows[3].segment_id, rows[3].city) == ("x", "hanoi")


def test_weather_and_news_contracts(spark):
    rows = checked(spark, "weather", {"message_id": "1", "cell_id": "W_3", "timestamp": "2024-01-01T08:00:00Z"}, {"message_id": "2", "city": " HCMC "})
    assert [(r.weather_cell_id, r.city, r.error) for r in rows] == [("W_3", "hanoi", "ok"), (" HCMC ", "hcmc", "ok")]
    assert str(rows[0].event_ts) == "2024-01-01 08:00:00"
    rows = checked(spark, "news", {"message_id": "1", "url": "https://a/b", "title": "t", "published_at_utc": "2024-01-02T00:00:00Z"}, {"message_id": "2", "city": ""})
    assert (rows[0].event_id, rows[0].is_valid) == ("https://a/b", True) and str(rows[0].event_ts) == "2024-01-02 00:00:00"
    assert (rows[1].event_id, rows[1].error) == ("news-2", "missing=['city']")


def test_topic_tables():
    assert ST.bronze_table("events.news") == "bronze_events_raw" and ST.bronze_table("x.y") == "bronze_x_y_raw"
    assert [len(s) for s in ST.BRONZE_TOPIC_SCHEMAS.values()] == [18, 12, 17]


ENVELOPE = "topic string, value string"


def test_routing_by_topic_and_restart(spark):
    src, out, ckpt = (scratch_dir(spark, n) for n in ("route_src", "route_out", "route_ckpt"))
    news = {"event_id": "e1", "source": "s", "crawled_at": "2024-01-01T00:00:00Z", "title": "t", "severity": 2, "lat": 21.0}
    traffic = {"segment_id": "S1", "current_speed": 31.5, "road_closure": True, "source": "p", "timestamp": "2024-01-01"}
    weather = {"city": "hanoi", "humidity": 80, "rain_1h": 0.5, "source": "w", "timestamp": "2024-01-01"}
    batch = [("events.news", json.dumps(news)), ("traffic.realtime.tomtom", json.dumps(traffic)), ("weather.current", json.dumps(weather)), ("other", "{}")]

    def run():
        q = spark.readStream.schema(ENVELOPE).json(src).writeStream.foreachBatch(ST.route_topics(out)).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    spark.createDataFrame(batch, ENVELOPE).write.json(src)
    run()
    spark.createDataFrame(batch[1:2] * 3, ENVELOPE).write.mode("append").json(src)
    run()  # goes on from the checkpoint: the first files are not read again
    counts = {t: spark.read.parquet(f"{out}/{t}").count() for t in ST.TOPIC_TABLES.values()}
    assert counts == {"bronze_events_raw": 1, "bronze_traffic_raw": 4, "bronze_weather_raw": 1}
    row = spark.read.parquet(f"{out}/bronze_traffic_raw").first()
    assert (row.segment_id, row.current_speed, row.road_closure, row._source) == ("S1", 31.5, True, "p") and row._year >= 2024 and row._ingested_at is not None
