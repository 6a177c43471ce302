"""Registered queries: weather as-of joins and weather features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from . import common as K
from .registry import oracle, register, round_sql, stage

TOL = max(6 * K.BUCKET, 30)
WCOLS = ["weather_temperature", "weather_humidity", "weather_rain_1h", "weather_visibility", "weather_wind_speed"]

stage("asof_probe", """
SELECT d.*, CASE WHEN c.weather_cell_id IS NOT NULL THEN d.weather_cell_id END AS k
FROM traffic_dedup d LEFT JOIN (SELECT DISTINCT city, weather_cell_id FROM weather_dedup) c
  ON c.city = d.city AND c.weather_cell_id = d.weather_cell_id
""", "traffic_dedup", "weather_dedup")

stage("asof_match", f"""
SELECT p.city, p.segment_id, p.time_bucket,
  arg_max(struct_pack(temp := w.temp, humidity := w.humidity, rain := w.rain_1h, vis := w.visibility, wind := w.wind_speed),
          struct_pack(t := w.time_bucket, c := w.weather_cell_id)) AS s
FROM asof_probe p JOIN weather_dedup w ON w.city = p.city AND (p.k IS NULL OR w.weather_cell_id = p.k)
  AND w.time_bucket <= p.time_bucket AND w.time_bucket >= p.time_bucket - INTERVAL ({TOL}) MINUTE
GROUP BY p.city, p.segment_id, p.time_bucket
""", "asof_probe", "weather_dedup")

stage("asof_weather", """
SELECT *, CAST(coalesce(weather_rain_1h, 0e0) > 1e-1 AS INTEGER) AS has_rain,
  CASE WHEN coalesce(weather_visibility, 1e4) < 1000 THEN 3 WHEN coalesce(weather_rain_1h, 0e0) > 10 THEN 2
       WHEN coalesce(weather_rain_1h, 0e0) > 1e-1 THEN 1 ELSE 0 END AS weather_severity
FROM (SELECT p.* EXCLUDE (k), m.s.temp AS weather_temperature, m.s.humidity AS weather_humidity, m.s.rain AS weather_rain_1h,
  m.s.vis AS weather_visibility, m.s.wind AS weather_wind_speed
  FROM asof_probe p LEFT JOIN asof_match m USING (city, segment_id, time_bucket)) x
""", "asof_probe", "asof_match")


def asof_weather(t):
    return J.asof_weather_backward(K.traffic_dedup(t), K.weather_dedup(t), TOL)


ASOF_OUT = ["city", "segment_id", "time_bucket", *WCOLS, "has_rain", "weather_severity"]


@register("asof_weather_backward", round_sql(oracle(f"SELECT {', '.join(ASOF_OUT)} FROM asof_weather", "asof_weather"), WCOLS))
def q_asof_weather_backward(spark, sf):
    return K.rounded(asof_weather(K.tables(spark, sf)).select(*ASOF_OUT))


@register("asof_weather_nearest", round_sql(oracle("""
SELECT event_id, city, segment_id, timestamp, s.cell AS matched_cell_id, s.temp AS temp, s.wt AS weather_event_time,
  abs(epoch_us(timestamp) - epoch_us(s.wt)) / 6e7 AS time_diff_minutes
FROM (SELECT t.event_id, t.city, t.segment_id, t.timestamp,
        arg_min(struct_pack(cell := w.weather_cell_id, temp := w.temp, wt := w.timestamp),
                struct_pack(g := abs(epoch_us(w.timestamp) - epoch_us(t.timestamp)), wt := w.timestamp)) AS s
      FROM silver_traffic t JOIN silver_weather w ON w.city = t.city
        AND w.timestamp BETWEEN t.timestamp - INTERVAL 30 MINUTE AND t.timestamp + INTERVAL 30 MINUTE
      GROUP BY t.event_id, t.city, t.segment_id, t.timestamp) x
""", "silver_traffic", "silver_weather"), ["temp", "time_diff_minutes"]))
def q_asof_weather_nearest(spark, sf):
    t = K.tables(spark, sf)
    tr = K.silver_traffic(t).select("event_id", "city", "segment_id", "timestamp")
    out = J.asof_weather_nearest(tr, K.silver_weather(t), 30, weather_cols=("weather_cell_id", "temp"))
    return K.rounded(out.select("event_id", "city", "segment_id", "timestamp", F.col("weather_cell_id").alias("matched_cell_id"),
                                "temp", "weather_event_time", "time_diff_minutes"))


@register("join_latest_weather", round_sql(oracle("""
SELECT t.event_id, t.city, coalesce(w.s.temp, 0e0) AS weather_temperature, coalesce(w.s.humidity, 0e0) AS weather_humidity,
  coalesce(w.s.rain, 0e0) AS weather_rain_1h, coalesce(w.s.vis, 0e0) AS weather_visibility, coalesce(w.s.wind, 0e0) AS weather_wind_speed,
  CASE WHEN coalesce(w.s.rain, 0e0) > 1e-1 THEN 1 ELSE 0 END AS has_rain,
  CASE WHEN coalesce(w.s.vis, 0e0) < 1 THEN 3 WHEN coalesce(w.s.rain, 0e0) > 10 THEN 2 WHEN coalesce(w.s.rain, 0e0) > 1e-1 THEN 1 ELSE 0 END
    AS weather_severity
FROM silver_traffic t LEFT JOIN (
  SELECT city, arg_max(struct_pack(temp := temp, humidity := humidity, rain := rain_1h, vis := visibility, wind := wind_speed),
                       timestamp) AS s
  FROM silver_weather GROUP BY city) w ON w.city = t.city
""", "silver_traffic", "silver_weather"), WCOLS))
def q_join_latest_weather(spark, sf):
    t = K.tables(spark, sf)
    tr = K.silver_traffic(t).select("event_id", "city", "timestamp")
    out = J.join_latest_weather(tr, K.silver_weather(t))
    return K.rounded(out.select("event_id", "city", *WCOLS, "has_rain", "weather_severity"))
