"""Registered queries: event range joins, baseline percentiles and the Gold build."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefn as T
from ..operators import aggregates as A
from ..operators import events as EV
from . import common as K
from .gold import gold_features
from .q_joins import TOL, asof_weather
from .registry import oracle, register, round_sql, stage

_ACTIVE = ", ".join(f"'{c}'" for c in EV.ACTIVE_CATEGORIES)
stage("event_rel", f"""
SELECT * FROM incident_obs WHERE city IS NOT NULL AND event_category IN ({_ACTIVE}) AND traffic_relevance_score >= 55e-2
""", "incident_obs")


def _w(h):
    return f"e.event_time >= b.time_bucket - INTERVAL {h} HOUR"


stage("event_feats", f"""
SELECT *, CAST(accident_count_1h > 0 AS INTEGER) AS has_recent_accident, CAST(roadwork_count_24h > 0 AS INTEGER) AS has_recent_roadwork,
  CAST(flood_count_6h > 0 AS INTEGER) AS has_recent_flood, CAST(max_event_severity_6h >= 4 AS INTEGER) AS has_major_event,
  CAST(weather_disruption_count_6h > 0 AS INTEGER) AS has_weather_disruption
FROM (
SELECT b.city, b.time_bucket,
  count(*) FILTER (WHERE {_w(1)}) AS news_event_count_1h,
  count(*) FILTER (WHERE {_w(3)}) AS news_event_count_3h,
  count(*) FILTER (WHERE {_w(6)}) AS news_event_count_6h,
  count(*) FILTER (WHERE {_w(1)} AND e.event_category = 'accident') AS accident_count_1h,
  count(*) FILTER (WHERE {_w(1)} AND e.event_category = 'congestion') AS congestion_news_count_1h,
  count(*) FILTER (WHERE {_w(24)} AND e.event_category IN ('roadwork_active', 'roadwork_planned')) AS roadwork_count_24h,
  count(*) FILTER (WHERE {_w(6)} AND e.event_category IN ('weather_disruption', 'flood')) AS weather_disruption_count_6h,
  count(*) FILTER (WHERE {_w(6)} AND e.event_category = 'flood') AS flood_count_6h,
  coalesce(max(e.severity_score) FILTER (WHERE {_w(1)}), 0) AS max_event_severity_1h,
  coalesce(max(e.severity_score) FILTER (WHERE {_w(6)}), 0) AS max_event_severity_6h,
  coalesce(avg(e.traffic_relevance_score) FILTER (WHERE {_w(6)}), 0e0) AS avg_traffic_relevance_score_6h
FROM (SELECT DISTINCT city, time_bucket FROM traffic_dedup) b
LEFT JOIN event_rel e ON e.city = b.city AND e.event_time <= b.time_bucket AND e.event_time >= b.time_bucket - INTERVAL 24 HOUR
GROUP BY b.city, b.time_bucket) x
""", "traffic_dedup", "event_rel")

EVENT_OUT = ["city", "segment_id", "time_bucket", *EV.EVENT_FEATURES]


@register("event_grid_join", round_sql(oracle(f"""
SELECT {', '.join(EVENT_OUT)} FROM (SELECT DISTINCT city, segment_id, time_bucket FROM traffic_dedup) g
JOIN event_feats USING (city, time_bucket)""", "traffic_dedup", "event_feats"), ["avg_traffic_relevance_score_6h"]))
def q_event_grid_join(spark, sf):
    t = K.tables(spark, sf)
    return K.rounded(EV.event_grid_join(K.traffic_dedup(t), t.incident_obs).select(*EVENT_OUT))


_KINDS = {"accident": "('accident')", "flood": "('flood')", "roadwork": "('roadwork', 'road_work', 'roadwork_active')",
          "event": "('event', 'planned_event')"}


def _interval_sql():
    cols = []
    for k, cats in _KINDS.items():
        cols.append(f"CAST(count(*) FILTER (WHERE e.event_category IN {cats}) > 0 AS INTEGER) AS has_{k}")
        cols.append(f"CAST(coalesce(max(e.severity_score) FILTER (WHERE e.event_category IN {cats}), 0) AS INTEGER) AS max_{k}_severity_1h")
    return f"""
SELECT *, greatest(has_accident, has_flood, has_roadwork, has_event) AS has_any_event FROM (
SELECT t.event_id, t.city, {', '.join(cols)}
FROM silver_traffic t LEFT JOIN incident_obs e ON e.city = t.city AND e.event_time <= t.timestamp
  AND e.event_time >= t.timestamp - INTERVAL 60 MINUTE
GROUP BY t.event_id, t.city) x"""


@register("event_interval_join", oracle(_interval_sql(), "silver_traffic", "incident_obs"))
def q_event_interval_join(spark, sf):
    t = K.tables(spark, sf)
    tr = K.silver_traffic(t).select("event_id", "city", "timestamp")
    out = EV.event_interval_join(tr, t.incident_obs, 60)
    kinds = ("accident", "flood", "roadwork", "event")
    return out.select("event_id", "city", *[c for k in kinds for c in (f"has_{k}", f"max_{k}_severity_1h")], "has_any_event")


# ---------------------------------------------------------------- percentiles / baseline
stage("pct_lookup", """
SELECT city, segment_id, CAST(hour(time_bucket) AS INTEGER) AS hour_of_day, CAST(isodow(time_bucket) - 1 AS INTEGER) AS day_of_week,
  quantile_cont(currentSpeed, 0.15) AS p15, quantile_cont(currentSpeed, 0.5) AS p50, quantile_cont(currentSpeed, 0.85) AS p85
FROM traffic_dedup GROUP BY ALL
""", "traffic_dedup")


def _dedup_with_time(t):
    d = K.traffic_dedup(t)
    return d.withColumns({"hour_of_day": F.hour("time_bucket"), "day_of_week": F.weekday("time_bucket")})


@register("speed_percentiles", round_sql(oracle("SELECT * FROM pct_lookup", "pct_lookup"), ["p15", "p50", "p85"]))
def q_speed_percentiles(spark, sf):
    return K.rounded(A.speed_percentiles(_dedup_with_time(K.tables(spark, sf))))


stage("baseline", """
SELECT *, CAST(is_below_p15 = 1 OR is_above_p85 = 1 AS INTEGER) AS is_anomaly_vs_baseline FROM (
SELECT city, segment_id, time_bucket, p15, p50, p85,
  least(greatest(CASE WHEN freeFlowSpeed > 0 THEN 1e0 - p50 / freeFlowSpeed ELSE 0e0 END, 0e0), 1e0) AS baseline_congestion_ratio,
  currentSpeed - p15 AS speed_vs_p15, currentSpeed - p50 AS speed_vs_p50, currentSpeed - p85 AS speed_vs_p85,
  least(greatest(CASE WHEN abs(p85 - p15) > 0 THEN (currentSpeed - p15) / (p85 - p15) ELSE 5e-1 END, 0e0), 1e0)
    AS speed_percentile_position,
  CAST(currentSpeed < p15 AS INTEGER) AS is_below_p15, CAST(currentSpeed > p85 AS INTEGER) AS is_above_p85,
  CAST(currentSpeed >= p15 AND currentSpeed <= p50 AS INTEGER) AS is_between_p15_p50
FROM (SELECT d.city, d.segment_id, d.time_bucket, d.currentSpeed, d.freeFlowSpeed,
  coalesce(l.p15, d.currentSpeed) AS p15, coalesce(l.p50, d.currentSpeed) AS p50, coalesce(l.p85, d.currentSpeed) AS p85
  FROM traffic_dedup d LEFT JOIN pct_lookup l ON l.city = d.city AND l.segment_id = d.segment_id
    AND l.hour_of_day = hour(d.time_bucket) AND l.day_of_week = isodow(d.time_bucket) - 1) j) k
""", "traffic_dedup", "pct_lookup")

BASE_OUT = ["city", "segment_id", "time_bucket", "p15", "p50", "p85", "baseline_congestion_ratio", "speed_vs_p15",
            "speed_vs_p50", "speed_vs_p85", "speed_percentile_position", "is_below_p15", "is_above_p85",
            "is_between_p15_p50", "is_anomaly_vs_baseline"]
BASE_DOUBLES = BASE_OUT[3:11]


@register("baseline_features", round_sql(oracle(f"SELECT {', '.join(BASE_OUT)} FROM baseline", "baseline"), BASE_DOUBLES))
def q_baseline_features(spark, sf):
    d = _dedup_with_time(K.tables(spark, sf))
    return K.rounded(A.baseline_features(d, A.speed_percentiles(d)).select(*BASE_OUT))


@register("join_percentile_lookup_baseline", round_sql(oracle(
    "SELECT city, segment_id, time_bucket, p15, p50, p85 FROM baseline", "baseline"), ["p15", "p50", "p85"]))
def q_join_pct(spark, sf):
    d = _dedup_with_time(K.tables(spark, sf))
    return K.rounded(A.baseline_features(d, A.speed_percentiles(d)).select("city", "segment_id", "time_bucket", "p15", "p50", "p85"))


# ---------------------------------------------------------------- gold
GOLD_OUT = (
    ["city", "segment_id", "time_bucket", "timestamp", "segment_name", "lat", "lon", "weather_cell_id", "currentSpeed", "freeFlowSpeed", "jamFactor", "congestion_ratio",
     "hour_of_day", "day_of_week", "day_of_month", "month_of_year", "is_weekend", "is_peak_hour",
     "time_gap_minutes", "has_previous_exact_bucket", "has_large_gap_before"]
    + [f"{p}_lag_{k}" for k in range(1, K.N_LAGS + 1) for p in ("speed", "congestion")]
    + ["speed_trend_1", "speed_trend_2", "speed_acceleration",
       "speed_rolling_avg_15m", "speed_rolling_avg_30m", "speed_rolling_avg_60m", "congestion_rolling_avg_15m",
       "congestion_rolling_avg_30m", "congestion_rolling_avg_60m", "speed_volatility_15m", "speed_volatility_30m",
       "valid_history_15m", "valid_history_30m", "valid_history_60m",
       "weather_temperature", "weather_humidity", "weather_rain_1h", "weather_visibility", "weather_wind_speed",
       "has_rain", "weather_severity"]
    + BASE_OUT[3:]
    + [x for h in K.HORIZONS for x in (f"future_speed_{h}m", f"has_exact_target_{h}m")]
    + list(EV.EVENT_FEATURES) + ["has_accident", "has_flood", "has_roadwork", "has_any_event"]
)
GOLD_INT = {"hour_of_day", "day_of_week", "day_of_month", "month_of_year", "is_weekend", "is_peak_hour",
            "has_previous_exact_bucket", "has_large_gap_before", "valid_history_15m", "valid_history_30m",
            "valid_history_60m", "has_rain", "weather_severity", "is_below_p15", "is_above_p85", "is_between_p15_p50",
            "is_anomaly_vs_baseline", "has_accident", "has_flood", "has_roadwork", "has_any_event",
            *[f"has_exact_target_{h}m" for h in K.HORIZONS]}
GOLD_BIGINT = {c for c in EV.EVENT_FEATURES if "count" in c or c.startswith("has_")}
GOLD_DOUBLES = [c for c in GOLD_OUT[3:] if c not in GOLD_INT and c not in ("timestamp", "segment_name", "weather_cell_id") and c not in GOLD_BIGINT
                and c not in ("max_event_severity_1h", "max_event_severity_6h")]


def _gold_sql():
    from .q_core import STRICT_SQL

    strict_cols = [c for c in ("speed_rolling_avg_15m", "speed_rolling_avg_30m", "speed_rolling_avg_60m",
                               "congestion_rolling_avg_15m", "congestion_rolling_avg_30m", "congestion_rolling_avg_60m",
                               "speed_volatility_15m", "speed_volatility_30m", "valid_history_15m", "valid_history_30m",
                               "valid_history_60m")]
    tjoins, tcols = [], []
    for i, h in enumerate(K.HORIZONS):
        tcols.append(f"f{i}.currentSpeed AS future_speed_{h}m, CAST(f{i}.currentSpeed IS NOT NULL AS INTEGER) AS has_exact_target_{h}m")
        tjoins.append(f"LEFT JOIN traffic_dedup f{i} ON f{i}.city = l.city AND f{i}.segment_id = l.segment_id "
                      f"AND f{i}.time_bucket = l.time_bucket + INTERVAL ({h}) MINUTE")
    lag_cols = ", ".join(f"l.{p}_lag_{k}" for k in range(1, K.N_LAGS + 1) for p in ("speed", "congestion"))
    bcols = ", ".join(f"b.{c}" for c in BASE_OUT[3:])
    ecols = ", ".join((f"CAST(coalesce(e.{c}, 0) AS INTEGER) AS {c}" if c.startswith("max_event_severity") else f"coalesce(e.{c}, 0) AS {c}")
                      for c in EV.EVENT_FEATURES if c not in ("has_recent_accident", "has_recent_roadwork", "has_recent_flood"))
    def std(n):
        lags = ", ".join(f"speed_lag_{i}" for i in range(1, n + 1))
        nulls = " OR ".join(f"speed_lag_{i} IS NULL" for i in range(1, n + 1))
        return f"CASE WHEN {nulls} THEN NULL ELSE list_stddev_samp([{lags}]) END"
    strict = STRICT_SQL.replace("stddev_samp(v) AS speed_volatility_15m, NULL AS speed_volatility_30m",
                                f"{std(3)} AS speed_volatility_15m, {std(6)} AS speed_volatility_30m")
    stage("gold_strict", strict, "traffic_lagged")
    gap = f"(epoch(l.time_bucket) - epoch(lag(l.time_bucket) OVER (PARTITION BY l.city, l.segment_id ORDER BY l.time_bucket))) / 60e0"
    sql = f"""
SELECT *, CAST(coalesce(time_gap_minutes = {K.BUCKET}, false) AS INTEGER) AS has_previous_exact_bucket,
  CAST(coalesce(time_gap_minutes, {K.BUCKET}e0) > {K.BUCKET} AS INTEGER) AS has_large_gap_before,
  greatest(0, has_recent_accident) AS has_accident, greatest(0, has_recent_flood) AS has_flood,
  greatest(0, has_recent_roadwork) AS has_roadwork, CAST(news_event_count_6h > 0 AS INTEGER) AS has_any_event
FROM (
SELECT l.city, l.segment_id, l.time_bucket, l.timestamp, l.segment_name, l.lat, l.lon, l.weather_cell_id, l.currentSpeed, l.freeFlowSpeed, l.jamFactor, l.congestion_ratio,
  CAST(hour(l.time_bucket) AS INTEGER) AS hour_of_day, CAST(isodow(l.time_bucket) - 1 AS INTEGER) AS day_of_week,
  CAST(day(l.time_bucket) AS INTEGER) AS day_of_month, CAST(month(l.time_bucket) AS INTEGER) AS month_of_year, CAST(isodow(l.time_bucket) IN (6, 7) AS INTEGER) AS is_weekend,
  CAST(hour(l.time_bucket) IN (7, 8, 9, 16, 17, 18, 19) AS INTEGER) AS is_peak_hour, {gap} AS time_gap_minutes,
  {lag_cols}, l.speed_trend_1, l.speed_trend_2, l.speed_acceleration,
  {', '.join('s.' + c for c in strict_cols)},
  a.weather_temperature, a.weather_humidity, a.weather_rain_1h, a.weather_visibility, a.weather_wind_speed, a.has_rain,
  a.weather_severity, {bcols}, {', '.join(tcols)}, {ecols},
  coalesce(e.has_recent_accident, 0) AS has_recent_accident, coalesce(e.has_recent_roadwork, 0) AS has_recent_roadwork,
  coalesce(e.has_recent_flood, 0) AS has_recent_flood
FROM traffic_lagged l
JOIN gold_strict s USING (city, segment_id, time_bucket)
JOIN asof_weather a USING (city, segment_id, time_bucket)
JOIN baseline b USING (city, segment_id, time_bucket)
LEFT JOIN event_feats e ON e.city = l.city AND e.time_bucket = l.time_bucket
{chr(10).join(tjoins)}) g"""
    stage("gold", f"SELECT {', '.join(GOLD_OUT)} FROM ({sql}) z", "traffic_lagged", "gold_strict", "asof_weather",
          "baseline", "event_feats", "traffic_dedup")
    return round_sql(oracle("SELECT * FROM gold", "gold"), GOLD_DOUBLES)


def gold(t, **options):
    return gold_features(K.traffic_dedup(t), K.weather_dedup(t), t.incident_obs, K.BUCKET, K.HORIZONS, K.N_LAGS, TOL, **options)


@register("gold_features", _gold_sql())
def q_gold_features(spark, sf):
    return K.rounded(gold(K.tables(spark, sf)).select(*GOLD_OUT))
