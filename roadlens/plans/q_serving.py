"""Registered queries: serving views, risk, alerts, top-k and set operations over the
latest Gold row of every segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import traffic as TF
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import risk as R
from ..operators import serving as S
from ..operators import windows as W
from . import common as K
from .q_gold import gold
from .registry import oracle, register, round_sql, stage

stage("serving", """
SELECT g.*, s.district, s.road_class, s.length_m, s.speed_limit, coalesce(g.speed_lag_1, g.currentSpeed) AS predicted_speed
FROM (SELECT * EXCLUDE (_rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY city, segment_id ORDER BY time_bucket DESC) AS _rn FROM gold) x
      WHERE _rn = 1) g
LEFT JOIN segment_dim s USING (segment_id)
""", "gold", "segment_dim")


def serving(t, g=None):
    """Latest Gold row per segment + segment dimension + the naive forecast (last bucket's speed)."""
    latest = W.latest_by_segment(gold(t) if g is None else g, ts="time_bucket")
    dim = t.segment_dim
    out = latest.join(dim, "segment_id", "left")
    return out.withColumn("predicted_speed", F.coalesce(F.col("speed_lag_1"), F.col("currentSpeed")))


def _q(name, sql, deps=("serving",), doubles=()):
    return register(name, round_sql(oracle(sql, *deps), list(doubles)))


# ---------------------------------------------------------------- dashboard views
@_q("dashboard_summary", """
SELECT l.*, t.total_gold_rows FROM (
SELECT city, count(DISTINCT segment_id) AS monitored_segments, count(*) AS serving_snapshot_rows,
  count(*) FILTER (WHERE jamFactor >= 3) AS risk_markers, count(*) FILTER (WHERE jamFactor < 3) AS free_flow_segments,
  count(*) FILTER (WHERE jamFactor >= 3 AND jamFactor < 6) AS slow_segments, count(*) FILTER (WHERE jamFactor >= 6) AS congested_segments,
  avg(currentSpeed) AS avg_speed, avg(jamFactor) AS avg_jam_factor, max(timestamp) AS latest_timestamp
FROM serving GROUP BY city) l LEFT JOIN (SELECT city, count(*) AS total_gold_rows FROM gold GROUP BY city) t USING (city)
""", ("serving", "gold"), ["avg_speed", "avg_jam_factor"])
def q_dashboard_summary(spark, sf):
    t = K.tables(spark, sf)
    g = gold(t)
    return K.rounded(S.dashboard_summary(serving(t, g), g))


@_q("hourly_trends", """
SELECT g.city, date_trunc('hour', g.timestamp) AS hour, avg(currentSpeed) AS avg_speed, avg(jamFactor) AS avg_jam_factor,
  count(*) AS rows
FROM gold g JOIN (SELECT city, max(timestamp) AS mx FROM gold GROUP BY city) m USING (city)
WHERE g.timestamp >= m.mx - INTERVAL 168 HOUR GROUP BY ALL
""", ("gold",), ["avg_speed", "avg_jam_factor"])
def q_hourly_trends(spark, sf):
    return K.rounded(S.hourly_trends(gold(K.tables(spark, sf)), hours=168))


@_q("city_status", """
SELECT city, count(DISTINCT segment_id) AS total_segments, avg(currentSpeed) AS avg_speed,
  avg(CASE WHEN jamFactor >= 3 THEN 1e0 ELSE 0e0 END) AS congestion_ratio, max(jamFactor) AS max_jam_factor,
  count(*) FILTER (WHERE jamFactor >= 6) AS critical_segment_count, max(timestamp) AS timestamp
FROM serving GROUP BY city""", doubles=["avg_speed", "congestion_ratio", "max_jam_factor"])
def q_city_status(spark, sf):
    return K.rounded(S.city_status(serving(K.tables(spark, sf))))


# Configured cities: a parameter table of the deployment (city, enabled).
CITY_CONFIG = [("hanoi", True), ("hcmc", True), ("danang", False)]


@_q("city_runtime", """
SELECT c.city, c.enabled, CASE WHEN c.enabled AND a.segment_count IS NOT NULL THEN 'online' ELSE 'offline' END AS status,
  coalesce(a.segment_count, 0) AS segment_count, a.latest_timestamp, a.avg_speed, a.avg_jam_factor
FROM (VALUES ('hanoi', true), ('hcmc', true), ('danang', false)) c(city, enabled)
LEFT JOIN (SELECT city, count(DISTINCT segment_id) AS segment_count, max(timestamp) AS latest_timestamp,
  avg(currentSpeed) AS avg_speed, avg(jamFactor) AS avg_jam_factor FROM serving GROUP BY city) a USING (city)
""", doubles=["avg_speed", "avg_jam_factor"])
def q_city_runtime(spark, sf):
    cities = spark.createDataFrame(CITY_CONFIG, "city string, enabled boolean")
    return K.rounded(S.city_runtime(serving(K.tables(spark, sf)), cities))


@_q("name_prefix_hotspots", """
SELECT *, CASE WHEN avg_jam_factor >= 8 THEN 'critical' WHEN avg_jam_factor >= 6 THEN 'high'
  WHEN avg_jam_factor >= 3 THEN 'medium' ELSE 'low' END AS severity FROM (
SELECT city, substr(coalesce(segment_name, segment_id), 1, 12) AS cluster_key, avg(lat) AS center_lat, avg(lon) AS center_lon,
  count(DISTINCT segment_id) AS num_segments, avg(greatest(freeFlowSpeed - currentSpeed, 0e0)) AS avg_congestion,
  avg(jamFactor) AS avg_jam_factor, max(timestamp) AS detected_at
FROM serving WHERE jamFactor >= 3 GROUP BY ALL) x""", doubles=["center_lat", "center_lon", "avg_congestion", "avg_jam_factor"])
def q_name_prefix_hotspots(spark, sf):
    return K.rounded(S.name_prefix_hotspots(serving(K.tables(spark, sf))))


# ---------------------------------------------------------------- risk
def _clip(x):
    return f"greatest(0e0, least(1e0, {x}))"


stage("risk", f"""
SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium'
  ELSE 'low' END AS risk_level,
  list_filter([CASE WHEN rc >= 5e-1 THEN 'congestion_ratio' END, CASE WHEN rp >= 5e-1 THEN 'prediction_drop_ratio' END,
    CASE WHEN ru >= 5e-1 THEN 'upstream_congestion_score' END, CASE WHEN rr >= 5e-1 THEN 'rain_severity' END,
    CASE WHEN re >= 5e-1 THEN 'event_severity' END, CASE WHEN rd >= 5e-1 THEN 'data_uncertainty' END], lambda x: x IS NOT NULL)
    AS triggered_rules
FROM (SELECT *, greatest(0e0, least(100e0, (35e-2 * rc + 25e-2 * rp + 15e-2 * ru + 1e-1 * rr + 1e-1 * re + 5e-2 * rd) * 100e0))
  AS risk_score FROM (
SELECT *,
  CASE WHEN coalesce(freeFlowSpeed, greatest(coalesce(currentSpeed, 0e0), 1e0)) > 0
    THEN {_clip('1e0 - coalesce(currentSpeed, 0e0) / coalesce(freeFlowSpeed, greatest(coalesce(currentSpeed, 0e0), 1e0))')}
    ELSE least(coalesce(jamFactor, 0e0) / 10e0, 1e0) END AS rc,
  CASE WHEN coalesce(currentSpeed, 0e0) > 0 THEN {_clip('(coalesce(currentSpeed, 0e0) - coalesce(predicted_speed, coalesce(currentSpeed, 0e0))) / coalesce(currentSpeed, 0e0)')}
    ELSE 0e0 END AS rp,
  0e0 AS ru,
  {_clip('coalesce(weather_rain_1h, 0e0) / 30e0 + coalesce(CAST(weather_severity AS DOUBLE), 0e0) / 10e0')} AS rr,
  {_clip('coalesce(CAST(max_event_severity_1h AS DOUBLE), 0e0) / 10e0 + coalesce(CAST(accident_count_1h AS DOUBLE), 0e0) * 25e-2 + coalesce(CAST(news_event_count_1h AS DOUBLE), 0e0) * 8e-2')} AS re,
  0e0 AS rd
FROM serving) a) b
""", "serving")


def scored(t):
    return R.segment_risk(serving(t))


@_q("segment_risk", "SELECT city, segment_id, risk_score, risk_level, triggered_rules FROM risk", ("risk",), ["risk_score"])
def q_segment_risk(spark, sf):
    return K.rounded(scored(K.tables(spark, sf)).select("city", "segment_id", "risk_score", "risk_level", "triggered_rules"))


@_q("corridor_risk", """
SELECT district AS corridor_id, avg(risk_score) AS risk_score, max(jamFactor) AS max_jam_factor,
  count(DISTINCT segment_id) AS segment_count,
  CASE WHEN avg(risk_score) >= 80 THEN 'critical' WHEN avg(risk_score) >= 60 THEN 'high' WHEN avg(risk_score) >= 30 THEN 'medium' ELSE 'low' END AS risk_level
FROM risk GROUP BY district ORDER BY risk_score DESC, corridor_id NULLS LAST LIMIT 10""", ("risk",), ["risk_score", "max_jam_factor"])
def q_corridor_risk(spark, sf):
    return K.rounded(S.corridor_risk(scored(K.tables(spark, sf)), "district", 10))


def _hot_sql():
    return """
SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium'
  ELSE 'low' END AS risk_level,
  list_filter([CASE WHEN c_low > 0 THEN 'predicted_speed_below_20' END, CASE WHEN c_ratio > 0 THEN 'predicted_speed_below_half_free_flow' END,
    CASE WHEN c_drop > 0 THEN 'speed_drop_above_30pct' END, CASE WHEN c_jam >= 6e-1 THEN 'current_jam_factor_high' END,
    CASE WHEN c_ctx > 0 THEN 'context_risk_signal_present' END], lambda x: x IS NOT NULL) AS triggered_rules
FROM (SELECT *, least(greatest(35e0 * c_low + 25e0 * c_ratio + 20e0 * c_drop + 10e0 * c_jam + 10e0 * c_ctx, 0e0), 100e0) AS risk_score
FROM (SELECT city, segment_id, currentSpeed, predicted_speed, speed_drop_pct,
  CASE WHEN predicted_speed < 20e0 THEN 1e0 ELSE 0e0 END AS c_low,
  CASE WHEN ratio IS NOT NULL AND ratio < 5e-1 THEN 1e0 ELSE 0e0 END AS c_ratio,
  CASE WHEN speed_drop_pct > 30e0 THEN 1e0 ELSE 0e0 END AS c_drop,
  least(greatest(coalesce(jamFactor, 0e0) / 10e0, 0e0), 1e0) AS c_jam,
  greatest(least(1e0, coalesce(CAST(accident_count_1h AS DOUBLE), 0e0) * 45e-2 + coalesce(CAST(news_event_count_1h AS DOUBLE), 0e0) * 15e-2
      + coalesce(CAST(max_event_severity_1h AS DOUBLE), 0e0) / 10e0),
    least(1e0, coalesce(CAST(weather_severity AS DOUBLE), 0e0) / 10e0 + CASE WHEN coalesce(CAST(has_rain AS DOUBLE), 0e0) <> 0
      AND (coalesce(weather_rain_1h, 0e0) >= 10 OR coalesce(CAST(weather_severity AS DOUBLE), 0e0) >= 2) THEN 35e-2 ELSE 0e0 END)) AS c_ctx
FROM (SELECT *, CASE WHEN coalesce(freeFlowSpeed, 0e0) > 0 THEN predicted_speed / coalesce(freeFlowSpeed, 0e0) END AS ratio,
  CASE WHEN coalesce(currentSpeed, 0e0) > 0 THEN (coalesce(currentSpeed, 0e0) - predicted_speed) / coalesce(currentSpeed, 0e0) * 100e0
    ELSE 0e0 END AS speed_drop_pct FROM serving) a) b) c
"""


stage("hot", _hot_sql(), "serving")


@_q("predicted_hotspots", """
SELECT city, segment_id, currentSpeed, predicted_speed, speed_drop_pct, risk_score, risk_level, triggered_rules
FROM hot WHERE risk_level <> 'low'""", ("hot",), ["currentSpeed", "predicted_speed", "speed_drop_pct", "risk_score"])
def q_predicted_hotspots(spark, sf):
    h = R.predicted_hotspots(serving(K.tables(spark, sf)))
    h = h.orderBy(F.col("risk_score").desc(), F.col("predicted_speed").asc())
    return K.rounded(h.select("city", "segment_id", "currentSpeed", "predicted_speed", "speed_drop_pct", "risk_score", "risk_level", "triggered_rules"))


# Model inputs whose presence defines feature coverage for reliability and coverage reports.
MODEL_FEATURES = ["currentSpeed", "freeFlowSpeed", "jamFactor", "speed_lag_1", "speed_lag_2", "speed_lag_3", "speed_lag_4",
                  "speed_rolling_avg_15m", "speed_rolling_avg_30m", "weather_temperature", "weather_humidity",
                  "weather_rain_1h", "p50"]


def with_coverage(df):
    avail = sum((F.col(c).isNotNull().cast("int") for c in MODEL_FEATURES), F.lit(0))
    return df.withColumns({"required_feature_count": F.lit(len(MODEL_FEATURES)), "available_feature_count": avail,
                           "horizon": F.lit("15m")})


def _avail_sql():
    return " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in MODEL_FEATURES)


@_q("prediction_reliability", f"""
SELECT city, segment_id, cov AS feature_coverage_ratio, fresh AS data_freshness_seconds,
  CASE WHEN cov < 7e-1 OR (fresh IS NOT NULL AND fresh > 3600) THEN 'low'
       WHEN cov < 9e-1 OR fresh IS NULL OR fresh > 600 THEN 'medium' ELSE 'high' END AS reliability_level,
  CASE WHEN predicted_speed IS NOT NULL THEN greatest(0e0, predicted_speed - (5e0 + (1e0 - least(greatest(cov, 0e0), 1e0)) * 5e0)) END AS band_low,
  CASE WHEN predicted_speed IS NOT NULL THEN predicted_speed + (5e0 + (1e0 - least(greatest(cov, 0e0), 1e0)) * 5e0) END AS band_high
FROM (SELECT *, ({_avail_sql()}) / {float(len(MODEL_FEATURES))} AS cov,
  CAST(greatest(0, (epoch_us(TIMESTAMP '{K.TEST_NOW}') - epoch_us(timestamp)) // 1000000) AS BIGINT) AS fresh FROM serving) x
""", doubles=["feature_coverage_ratio", "band_low", "band_high"])
def q_prediction_reliability(spark, sf):
    d = R.prediction_reliability(with_coverage(serving(K.tables(spark, sf))), K.TEST_NOW)
    return K.rounded(d.select("city", "segment_id", "feature_coverage_ratio", "data_freshness_seconds", "reliability_level", "band_low", "band_high"))


@_q("speed_alerts", """
SELECT * FROM (SELECT city, segment_id, p, p15v AS baseline_p15, p50v AS baseline_p50,
  CASE WHEN lag1 > 0 AND lag1 - cur > 20 THEN 'MEDIUM' ELSE
    CASE WHEN p < p15v * 8e-1 THEN 'CRITICAL' WHEN p < p50v * 7e-1 THEN 'HIGH' WHEN p < p50v * 9e-1 THEN 'MEDIUM' WHEN p < p50v THEN 'LOW' END
  END AS severity
FROM (SELECT city, segment_id, coalesce(currentSpeed, 0e0) AS cur, coalesce(predicted_speed, coalesce(currentSpeed, 0e0)) AS p,
  coalesce(p15, 20e0) AS p15v, coalesce(p50, 35e0) AS p50v, coalesce(speed_lag_1, 0e0) AS lag1 FROM serving) a) b
WHERE severity IS NOT NULL""", doubles=["p", "baseline_p15", "baseline_p50"])
def q_speed_alerts(spark, sf):
    a = R.speed_alerts(serving(K.tables(spark, sf)))
    return K.rounded(a.select("city", "segment_id", F.col("alert_predicted_speed").alias("p"), "baseline_p15", "baseline_p50", "severity"))


@_q("jam_alerts", """
SELECT concat('alert_', city, '_', segment_id) AS alert_id, city, segment_id, jamFactor, currentSpeed,
  coalesce(p50, freeFlowSpeed, currentSpeed) AS baseline_p50,
  CASE WHEN jamFactor >= 8 THEN 'CRITICAL' WHEN jamFactor >= 6 THEN 'HIGH' WHEN jamFactor >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM serving WHERE jamFactor >= 3""", doubles=["jamFactor", "currentSpeed", "baseline_p50"])
def q_jam_alerts(spark, sf):
    a = R.jam_alerts(serving(K.tables(spark, sf)))
    return K.rounded(a.select("alert_id", "city", "segment_id", "jamFactor", "currentSpeed", "baseline_p50", "severity"))


@_q("alert_reasons", """
SELECT concat('alert_', city, '_', segment_id) AS alert_id,
  CASE WHEN sev IN ('CRITICAL', 'HIGH') THEN 'Prioritize monitoring this corridor and suggest an alternative route.'
       WHEN sev = 'MEDIUM' THEN 'Monitor the segment and keep route alternatives ready.'
       ELSE 'Track the segment; no immediate intervention required.' END AS recommended_action,
  'medium' AS confidence_level, [segment_id] AS affected_segments, len(triggered_rules) AS n_rules
FROM (SELECT *, CASE WHEN jamFactor >= 8 THEN 'CRITICAL' WHEN jamFactor >= 6 THEN 'HIGH' WHEN jamFactor >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS sev
      FROM risk WHERE jamFactor >= 3) x""", ("risk",))
def q_alert_reasons(spark, sf):
    a = R.alert_reasons(R.jam_alerts(scored(K.tables(spark, sf))))
    return a.select("alert_id", "recommended_action", "confidence_level", "affected_segments",
                    F.size("triggered_rules").cast("bigint").alias("n_rules"))


# What-if scenarios: parameters of the simulation (one entry per scenario).
SCENARIOS = [
    {"scenario_id": "rain_20mm", "rain_1h_mm": 20.0},
    {"scenario_id": "accident", "event_type": "accident"},
    {"scenario_id": "peak", "is_peak_hour": True},
    {"scenario_id": "flood_rain_peak", "rain_1h_mm": 50.0, "event_type": "flood", "is_peak_hour": True},
]


@_q("scenario_impact", """
SELECT segment_id, scenario_id, b AS baseline_speed, sim AS simulated_speed, sim - b AS speed_delta,
  CASE WHEN b > 0 THEN (sim - b) / b * 100e0 ELSE 0e0 END AS speed_delta_pct
FROM (SELECT segment_id, scenario_id, b, greatest(0e0, b * mr * me * mp) AS sim FROM (
  SELECT s.segment_id, c.scenario_id, coalesce(s.predicted_speed, s.currentSpeed, 0e0) AS b,
    CASE WHEN c.rain > 0 THEN greatest(65e-2, 1e0 - least(c.rain, 40e0) * 8e-3) ELSE 1e0 END AS mr,
    CASE c.ev WHEN 'accident' THEN 72e-2 WHEN 'flood' THEN 78e-2 WHEN 'roadwork' THEN 86e-2 ELSE 1e0 END AS me,
    CASE WHEN c.peak THEN 9e-1 ELSE 1e0 END AS mp
  FROM serving s, (VALUES ('rain_20mm', 20e0, 'none', false), ('accident', 0e0, 'accident', false), ('peak', 0e0, 'none', true),
                          ('flood_rain_peak', 50e0, 'flood', true)) c(scenario_id, rain, ev, peak)) a) b
""", doubles=["baseline_speed", "simulated_speed", "speed_delta", "speed_delta_pct"])
def q_scenario_impact(spark, sf):
    out = R.scenario_impact(serving(K.tables(spark, sf)), SCENARIOS)
    return K.rounded(out.select("segment_id", "scenario_id", "baseline_speed", "simulated_speed", "speed_delta", "speed_delta_pct"))


# ---------------------------------------------------------------- levels, top-k, lookups
@_q("congestion_level", """
SELECT segment_id, r AS speed_ratio,
  CASE WHEN r >= 75e-2 THEN 'Free' WHEN r >= 5e-1 THEN 'Slow' WHEN r >= 3e-1 THEN 'Congested' ELSE 'Severe' END AS congestion_level,
  CAST(greatest(0, round_even((1e0 - greatest(0e0, least(r, 1e0))) * 18e0 + jamFactor * 6e-1, 0)) AS BIGINT) AS delay_minutes,
  CASE WHEN jamFactor >= 8 THEN 'CRITICAL' WHEN jamFactor >= 6 THEN 'HIGH' WHEN jamFactor >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM (SELECT *, CASE WHEN freeFlowSpeed > 0 THEN currentSpeed / freeFlowSpeed ELSE 0e0 END AS r FROM serving) x""", doubles=["speed_ratio"])
def q_congestion_level(spark, sf):
    d = S.with_congestion_levels(serving(K.tables(spark, sf)))
    return K.rounded(d.select("segment_id", "speed_ratio", "congestion_level", "delay_minutes", "severity"))


@_q("severity_from_jam", """
SELECT event_id, CASE WHEN jamFactor >= 8 THEN 'CRITICAL' WHEN jamFactor >= 6 THEN 'HIGH' WHEN jamFactor >= 3 THEN 'MEDIUM'
  ELSE 'LOW' END AS severity FROM silver_traffic""", ("silver_traffic",))
def q_severity_from_jam(spark, sf):
    return K.silver_traffic(K.tables(spark, sf)).select("event_id", TF.severity_from_jam("jamFactor").alias("severity"))


@_q("top_n_per_city", """
SELECT city, segment_id, jamFactor FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY jamFactor DESC, segment_id) AS rn
FROM serving) x WHERE rn <= 25""", doubles=["jamFactor"])
def q_top_n_per_city(spark, sf):
    return K.rounded(S.top_n_per_city(serving(K.tables(spark, sf)), 25).select("city", "segment_id", "jamFactor"))


@_q("segment_lookup", """
SELECT segment_id, city, road_class, district, length_m, speed_limit, lat, lon FROM serving
WHERE segment_id IN (SELECT segment_id FROM segment_dim)""", ("serving", "segment_dim"), ["length_m", "speed_limit", "lat", "lon"])
def q_segment_lookup(spark, sf):
    t = K.tables(spark, sf)
    out = S.segment_lookup(serving(t), t.segment_dim)
    return K.rounded(out.select("segment_id", "city", "road_class", "district", "length_m", "speed_limit", "lat", "lon"))


@_q("worst_continuity", """
SELECT city, segment_id, missing_bucket_ratio FROM continuity ORDER BY missing_bucket_ratio DESC, segment_id LIMIT 20""",
    ("continuity",), ["missing_bucket_ratio"])
def q_worst_continuity(spark, sf):
    rep = A.continuity_report(K.silver_traffic(K.tables(spark, sf)), K.BUCKET)
    return K.rounded(rep.orderBy(F.col("missing_bucket_ratio").desc(), "segment_id").limit(20)
                     .select("city", "segment_id", "missing_bucket_ratio"))


@_q("largest_errors", """
SELECT city, segment_id, time_bucket, abs(currentSpeed - speed_lag_1) AS abs_error FROM gold
WHERE speed_lag_1 IS NOT NULL ORDER BY abs_error DESC, segment_id, time_bucket LIMIT 20""", ("gold",), ["abs_error"])
def q_largest_errors(spark, sf):
    g = gold(K.tables(spark, sf)).filter(F.col("speed_lag_1").isNotNull())
    g = g.withColumn("abs_error", F.abs(F.col("currentSpeed") - F.col("speed_lag_1")))
    return K.rounded(g.orderBy(F.col("abs_error").desc(), "segment_id", "time_bucket").limit(20)
                     .select("city", "segment_id", "time_bucket", "abs_error"))


# ---------------------------------------------------------------- set operations
@_q("union_cities", """
SELECT city, segment_id, jamFactor, NULL AS district FROM serving WHERE city = 'hanoi'
UNION ALL SELECT city, segment_id, jamFactor, district FROM serving WHERE city = 'hcmc'""", doubles=["jamFactor"])
def q_union_cities(spark, sf):
    s = serving(K.tables(spark, sf))
    a = s.filter(F.col("city") == "hanoi").select("city", "segment_id", "jamFactor")
    b = s.filter(F.col("city") == "hcmc").select("city", "segment_id", "jamFactor", "district")
    return K.rounded(union_cities([a, b]))


def union_cities(frames):
    """Union of per-city tables with aligned columns (missing columns become null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
