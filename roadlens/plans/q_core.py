"""Registered queries: cleaning, dedup, exact lags/targets, latest state, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import traffic as TF
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import windows as W
from . import common as K
from .registry import oracle, register, round_sql

# ---------------------------------------------------------------- clean_traffic
SILVER_COLS = ["event_id", "city", "segment_id", "time_bucket", "timestamp", "source_time_bucket", "date",
               "currentSpeed", "freeFlowSpeed", "jamFactor", "confidence", "lat", "lon"]


@register("clean_traffic", oracle(f"SELECT {', '.join(SILVER_COLS)} FROM silver_traffic", "silver_traffic"))
def q_clean_traffic(spark, sf):
    return K.silver_traffic(K.tables(spark, sf)).select(*SILVER_COLS)


WSILVER_COLS = ["event_id", "city", "weather_cell_id", "time_bucket", "timestamp", "temp", "humidity", "pressure",
                "visibility", "rain_1h", "wind_speed"]


@register("clean_weather", oracle(f"SELECT {', '.join(WSILVER_COLS)} FROM silver_weather", "silver_weather"))
def q_clean_weather(spark, sf):
    return K.silver_weather(K.tables(spark, sf)).select(*WSILVER_COLS)


# ---------------------------------------------------------------- dedup
DEDUP_DOUBLES = ["currentSpeed", "freeFlowSpeed", "jamFactor", "confidence", "congestion_ratio"]


@register("dedup_traffic", round_sql(oracle("SELECT * FROM traffic_dedup", "traffic_dedup"), DEDUP_DOUBLES))
def q_dedup_traffic(spark, sf):
    return K.rounded(K.traffic_dedup(K.tables(spark, sf)))


@register("dedup_weather", round_sql(oracle("SELECT * FROM weather_dedup", "weather_dedup"),
                                     ["temp", "humidity", "pressure", "visibility", "rain_1h", "wind_speed"]))
def q_dedup_weather(spark, sf):
    d = K.weather_dedup(K.tables(spark, sf))
    return K.rounded(d.select("city", "weather_cell_id", "time_bucket", "timestamp", "temp", "humidity", "pressure",
                              "visibility", "rain_1h", "wind_speed", "rows_collapsed"))


@register("congestion_ratio", oracle("""
SELECT event_id, least(greatest(CASE WHEN freeFlowSpeed > 0 THEN 1e0 - currentSpeed / freeFlowSpeed ELSE 0e0 END, 0e0), 1e0)
  AS congestion_ratio FROM traffic_obs""", "traffic_obs"))
def q_congestion_ratio(spark, sf):
    return K.tables(spark, sf).traffic_obs.select("event_id", TF.congestion_ratio().alias("congestion_ratio"))


# ---------------------------------------------------------------- exact lags / targets
LAG_COLS = [f"{p}_lag_{k}" for k in range(1, K.N_LAGS + 1) for p in ("speed", "congestion")]
LAG_OUT = ["city", "segment_id", "time_bucket", *LAG_COLS, "speed_trend_1", "speed_trend_2", "speed_acceleration"]
LAG_DOUBLES = [c for c in LAG_OUT if c not in ("city", "segment_id", "time_bucket")]


@register("exact_lag_join", round_sql(oracle(f"SELECT {', '.join(LAG_OUT)} FROM traffic_lagged", "traffic_lagged"), LAG_DOUBLES))
def q_exact_lag_join(spark, sf):
    return K.rounded(K.traffic_lagged(K.tables(spark, sf)).select(*LAG_OUT))


def _target_sql():
    cols, joins = [], []
    for i, h in enumerate(K.HORIZONS):
        cols.append(f"f{i}.currentSpeed AS future_speed_{h}m, CAST(f{i}.currentSpeed IS NOT NULL AS INTEGER) AS has_exact_target_{h}m")
        joins.append(f"LEFT JOIN traffic_dedup f{i} ON f{i}.city = d.city AND f{i}.segment_id = d.segment_id "
                     f"AND f{i}.time_bucket = d.time_bucket + INTERVAL ({h}) MINUTE")
    return f"SELECT d.city, d.segment_id, d.time_bucket, d.currentSpeed, " + ", ".join(cols) + \
        "\nFROM traffic_dedup d\n" + "\n".join(joins)


TARGET_DOUBLES = ["currentSpeed"] + [f"future_speed_{h}m" for h in K.HORIZONS]


@register("exact_horizon_target", round_sql(oracle(_target_sql(), "traffic_dedup"), TARGET_DOUBLES))
def q_exact_horizon_target(spark, sf):
    d = W.exact_horizon_target(K.traffic_dedup(K.tables(spark, sf)), K.HORIZONS)
    cols = ["city", "segment_id", "time_bucket", "currentSpeed"] + [x for h in K.HORIZONS for x in (f"future_speed_{h}m", f"has_exact_target_{h}m")]
    return K.rounded(d.select(*cols))


STRICT_SQL = """
SELECT city, segment_id, time_bucket,
  (speed_lag_1 + speed_lag_2 + speed_lag_3) / 3e0 AS speed_rolling_avg_15m,
  (speed_lag_1 + speed_lag_2 + speed_lag_3 + speed_lag_4 + speed_lag_5 + speed_lag_6) / 6e0 AS speed_rolling_avg_30m,
  (speed_lag_1 + speed_lag_2 + speed_lag_3 + speed_lag_4 + speed_lag_5 + speed_lag_6 + speed_lag_7 + speed_lag_8
    + speed_lag_9 + speed_lag_10 + speed_lag_11 + speed_lag_12) / 12e0 AS speed_rolling_avg_60m,
  (congestion_lag_1 + congestion_lag_2 + congestion_lag_3) / 3e0 AS congestion_rolling_avg_15m,
  (congestion_lag_1 + congestion_lag_2 + congestion_lag_3 + congestion_lag_4 + congestion_lag_5 + congestion_lag_6) / 6e0
    AS congestion_rolling_avg_30m,
  (congestion_lag_1 + congestion_lag_2 + congestion_lag_3 + congestion_lag_4 + congestion_lag_5 + congestion_lag_6
    + congestion_lag_7 + congestion_lag_8 + congestion_lag_9 + congestion_lag_10 + congestion_lag_11 + congestion_lag_12) / 12e0
    AS congestion_rolling_avg_60m,
  stddev_samp(v) AS speed_volatility_15m, NULL AS speed_volatility_30m,
  CAST(speed_lag_1 IS NOT NULL AND speed_lag_2 IS NOT NULL AND speed_lag_3 IS NOT NULL AS INTEGER) AS valid_history_15m,
  CAST(speed_lag_1 IS NOT NULL AND speed_lag_2 IS NOT NULL AND speed_lag_3 IS NOT NULL AND speed_lag_4 IS NOT NULL
    AND speed_lag_5 IS NOT NULL AND speed_lag_6 IS NOT NULL AS INTEGER) AS valid_history_30m,
  CAST(speed_lag_1 IS NOT NULL AND speed_lag_2 IS NOT NULL AND speed_lag_3 IS NOT NULL AND speed_lag_4 IS NOT NULL
    AND speed_lag_5 IS NOT NULL AND speed_lag_6 IS NOT NULL AND speed_lag_7 IS NOT NULL AND speed_lag_8 IS NOT NULL
    AND speed_lag_9 IS NOT NULL AND speed_lag_10 IS NOT NULL AND speed_lag_11 IS NOT NULL AND speed_lag_12 IS NOT NULL
    AS INTEGER) AS valid_history_60m
FROM traffic_lagged
"""


def _strict_oracle():
    # sample std in DuckDB over the lag values of one row: unnest a list and aggregate per row
    def std(n):
        lags = ", ".join(f"speed_lag_{i}" for i in range(1, n + 1))
        nulls = " OR ".join(f"speed_lag_{i} IS NULL" for i in range(1, n + 1))
        return f"CASE WHEN {nulls} THEN NULL ELSE list_stddev_samp([{lags}]) END"

    sql = STRICT_SQL.replace("stddev_samp(v) AS speed_volatility_15m, NULL AS speed_volatility_30m",
                             f"{std(3)} AS speed_volatility_15m, {std(6)} AS speed_volatility_30m")
    doubles = [f"{p}_rolling_avg_{w}" for p in ("speed", "congestion") for w in ("15m", "30m", "60m")] + \
        ["speed_volatility_15m", "speed_volatility_30m"]
    return round_sql(oracle(sql, "traffic_lagged"), doubles)


STRICT_OUT = ["city", "segment_id", "time_bucket"] + \
    [f"{p}_rolling_avg_{w}" for p in ("speed", "congestion") for w in ("15m", "30m", "60m")] + \
    ["speed_volatility_15m", "speed_volatility_30m", "valid_history_15m", "valid_history_30m", "valid_history_60m"]


@register("strict_history_rolling", _strict_oracle())
def q_strict_history_rolling(spark, sf):
    d = W.strict_history_rolling(K.traffic_lagged(K.tables(spark, sf)))
    return K.rounded(d.select(*STRICT_OUT))


@register("speed_trends", round_sql(oracle(
    "SELECT city, segment_id, time_bucket, speed_trend_1, speed_trend_2, speed_acceleration FROM traffic_lagged",
    "traffic_lagged"), ["speed_trend_1", "speed_trend_2", "speed_acceleration"]))
def q_speed_trends(spark, sf):
    d = K.traffic_lagged(K.tables(spark, sf))
    return K.rounded(d.select("city", "segment_id", "time_bucket", "speed_trend_1", "speed_trend_2", "speed_acceleration"))


# ---------------------------------------------------------------- latest / top-k
LATEST_COLS = ["city", "segment_id", "time_bucket", "timestamp", "currentSpeed", "jamFactor", "congestion_ratio", "segment_name"]


@register("latest_by_segment", round_sql(oracle(f"SELECT {', '.join(LATEST_COLS)} FROM latest", "latest"),
                                         ["currentSpeed", "jamFactor", "congestion_ratio"]))
def q_latest_by_segment(spark, sf):
    return K.rounded(K.latest(K.tables(spark, sf)).select(*LATEST_COLS))


def top_congested(df, n: int = 20, jam: str = "jamFactor", key: str = "segment_id"):
    """N segments by jam factor, highest first; ties by id (plans as TakeOrderedAndProject)."""
    return df.orderBy(F.col(jam).desc(), F.col(key).asc()).limit(n)


@register("top_congested", round_sql(oracle(
    "SELECT city, segment_id, jamFactor, currentSpeed FROM latest ORDER BY jamFactor DESC, segment_id LIMIT 20", "latest"),
    ["jamFactor", "currentSpeed"]))
def q_top_congested(spark, sf):
    d = K.latest(K.tables(spark, sf)).select("city", "segment_id", "jamFactor", "currentSpeed")
    return K.rounded(top_congested(d, 20))


# ---------------------------------------------------------------- gaps, continuity
@register("gap_features", oracle(f"""
SELECT city, segment_id, time_bucket, time_gap_minutes,
  CAST(coalesce(time_gap_minutes = {K.BUCKET}, false) AS INTEGER) AS has_previous_exact_bucket,
  CAST(coalesce(time_gap_minutes, {K.BUCKET}e0) > {K.BUCKET} AS INTEGER) AS has_large_gap_before
FROM (SELECT city, segment_id, time_bucket,
  (epoch(time_bucket) - epoch(lag(time_bucket) OVER (PARTITION BY city, segment_id ORDER BY time_bucket))) / 60e0 AS time_gap_minutes
  FROM traffic_dedup) x""", "traffic_dedup"))
def q_gap_features(spark, sf):
    d = W.gap_features(K.traffic_dedup(K.tables(spark, sf)), K.BUCKET)
    return d.select("city", "segment_id", "time_bucket", "time_gap_minutes", "has_previous_exact_bucket", "has_large_gap_before")


CONT_SQL = f"""
SELECT city, segment_id, min_time_bucket, max_time_bucket, record_count, expected_bucket_count, missing_bucket_count,
  missing_bucket_count / expected_bucket_count AS missing_bucket_ratio, median_interval_minutes, max_time_gap_minutes,
  CASE WHEN n_int > 0 THEN n_exact / n_int END AS correct_interval_ratio,
  record_count >= 4 AND n_exact >= 3 AS is_train_candidate_15m,
  record_count >= 13 AND n_exact >= 12 AS is_train_candidate_60m,
  record_count >= 49 AND n_exact >= 48 AS is_train_candidate_240m
FROM (
  SELECT *, greatest(expected_bucket_count - record_count, 0) AS missing_bucket_count FROM (
    SELECT city, segment_id, min(time_bucket) AS min_time_bucket, max(time_bucket) AS max_time_bucket,
      count(*) AS record_count, count(gap) AS n_int, count(*) FILTER (WHERE gap = {K.BUCKET}) AS n_exact,
      median(gap) AS median_interval_minutes, max(gap) AS max_time_gap_minutes,
      CAST(floor((epoch(max(time_bucket)) - epoch(min(time_bucket))) / {K.BUCKET * 60}) + 1 AS BIGINT) AS expected_bucket_count
    FROM (SELECT city, segment_id, time_bucket,
        (epoch(time_bucket) - epoch(lag(time_bucket) OVER (PARTITION BY city, segment_id ORDER BY time_bucket))) / 60e0 AS gap
      FROM (SELECT DISTINCT city, segment_id, time_bucket FROM silver_traffic) b) g
    GROUP BY city, segment_id) a) c
"""
stage_cont = K.stage("continuity", CONT_SQL, "silver_traffic")


@register("continuity_report", round_sql(oracle("SELECT * FROM continuity", "continuity"),
                                         ["missing_bucket_ratio", "median_interval_minutes", "max_time_gap_minutes", "correct_interval_ratio"]))
def q_continuity_report(spark, sf):
    return K.rounded(A.continuity_report(K.silver_traffic(K.tables(spark, sf)), K.BUCKET))


@register("continuity_by_city", round_sql(oracle("""
SELECT city, count(*) AS segments, CAST(sum(record_count) AS BIGINT) AS records, CAST(sum(missing_bucket_count) AS BIGINT) AS missing_buckets,
  avg(missing_bucket_ratio) AS avg_missing_ratio,
  count(*) FILTER (WHERE is_train_candidate_15m) AS train_candidates_15m,
  count(*) FILTER (WHERE is_train_candidate_60m) AS train_candidates_60m,
  count(*) FILTER (WHERE is_train_candidate_240m) AS train_candidates_240m
FROM continuity GROUP BY city""", "continuity"), ["avg_missing_ratio"]))
def q_continuity_by_city(spark, sf):
    rep = A.continuity_report(K.silver_traffic(K.tables(spark, sf)), K.BUCKET)
    return K.rounded(A.continuity_by_city(rep).withColumns({
        "records": F.col("records").cast("bigint"), "missing_buckets": F.col("missing_buckets").cast("bigint")}))
