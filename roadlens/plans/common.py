"""Shared stages for registered queries: Spark builders and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import traffic as TF
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import windows as W
from .registry import stage
from .views import TEST_BUCKET_MINUTES as BUCKET, TEST_HORIZONS_MINUTES as HORIZONS, TEST_NOW, Tables

N_LAGS = 12


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def fix_digits(c, digits: int = 6):
    """floor(x * 10^d + 0.5) / 10^d in plain double arithmetic: bit-identical in Spark and
    DuckDB (Spark's ``round`` rounds the decimal text of a double, DuckDB the binary value)."""
    scale = float(10 ** digits)
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def duck_fix(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 5e-1) / {scale})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engines sum floats in different orders)."""
    return df.withColumns({c: fix_digits(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def doubles_of(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float")]


# ---------------------------------------------------------------- Spark stages
def silver_traffic(t: Tables) -> DataFrame:
    return C.clean_traffic(t.traffic_obs, BUCKET)


def silver_weather(t: Tables) -> DataFrame:
    return C.clean_weather(t.weather_obs, BUCKET)


def _settle(df: DataFrame, cols) -> DataFrame:
    """Round averaged doubles to 9 digits so both engines feed identical values downstream."""
    return df.withColumns({c: fix_digits(c, 9) for c in cols})


def traffic_dedup(t: Tables) -> DataFrame:
    d = _settle(A.dedup_traffic(silver_traffic(t)), ("currentSpeed", "freeFlowSpeed", "jamFactor", "confidence"))
    return d.withColumn("congestion_ratio", TF.congestion_ratio())


def weather_dedup(t: Tables) -> DataFrame:
    return A.dedup_weather(silver_weather(t))


def traffic_lagged(t: Tables) -> DataFrame:
    return W.exact_lag_join(traffic_dedup(t), BUCKET, N_LAGS)


def latest(t: Tables) -> DataFrame:
    return W.latest_by_segment(traffic_dedup(t), ts="timestamp")


# ---------------------------------------------------------------- DuckDB stages
def duck_city(col: str) -> str:
    x = f"replace(replace(lower(trim({col})), 'ho_chi_minh', 'hcmc'), 'hochiminh', 'hcmc')"
    return (
        f"CASE WHEN {x} IN ('ha_noi', 'hà nội', 'hanoi') THEN 'hanoi' "
        f"WHEN {x} IN ('tp.hcm', 'tphcm', 'hcm', 'hcmc', 'ho chi minh') THEN 'hcmc' ELSE {x} END"
    )


def duck_floor(col: str, minutes: int = BUCKET) -> str:
    return f"time_bucket(INTERVAL ({minutes}) MINUTE, {col}, TIMESTAMP '1970-01-01')"


def duck_epoch(col: str) -> str:
    return f"epoch({col})"


stage("silver_traffic", f"""
SELECT event_id, source, city, segment_id, segment_name, weather_cell_id, lat, lon, event_time,
  currentSpeed, freeFlowSpeed, jamFactor, confidence, event_time AS timestamp, event_time AS source_time_bucket,
  {duck_floor('event_time')} AS time_bucket, strftime({duck_floor('event_time')}, '%Y-%m-%d') AS date
FROM (SELECT * REPLACE ({duck_city('city')} AS city) FROM traffic_obs) s
WHERE city IS NOT NULL AND segment_id IS NOT NULL AND event_time IS NOT NULL AND currentSpeed IS NOT NULL
  AND freeFlowSpeed IS NOT NULL AND jamFactor IS NOT NULL
  AND currentSpeed BETWEEN 0 AND 150 AND freeFlowSpeed BETWEEN 1 AND 180 AND jamFactor BETWEEN 0 AND 10
""", "traffic_obs")

stage("silver_weather", f"""
SELECT event_id, city, weather_cell_id, event_time, temp, humidity, pressure, visibility, rain_1h, wind_speed,
  event_time AS timestamp, event_time AS source_time_bucket, {duck_floor('event_time')} AS time_bucket
FROM (SELECT * REPLACE ({duck_city('city')} AS city) FROM weather_obs) s
WHERE city IS NOT NULL AND weather_cell_id IS NOT NULL AND event_time IS NOT NULL
  AND temp BETWEEN -50 AND 60 AND humidity BETWEEN 0 AND 100 AND visibility BETWEEN 0 AND 10000 AND wind_speed >= 0
""", "weather_obs")


def _last(col: str) -> str:
    return f"arg_max({col}, struct_pack(t := timestamp, e := event_id)) FILTER (WHERE {col} IS NOT NULL) AS {col}"


stage("traffic_dedup", f"""
SELECT *, least(greatest(CASE WHEN freeFlowSpeed > 0 THEN 1e0 - currentSpeed / freeFlowSpeed ELSE 0e0 END, 0e0), 1e0)
  AS congestion_ratio
FROM (
SELECT city, segment_id, time_bucket, max(timestamp) AS timestamp,
  {duck_fix('avg(currentSpeed)', 9)} AS currentSpeed, {duck_fix('avg(freeFlowSpeed)', 9)} AS freeFlowSpeed,
  {duck_fix('avg(jamFactor)', 9)} AS jamFactor, {duck_fix('avg(confidence)', 9)} AS confidence, {_last('lat')}, {_last('lon')}, {_last('source')}, {_last('segment_name')},
  {_last('weather_cell_id')}, {_last('date')}, count(*) AS rows_collapsed
FROM silver_traffic GROUP BY city, segment_id, time_bucket) g
""", "silver_traffic")

stage("weather_dedup", f"""
SELECT city, weather_cell_id, time_bucket, max(timestamp) AS timestamp,
  avg(temp) AS temp, avg(humidity) AS humidity, avg(pressure) AS pressure, avg(visibility) AS visibility,
  avg(rain_1h) AS rain_1h, avg(wind_speed) AS wind_speed, count(*) AS rows_collapsed
FROM silver_weather GROUP BY city, weather_cell_id, time_bucket
""", "silver_weather")


def _lag_joins(n: int, minutes: int) -> tuple[str, str]:
    cols, joins = [], []
    for k in range(1, n + 1):
        cols.append(f"l{k}.currentSpeed AS speed_lag_{k}, l{k}.congestion_ratio AS congestion_lag_{k}")
        joins.append(
            f"LEFT JOIN traffic_dedup l{k} ON l{k}.city = d.city AND l{k}.segment_id = d.segment_id "
            f"AND l{k}.time_bucket = d.time_bucket - INTERVAL ({k * minutes}) MINUTE"
        )
    return ",\n  ".join(cols), "\n".join(joins)


_LAG_COLS, _LAG_JOINS = _lag_joins(N_LAGS, BUCKET)
stage("traffic_lagged", f"""
SELECT *, speed_trend_1 - speed_trend_2 AS speed_acceleration FROM (
SELECT *, speed_lag_1 - speed_lag_2 AS speed_trend_1, speed_lag_2 - speed_lag_3 AS speed_trend_2 FROM (
SELECT d.*,
  {_LAG_COLS}
FROM traffic_dedup d
{_LAG_JOINS}) a) b
""", "traffic_dedup")

stage("latest", """
SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY city, segment_id ORDER BY timestamp DESC) AS _rn
  FROM traffic_dedup WHERE timestamp IS NOT NULL) x
WHERE _rn = 1
""", "traffic_dedup")

__all__ = ["BUCKET", "HORIZONS", "TEST_NOW", "N_LAGS"]
