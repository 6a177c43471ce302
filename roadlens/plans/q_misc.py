"""Registered queries: cleaning primitives, lakehouse-path features, dimension joins,
row windows, time features, health and counts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import timefn as T
from ..functions import traffic as TF
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import events as EV
from ..operators import features as FE
from ..operators import risk as R
from ..operators import windows as W
from . import common as K
from .q_gold import GOLD_OUT, gold
from .q_serving import serving
from .registry import oracle, register, round_sql, stage


def _city_variant():
    return (F.when(F.col("event_id") % 5 == 0, F.lit(" HaNoi ")).when(F.col("event_id") % 5 == 1, F.lit("ho_chi_minh"))
            .when(F.col("event_id") % 5 == 2, F.lit("TP.HCM")).when(F.col("event_id") % 5 == 3, F.lit("Hà Nội")).otherwise(F.col("city")))


_CITY_VARIANT_D = ("CASE event_id % 5 WHEN 0 THEN ' HaNoi ' WHEN 1 THEN 'ho_chi_minh' WHEN 2 THEN 'TP.HCM' WHEN 3 THEN 'Hà Nội' "
                   "ELSE city END")


@register("normalize_city", oracle(f"SELECT event_id, {K.duck_city(_CITY_VARIANT_D)} AS city FROM traffic_obs", "traffic_obs"))
def q_normalize_city(spark, sf):
    t = K.tables(spark, sf).traffic_obs
    return t.select("event_id", TF.normalize_city(_city_variant()).alias("city"))


@register("to_local_time", oracle("""
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE date_trunc('second', event_time) + INTERVAL 7 HOUR END AS local_time
FROM traffic_obs""", "traffic_obs"))
def q_to_local_time(spark, sf):
    t = K.tables(spark, sf).traffic_obs
    s = F.when(F.col("event_id") % 13 == 0, F.lit("not-a-time")).otherwise(
        F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return t.select("event_id", T.to_local_time(s).alias("local_time"))


@register("floor_bucket", oracle("""
SELECT event_id, time_bucket(INTERVAL 5 MINUTE, event_time, TIMESTAMP '1970-01-01') AS bucket_5m,
  time_bucket(INTERVAL 60 MINUTE, event_time, TIMESTAMP '1970-01-01') AS bucket_60m FROM traffic_obs""", "traffic_obs"))
def q_floor_bucket(spark, sf):
    t = K.tables(spark, sf).traffic_obs
    return t.select("event_id", T.floor_bucket("event_time", 5).alias("bucket_5m"), T.floor_bucket("event_time", 60).alias("bucket_60m"))


@register("coerce_numeric", oracle("""
SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(currentSpeed AS VARCHAR) END AS DOUBLE) AS currentSpeed
FROM traffic_obs""", "traffic_obs"))
def q_coerce_numeric(spark, sf):
    t = K.tables(spark, sf).traffic_obs
    s = t.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("currentSpeed").cast("string")).alias("currentSpeed"))
    return C.coerce_numeric(s, ["currentSpeed"])


@register("null_flags_and_drop", oracle("""
SELECT event_id, jamFactor IS NULL AS has_null_jamFactor, currentSpeed IS NULL AS has_null_currentSpeed FROM traffic_obs
WHERE currentSpeed IS NOT NULL AND event_time IS NOT NULL AND segment_id IS NOT NULL""", "traffic_obs"))
def q_null_flags_and_drop(spark, sf):
    d = C.null_flags_and_drop(K.tables(spark, sf).traffic_obs, "traffic")
    return d.select("event_id", "has_null_jamFactor", "has_null_currentSpeed")


def _box_sql():
    parts = [f"(city = '{c}' AND lat BETWEEN {a!r} AND {b!r} AND lon BETWEEN {cc!r} AND {d!r})" for c, (a, b, cc, d) in TF.CITY_BOXES.items()]
    return " OR ".join(parts)


@register("bbox_filter", oracle(f"SELECT event_id FROM traffic_obs WHERE {_box_sql()}", "traffic_obs"))
def q_bbox_filter(spark, sf):
    return C.bbox_filter(K.tables(spark, sf).traffic_obs).select("event_id")


def _detect_sql():
    parts = [f"WHEN lat BETWEEN {a!r} AND {b!r} AND lon BETWEEN {c!r} AND {d!r} THEN '{TF.CITY_LABELS[n]}'"
             for n, (a, b, c, d) in TF.CITY_BOXES.items()]
    return "CASE " + " ".join(parts) + " END"


@register("detect_city_by_point", oracle(f"SELECT event_id, {_detect_sql()} AS detected_city FROM traffic_obs", "traffic_obs"))
def q_detect_city_by_point(spark, sf):
    return K.tables(spark, sf).traffic_obs.select("event_id", TF.detect_city_by_point().alias("detected_city"))


@register("flag_outliers", oracle("""
SELECT event_id, currentSpeed < 0 OR currentSpeed > 150 OR jamFactor < 0 OR jamFactor > 10 AS is_outlier FROM traffic_obs""", "traffic_obs"))
def q_flag_outliers(spark, sf):
    return C.flag_outliers(K.tables(spark, sf).traffic_obs).select("event_id", "is_outlier")


@register("flag_invalid_weather", oracle("""
SELECT event_id, temp < -50 OR temp > 60 OR humidity < 0 OR humidity > 100 OR pressure < 800 OR pressure > 1100 OR visibility < 0
  OR visibility > 10000 OR wind_speed < 0 AS is_invalid FROM weather_obs""", "weather_obs"))
def q_flag_invalid_weather(spark, sf):
    return C.flag_invalid_weather(K.tables(spark, sf).weather_obs).select("event_id", "is_invalid")


@register("clean_traffic_lakehouse", oracle(f"""
SELECT event_id, strftime(event_time + INTERVAL 7 HOUR, '%Y-%m-%d') AS date FROM traffic_obs
WHERE currentSpeed IS NOT NULL AND event_time IS NOT NULL AND segment_id IS NOT NULL AND ({_box_sql()})
  AND (currentSpeed < 0 OR currentSpeed > 150 OR jamFactor < 0 OR jamFactor > 10) = false""", "traffic_obs"))
def q_clean_traffic_lakehouse(spark, sf):
    return C.clean_traffic_lakehouse(K.tables(spark, sf).traffic_obs).select("event_id", "date")


# ---------------------------------------------------------------- schema healing, record shaping
@register("heal_schema", round_sql(oracle("""
SELECT segment_id, city, current_speed AS currentSpeed, time_bucket AS timestamp, segment_id AS segment_name,
  CASE WHEN city = 'hcmc' THEN 10.7769e0 ELSE 21.0278e0 END + (('0x' || substr(sha1(segment_id), 1, 8))::UBIGINT / 4294967295e0 - 5e-1) * 8e-2 AS lat,
  CASE WHEN city = 'hcmc' THEN 106.7009e0 ELSE 105.8342e0 END + (('0x' || substr(sha1(segment_id), 9, 8))::UBIGINT / 4294967295e0 - 5e-1) * 8e-2 AS lon
FROM (SELECT segment_id, city, time_bucket, currentSpeed AS current_speed FROM traffic_dedup) x""", "traffic_dedup"),
    ["currentSpeed", "lat", "lon"]))
def q_heal_schema(spark, sf):
    d = K.traffic_dedup(K.tables(spark, sf)).select("segment_id", "city", "time_bucket", F.col("currentSpeed").alias("current_speed"))
    h = FE.heal_schema(d)
    return K.rounded(h.select("segment_id", "city", "currentSpeed", "timestamp", "segment_name", "lat", "lon"))


@register("shape_traffic_record", round_sql(oracle("""
SELECT event_id, currentSpeed, freeFlowSpeed, lat + 1e-3 AS lat, lon + 1e-3 AS lon,
  CASE WHEN freeFlowSpeed > 0 THEN currentSpeed / freeFlowSpeed END AS congestion_ratio,
  coalesce(jamFactor, round_even(least(greatest(CASE WHEN freeFlowSpeed > 0 THEN (1e0 - currentSpeed / freeFlowSpeed) * 10e0 ELSE 0e0 END, 0e0), 10e0), 2))
    AS jamFactor
FROM traffic_obs""", "traffic_obs"), ["currentSpeed", "freeFlowSpeed", "lat", "lon", "congestion_ratio", "jamFactor"]))
def q_shape_traffic_record(spark, sf):
    t = K.tables(spark, sf).traffic_obs
    pts = F.array(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")),
                  F.struct((F.col("lat") + 1e-3).alias("latitude"), (F.col("lon") + 1e-3).alias("longitude")))
    raw = F.to_json(F.struct(F.struct("currentSpeed", "freeFlowSpeed", "confidence", "jamFactor",
                                      F.struct(pts.alias("coordinate")).alias("coordinates")).alias("flowSegmentData")))
    s = FE.shape_traffic_record(t.select("event_id", raw.alias("raw")))
    return K.rounded(s.select("event_id", "currentSpeed", "freeFlowSpeed", "lat", "lon", "congestion_ratio", "jamFactor"))


@register("shape_weather_record", round_sql(oracle("""
SELECT event_id, temp, humidity, pressure, wind_speed, CASE WHEN rain_1h > 0 THEN rain_1h ELSE 0e0 END AS rain_1h, visibility,
  CASE WHEN event_id % 2 = 0 THEN 'Rain' ELSE 'Clouds' END AS weather_main FROM weather_obs""", "weather_obs"),
    ["temp", "humidity", "pressure", "wind_speed", "rain_1h", "visibility"]))
def q_shape_weather_record(spark, sf):
    w = K.tables(spark, sf).weather_obs
    raw = F.to_json(F.struct(
        F.struct("temp", "humidity", "pressure").alias("main"), F.struct(F.col("wind_speed").alias("speed")).alias("wind"),
        F.when(F.col("rain_1h") > 0, F.struct(F.col("rain_1h").alias("1h"))).alias("rain"), "visibility",
        F.array(F.struct(F.when(F.col("event_id") % 2 == 0, "Rain").otherwise("Clouds").alias("main"))).alias("weather")))
    s = FE.shape_weather_record(w.select("event_id", raw.alias("raw")))
    return K.rounded(s.select("event_id", "temp", "humidity", "pressure", "wind_speed", "rain_1h", "visibility", "weather_main"))


def _geometry(t):
    """Geometry text per latest segment: [lon, lat] pairs, {lon, lat} objects, or a single point."""
    s = K.latest(t).select("segment_id", "lat", "lon")
    k = F.conv(F.substring("segment_id", 5, 10), 10, 10).cast("int") % 3
    pairs = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.array("lon", "lat"), F.array(F.col("lon") + 0.01, F.col("lat") + 0.01)).alias("coordinates")))
    objs = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + 0.01).alias("lon"), (F.col("lat") + 0.01).alias("lat"))).alias("coordinates")))
    single = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.array("lon", "lat")).alias("coordinates")))
    return s.withColumn("geometry", F.when(k == 0, pairs).when(k == 1, objs).otherwise(single))


_GEOM_SQL = """
SELECT segment_id, CASE WHEN CAST(substr(segment_id, 5) AS INTEGER) % 3 IN (0, 1)
  THEN [[lon, lat], [lon + 1e-2, lat + 1e-2]]
  ELSE [[lon - 6e-3, lat - 6e-3], [lon, lat], [lon + 6e-3, lat + 6e-3]]
  END AS coords FROM latest"""
stage("geom", _GEOM_SQL, "latest")


@register("parse_geometry", oracle("SELECT * FROM geom", "geom"))
def q_parse_geometry(spark, sf):
    g = _geometry(K.tables(spark, sf))
    return g.select("segment_id", F.transform(FE.parse_geometry("geometry"), lambda p: F.array(p["lon"], p["lat"])).alias("coords"))


VIEWPORT = "105.8,20.95,105.9,21.05"


@register("bbox_any_vertex", oracle("""
SELECT segment_id FROM geom WHERE len(list_filter(coords, lambda p: p[1] BETWEEN 105.8 AND 105.9 AND p[2] BETWEEN 20.95 AND 21.05)) > 0""", "geom"))
def q_bbox_any_vertex(spark, sf):
    g = _geometry(K.tables(spark, sf)).select("segment_id", FE.parse_geometry("geometry").alias("coords"))
    return FE.bbox_any_vertex(g, "coords", VIEWPORT).select("segment_id")


@register("geojson_features")
def q_geojson_features(spark, sf):
    """Rows-only: one GeoJSON Feature text per top segment per city (layout differs across engines)."""
    from ..operators.serving import top_n_per_city

    t = K.tables(spark, sf)
    s = top_n_per_city(serving(t), 250).join(_geometry(t).select("segment_id", "geometry"), "segment_id")
    coords = F.transform(FE.parse_geometry("geometry"), lambda p: F.array(p["lon"], p["lat"]))
    feat = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"),
                    F.struct("segment_id", "city", F.col("jamFactor").alias("jam_factor"), F.col("currentSpeed").alias("speed"),
                             TF.severity_from_jam("jamFactor").alias("severity")).alias("properties"))
    return s.select("city", "segment_id", F.to_json(feat).alias("feature"))


# ---------------------------------------------------------------- lakehouse feature groups
stage("b_pct", """
SELECT segment_id, hour(time_bucket) AS hour_of_day, isodow(time_bucket) - 1 AS day_of_week,
  quantile_cont(currentSpeed, 0.15) AS p15, quantile_cont(currentSpeed, 0.5) AS p50, quantile_cont(currentSpeed, 0.85) AS p85
FROM traffic_dedup WHERE city = 'hanoi' GROUP BY ALL""", "traffic_dedup")


@register("join_percentile_lookup", round_sql(oracle("""
SELECT city, segment_id, time_bucket, p15, p50, p85,
  CASE WHEN p50 > 0 THEN 1e0 - freeFlowSpeed * 8e-1 / p50 ELSE 5e-1 END AS baseline_congestion_ratio,
  CASE WHEN currentSpeed <= p15 THEN 0e0 WHEN currentSpeed >= p85 THEN 1e0 ELSE (currentSpeed - p15) / (p85 - p15) END AS speed_percentile_position,
  CASE WHEN currentSpeed >= p15 AND currentSpeed < p50 THEN 1 ELSE 0 END AS is_between_p15_p50
FROM (SELECT d.city, d.segment_id, d.time_bucket, d.currentSpeed, d.freeFlowSpeed, coalesce(l.p15, 20e0) AS p15,
        coalesce(l.p50, 30e0) AS p50, coalesce(l.p85, 40e0) AS p85
      FROM traffic_dedup d LEFT JOIN b_pct l ON l.segment_id = d.segment_id AND l.hour_of_day = hour(d.time_bucket)
        AND l.day_of_week = isodow(d.time_bucket) - 1) x""", "traffic_dedup", "b_pct"),
    ["p15", "p50", "p85", "baseline_congestion_ratio", "speed_percentile_position"]))
def q_join_percentile_lookup(spark, sf):
    d = K.traffic_dedup(K.tables(spark, sf)).withColumns({"hour_of_day": F.hour("time_bucket"), "day_of_week": F.weekday("time_bucket")})
    lookup = A.speed_percentiles(d.filter(F.col("city") == "hanoi"), ("segment_id", "hour_of_day", "day_of_week"))
    j = FE.join_percentile_lookup(d, lookup)
    return K.rounded(j.select("city", "segment_id", "time_bucket", "p15", "p50", "p85", "baseline_congestion_ratio",
                              "speed_percentile_position", "is_between_p15_p50"))


@register("join_segment_dim", round_sql(oracle("""
SELECT s.segment_id, coalesce(d.road_class, 'unknown') AS road_class, coalesce(d.district, 'unknown') AS district,
  coalesce(d.length_m, 100e0) AS length_m, coalesce(d.speed_limit, 50e0) AS speed_limit,
  CASE coalesce(d.road_class, 'unknown') WHEN 'motorway' THEN 5 WHEN 'trunk' THEN 4 WHEN 'primary' THEN 3 WHEN 'secondary' THEN 2
    WHEN 'residential' THEN 1 ELSE 0 END AS road_class_encoded,
  CASE WHEN coalesce(d.length_m, 100e0) < 50 THEN 1 ELSE 0 END AS is_short_segment,
  CASE WHEN coalesce(d.speed_limit, 50e0) >= 80 THEN 3 WHEN coalesce(d.speed_limit, 50e0) >= 50 THEN 2
    WHEN coalesce(d.speed_limit, 50e0) >= 30 THEN 1 ELSE 0 END AS speed_limit_encoded,
  CASE WHEN s.lat > 20.8 AND s.lon > 105.8 THEN 1 WHEN s.lat > 20.8 AND s.lon <= 105.8 THEN 2 WHEN s.lat <= 20.8 AND s.lon > 105.8 THEN 3
    ELSE 4 END AS direction_quadrant
FROM latest s LEFT JOIN segment_dim d USING (segment_id)""", "latest", "segment_dim"), ["length_m", "speed_limit"]))
def q_join_segment_dim(spark, sf):
    t = K.tables(spark, sf)
    j = FE.join_segment_dim(K.latest(t).select("segment_id", "lat", "lon"), t.segment_dim)
    return K.rounded(j.select("segment_id", "road_class", "district", "length_m", "speed_limit", "road_class_encoded", "is_short_segment",
                              "speed_limit_encoded", "direction_quadrant"))


@register("join_centrality", round_sql(oracle("""
SELECT segment_id, dc, CASE WHEN dc > 7e-1 THEN 2 WHEN dc > 3e-1 THEN 1 ELSE 0 END AS degree_centrality_encoded,
  4e-1 * dc + 4e-1 * 5e-1 + 2e-1 * 5e-1 AS network_importance_score
FROM (SELECT s.segment_id, coalesce(d.degree_centrality, 5e-1) AS dc FROM latest s LEFT JOIN (
  SELECT segment_id, CAST(substr(segment_id, 5) AS INTEGER) % 10 / 10e0 AS degree_centrality FROM latest
  WHERE CAST(substr(segment_id, 5) AS INTEGER) % 4 <> 0) d USING (segment_id)) x""", "latest"), ["dc", "network_importance_score"]))
def q_join_centrality(spark, sf):
    t = K.tables(spark, sf)
    lat = K.latest(t).select("segment_id")
    num = F.substring("segment_id", 5, 10).cast("int")
    cent = lat.filter(num % 4 != 0).select("segment_id", ((num % 10) / 10.0).alias("degree_centrality"),
                                           F.lit(None).cast("double").alias("betweenness_centrality"),
                                           F.lit(None).cast("double").alias("closeness_centrality"))
    j = FE.join_centrality(lat, cent)
    return K.rounded(j.select("segment_id", F.col("degree_centrality").alias("dc"), "degree_centrality_encoded", "network_importance_score"))


@register("district_density", oracle("""
SELECT s.segment_id, coalesce(d.district, 'unknown') AS district, count(*) OVER (PARTITION BY s.city, coalesce(d.district, 'unknown')) AS district_segment_count
FROM latest s LEFT JOIN segment_dim d USING (segment_id)""", "latest", "segment_dim"))
def q_district_density(spark, sf):
    t = K.tables(spark, sf)
    j = FE.join_segment_dim(K.latest(t).select("segment_id", "city", "lat", "lon"), t.segment_dim)
    return W.district_density(j).select("segment_id", "district", "district_segment_count")


# ---------------------------------------------------------------- lakehouse windows
def _silver_b(t):
    s = K.silver_traffic(t).select("event_id", "city", "segment_id", "timestamp", "currentSpeed", "freeFlowSpeed")
    return s.withColumn("congestion_ratio", TF.congestion_ratio())


stage("silver_b", """
SELECT event_id, city, segment_id, timestamp, currentSpeed, freeFlowSpeed,
  least(greatest(CASE WHEN freeFlowSpeed > 0 THEN 1e0 - currentSpeed / freeFlowSpeed ELSE 0e0 END, 0e0), 1e0) AS congestion_ratio
FROM silver_traffic""", "silver_traffic")


@register("row_lags", round_sql(oracle("""
SELECT event_id, coalesce(l1, 0e0) AS speed_lag_1, coalesce(l2, 0e0) AS speed_lag_2, coalesce(l4, 0e0) AS speed_lag_4,
  coalesce(c1, 0e0) AS congestion_lag_1, coalesce(currentSpeed - l1, 0e0) AS speed_trend_1,
  coalesce((currentSpeed - l1) - (l1 - l2), 0e0) AS speed_acceleration
FROM (SELECT *, lag(currentSpeed, 1) OVER w AS l1, lag(currentSpeed, 2) OVER w AS l2, lag(currentSpeed, 4) OVER w AS l4,
        lag(congestion_ratio, 1) OVER w AS c1 FROM silver_b WINDOW w AS (PARTITION BY segment_id ORDER BY timestamp)) x""", "silver_b"),
    ["speed_lag_1", "speed_lag_2", "speed_lag_4", "congestion_lag_1", "speed_trend_1", "speed_acceleration"]))
def q_row_lags(spark, sf):
    d = W.row_lags(_silver_b(K.tables(spark, sf)))
    return K.rounded(d.select("event_id", "speed_lag_1", "speed_lag_2", "speed_lag_4", "congestion_lag_1", "speed_trend_1", "speed_acceleration"))


@register("rolling_time_stats", round_sql(oracle("""
SELECT event_id,
  coalesce(avg(currentSpeed) OVER (PARTITION BY segment_id ORDER BY e RANGE BETWEEN 300 PRECEDING AND CURRENT ROW), 0e0) AS speed_rolling_avg_5m,
  coalesce(avg(currentSpeed) OVER (PARTITION BY segment_id ORDER BY e RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW), 0e0) AS speed_rolling_avg_30m,
  coalesce(avg(congestion_ratio) OVER (PARTITION BY segment_id ORDER BY e RANGE BETWEEN 900 PRECEDING AND CURRENT ROW), 0e0) AS congestion_rolling_avg_15m,
  coalesce(stddev_samp(currentSpeed) OVER (PARTITION BY segment_id ORDER BY e RANGE BETWEEN 900 PRECEDING AND CURRENT ROW), 0e0) AS speed_volatility_15m
FROM (SELECT *, CAST(floor(epoch_us(timestamp) / 1000000) AS BIGINT) AS e FROM silver_b) x""", "silver_b"),
    ["speed_rolling_avg_5m", "speed_rolling_avg_30m", "congestion_rolling_avg_15m", "speed_volatility_15m"]))
def q_rolling_time_stats(spark, sf):
    d = W.rolling_time_stats(_silver_b(K.tables(spark, sf)))
    return K.rounded(d.select("event_id", "speed_rolling_avg_5m", "speed_rolling_avg_30m", "congestion_rolling_avg_15m", "speed_volatility_15m"))


@register("row_lead_targets", round_sql(oracle("""
SELECT * FROM (SELECT event_id, lead(currentSpeed, 3) OVER w AS future_speed_15m, lead(currentSpeed, 12) OVER w AS future_speed_60m,
  lead(currentSpeed, 48) OVER w AS future_speed_240m FROM silver_b WINDOW w AS (PARTITION BY segment_id ORDER BY timestamp)) x
WHERE future_speed_15m IS NOT NULL OR future_speed_60m IS NOT NULL OR future_speed_240m IS NOT NULL""", "silver_b"),
    ["future_speed_15m", "future_speed_60m", "future_speed_240m"]))
def q_row_lead_targets(spark, sf):
    d = W.row_lead_targets(_silver_b(K.tables(spark, sf)))
    return K.rounded(d.select("event_id", "future_speed_15m", "future_speed_60m", "future_speed_240m"))


@register("timestamp_inversions", oracle("""
SELECT city, segment_id, CAST(coalesce(sum(CASE WHEN inv THEN 1 ELSE 0 END), 0) AS BIGINT) AS inversions,
  CAST(count(*) FILTER (WHERE ts IS NULL) AS BIGINT) AS null_times
FROM (SELECT city, segment_id, ts, ts < lag(ts) OVER (PARTITION BY city, segment_id ORDER BY ord) AS inv FROM (
  SELECT city, segment_id, event_id AS ord, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_time - to_minutes(CAST(event_id % 5 AS INTEGER) * 600) END AS ts
  FROM traffic_obs) a) b GROUP BY city, segment_id""", "traffic_obs"))
def q_timestamp_inversions(spark, sf):
    t = K.tables(spark, sf).traffic_obs
    ts = F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.col("event_time") - F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("event_id") % 5) * 600).cast("int")))
    d = t.select("city", "segment_id", F.col("event_id").alias("ord"), ts.alias("ts"))
    return W.timestamp_inversions(d, ["city", "segment_id"], "ts", "ord")


@register("dedup_first_key", oracle("""
SELECT segment_id, time_bucket, source, arg_min(event_id, struct_pack(t := timestamp, e := event_id)) AS event_id
FROM silver_traffic GROUP BY segment_id, time_bucket, source""", "silver_traffic"))
def q_dedup_first_key(spark, sf):
    s = K.silver_traffic(K.tables(spark, sf)).select("segment_id", "time_bucket", "source", "timestamp", "event_id")
    d = A.dedup_first_key(s, ["segment_id", "time_bucket", "source"], ["timestamp", "event_id"])
    return d.select("segment_id", "time_bucket", "source", "event_id")


# ---------------------------------------------------------------- time and geo features
HOLIDAYS = ("2024-01-01",)


@register("temporal_features", oracle(f"""
SELECT city, segment_id, time_bucket, CAST(hour(time_bucket) AS INTEGER) AS hour_of_day, CAST(isodow(time_bucket) - 1 AS INTEGER) AS day_of_week,
  CAST(day(time_bucket) AS INTEGER) AS day_of_month, CAST(month(time_bucket) AS INTEGER) AS month_of_year,
  CAST(weekofyear(time_bucket) AS INTEGER) AS week_of_year,
  strftime(time_bucket, '%Y-%m-%d') AS date, CAST(isodow(time_bucket) IN (6, 7) AS INTEGER) AS is_weekend,
  CAST(hour(time_bucket) IN (7, 8, 9, 16, 17, 18, 19) AS INTEGER) AS is_peak_hour,
  CAST(strftime(time_bucket, '%Y-%m-%d') IN ('2024-01-01') AS INTEGER) AS is_holiday
FROM traffic_dedup""", "traffic_dedup"))
def q_temporal_features(spark, sf):
    d = K.traffic_dedup(K.tables(spark, sf))
    return d.select("city", "segment_id", "time_bucket", *[v.alias(k) for k, v in T.temporal_features("time_bucket", holidays=HOLIDAYS).items()])


@register("cyclic_time", round_sql(oracle(f"""
SELECT event_id, sin({2 * math.pi!r} * hour(event_time) / 24e0) AS hour_sin, cos({2 * math.pi!r} * hour(event_time) / 24e0) AS hour_cos,
  sin({2 * math.pi!r} * (isodow(event_time) - 1) / 7e0) AS dow_sin, cos({2 * math.pi!r} * (isodow(event_time) - 1) / 7e0) AS dow_cos
FROM traffic_obs""", "traffic_obs"), ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]))
def q_cyclic_time(spark, sf):
    t = K.tables(spark, sf).traffic_obs
    return K.rounded(t.select("event_id", *[v.alias(k) for k, v in T.cyclic_time("event_time").items()]))


@register("haversine_km", round_sql(oracle("""
SELECT event_id, 2 * 6371e0 * asin(sqrt(pow(sin((radians(c_lat) - radians(lat)) / 2), 2)
  + cos(radians(lat)) * cos(radians(c_lat)) * pow(sin((radians(c_lon) - radians(lon)) / 2), 2))) AS km_to_centre
FROM (SELECT event_id, lat, lon, CASE WHEN city = 'hcmc' THEN 10.7769e0 ELSE 21.0278e0 END AS c_lat,
        CASE WHEN city = 'hcmc' THEN 106.7009e0 ELSE 105.8342e0 END AS c_lon FROM traffic_obs) x""", "traffic_obs"), ["km_to_centre"]))
def q_haversine_km(spark, sf):
    t = K.tables(spark, sf).traffic_obs
    c_lat = F.when(F.col("city") == "hcmc", TF.CITY_CENTRES["hcmc"][0]).otherwise(TF.CITY_CENTRES["hanoi"][0])
    c_lon = F.when(F.col("city") == "hcmc", TF.CITY_CENTRES["hcmc"][1]).otherwise(TF.CITY_CENTRES["hanoi"][1])
    return K.rounded(t.select("event_id", TF.haversine_km("lat", "lon", c_lat, c_lon).alias("km_to_centre")))


# ---------------------------------------------------------------- merges and status joins
@register("merge_event_features", oracle(f"""
SELECT d.city, d.segment_id, d.time_bucket, coalesce(e.news_event_count_6h, 0) AS news_event_count_6h,
  greatest(0, coalesce(e.has_recent_accident, 0)) AS has_accident, CAST(coalesce(e.news_event_count_6h, 0) > 0 AS INTEGER) AS has_any_event,
  CAST(coalesce(e.max_event_severity_1h, 0) AS INTEGER) AS max_event_severity_1h
FROM traffic_dedup d LEFT JOIN event_feats e ON e.city = d.city AND e.time_bucket = d.time_bucket""", "traffic_dedup", "event_feats"))
def q_merge_event_features(spark, sf):
    t = K.tables(spark, sf)
    d = K.traffic_dedup(t)
    m = EV.merge_event_features(d, EV.event_grid_join(d, t.incident_obs))
    return m.select("city", "segment_id", "time_bucket", "news_event_count_6h", "has_accident", "has_any_event", "max_event_severity_1h")


@register("join_prediction_baseline", round_sql(oracle("""
SELECT s.segment_id, s.predicted_speed, l.p15, l.p50
FROM serving s LEFT JOIN pct_lookup l ON l.city = s.city AND l.segment_id = s.segment_id AND l.hour_of_day = hour(s.time_bucket)
  AND l.day_of_week = isodow(s.time_bucket) - 1""", "serving", "pct_lookup"), ["predicted_speed", "p15", "p50"]))
def q_join_prediction_baseline(spark, sf):
    t = K.tables(spark, sf)
    s = serving(t).select("city", "segment_id", "time_bucket", "predicted_speed").withColumns(
        {"hour_of_day": F.hour("time_bucket"), "day_of_week": F.weekday("time_bucket")})
    d = K.traffic_dedup(t).withColumns({"hour_of_day": F.hour("time_bucket"), "day_of_week": F.weekday("time_bucket")})
    lookup = A.speed_percentiles(d)
    j = s.join(lookup, ["city", "segment_id", "hour_of_day", "day_of_week"], "left")
    return K.rounded(j.select("segment_id", "predicted_speed", "p15", "p50"))


def _actions(alerts):
    """Operator status history derived from the alerts: ack / dismiss by segment number, and a
    later re-activation for some."""
    num = F.substring("segment_id", 5, 10).cast("int")
    first = alerts.select("alert_id", F.when(num % 3 == 0, "acknowledged").when(num % 3 == 1, "dismissed").alias("status"),
                          F.col("timestamp").alias("updated_at")).filter(F.col("status").isNotNull())
    again = alerts.filter(num % 6 == 1).select("alert_id", F.lit("active").alias("status"),
                                               (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("updated_at"))
    return first.unionByName(again)


@register("join_operator_actions", oracle("""
SELECT a.alert_id, coalesce(s.status, 'active') AS status, coalesce(s.status, 'active') = 'acknowledged' AS acknowledged
FROM (SELECT concat('alert_', city, '_', segment_id) AS alert_id, segment_id, timestamp FROM serving WHERE jamFactor >= 3) a
LEFT JOIN (SELECT alert_id, arg_max(status, struct_pack(u := updated_at, s := status)) AS status FROM (
    SELECT concat('alert_', city, '_', segment_id) AS alert_id,
      CASE WHEN CAST(substr(segment_id, 5) AS INTEGER) % 3 = 0 THEN 'acknowledged' WHEN CAST(substr(segment_id, 5) AS INTEGER) % 3 = 1 THEN 'dismissed' END AS status,
      timestamp AS updated_at FROM serving WHERE jamFactor >= 3 AND CAST(substr(segment_id, 5) AS INTEGER) % 3 IN (0, 1)
    UNION ALL SELECT concat('alert_', city, '_', segment_id), 'active', timestamp + INTERVAL 1 HOUR FROM serving
      WHERE jamFactor >= 3 AND CAST(substr(segment_id, 5) AS INTEGER) % 6 = 1) h GROUP BY alert_id) s USING (alert_id)
WHERE coalesce(s.status, 'active') <> 'dismissed'""", "serving"))
def q_join_operator_actions(spark, sf):
    alerts = R.jam_alerts(serving(K.tables(spark, sf)))
    out = R.join_operator_actions(alerts, _actions(alerts))
    return out.select("alert_id", "status", "acknowledged")


# ---------------------------------------------------------------- health and counts
def pipeline_health(frames: dict, now: str, ts: str = "timestamp"):
    out = None
    for name, df in frames.items():
        age = (F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.max(ts).cast("timestamp"))) / F.lit(3.6e9)
        one = df.agg(F.count(F.lit(1)).alias("rows"),
                     (F.count_distinct("segment_id") if "segment_id" in df.columns else F.lit(None).cast("bigint")).alias("segments"),
                     F.count_distinct("city").alias("cities"), F.max(ts).alias("latest"), age.alias("age_hours"))
        one = one.select(F.lit(name).alias("dataset"), "*").withColumn(
            "status", F.when(F.col("age_hours") <= 24, "healthy").when(F.col("age_hours") <= 168, "degraded").otherwise("unhealthy"))
        out = one if out is None else out.unionByName(one)
    return out


def _health_sql(name, table, seg):
    return (f"SELECT '{name}' AS dataset, count(*) AS rows, {'count(DISTINCT segment_id)' if seg else 'CAST(NULL AS BIGINT)'} AS segments, "
            f"count(DISTINCT city) AS cities, max(timestamp) AS latest, "
            f"(epoch_us(TIMESTAMP '{K.TEST_NOW}') - epoch_us(max(timestamp))) / 3.6e9 AS age_hours FROM {table}")


@register("pipeline_health", round_sql(oracle(f"""
SELECT *, CASE WHEN age_hours <= 24 THEN 'healthy' WHEN age_hours <= 168 THEN 'degraded' ELSE 'unhealthy' END AS status FROM (
{_health_sql('silver_traffic', 'silver_traffic', True)} UNION ALL {_health_sql('silver_weather', 'silver_weather', False)}) x""",
    "silver_traffic", "silver_weather"), ["age_hours"]))
def q_pipeline_health(spark, sf):
    t = K.tables(spark, sf)
    return K.rounded(pipeline_health({"silver_traffic": K.silver_traffic(t), "silver_weather": K.silver_weather(t)}, K.TEST_NOW))


def bronze_counts(frames: dict):
    """Row count per table; a missing table (None) is reported as WARN with null rows."""
    out = None
    spark = next(v for v in frames.values() if v is not None).sparkSession
    for name, df in frames.items():
        if df is None:
            one = spark.createDataFrame([(name, None, "WARN")], "table string, rows bigint, status string")
        else:
            one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit("PASS").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


@register("bronze_counts", oracle("""
SELECT 'traffic_obs' AS "table", count(*) AS rows, 'PASS' AS status FROM traffic_obs
UNION ALL SELECT 'weather_obs', count(*), 'PASS' FROM weather_obs
UNION ALL SELECT 'incident_obs', count(*), 'PASS' FROM incident_obs
UNION ALL SELECT 'news_raw', count(*), 'PASS' FROM news_raw
UNION ALL SELECT 'stats_lookup', NULL, 'WARN'""", "traffic_obs", "weather_obs", "incident_obs", "news_raw"))
def q_bronze_counts(spark, sf):
    t = K.tables(spark, sf)
    return bronze_counts({"traffic_obs": t.traffic_obs, "weather_obs": t.weather_obs, "incident_obs": t.incident_obs,
                          "news_raw": t.news_raw, "stats_lookup": None})


# ---------------------------------------------------------------- polylines, serving frame, path B gold
def _road_type(col):
    return F.when(F.col(col).isin("motorway", "trunk"), "Highway").when(F.col(col) == "residential", "Collector").otherwise("Arterial")


@register("split_polyline", round_sql(oracle("""
SELECT segment_id, leg, piece, lo1 + (lo2 - lo1) * (piece / n) AS lon1, la1 + (la2 - la1) * (piece / n) AS lat1,
  lo1 + (lo2 - lo1) * ((piece + 1) / n) AS lon2, la1 + (la2 - la1) * ((piece + 1) / n) AS lat2
FROM (SELECT *, unnest(range(0, n)) AS piece FROM (
  SELECT segment_id, leg, lo1, la1, lo2, la2,
    greatest(1, least(6, CAST(ceil(2 * 6371e0 * asin(sqrt(pow(sin((radians(la2) - radians(la1)) / 2), 2)
      + cos(radians(la1)) * cos(radians(la2)) * pow(sin((radians(lo2) - radians(lo1)) / 2), 2))) / t) AS INTEGER))) AS n
  FROM (SELECT g.segment_id, i - 1 AS leg, g.coords[i][1] AS lo1, g.coords[i][2] AS la1, g.coords[i + 1][1] AS lo2, g.coords[i + 1][2] AS la2,
          CASE WHEN d.road_class IN ('motorway', 'trunk') THEN 85e-2 * 1.25e0 WHEN d.road_class = 'residential' THEN 85e-2 * 85e-2 ELSE 85e-2 END AS t
        FROM geom g LEFT JOIN segment_dim d USING (segment_id), range(1, len(g.coords)) r(i)) a) b) c""", "geom", "segment_dim"),
    ["lon1", "lat1", "lon2", "lat2"]))
def q_split_polyline(spark, sf):
    t = K.tables(spark, sf)
    g = _geometry(t).select("segment_id", FE.parse_geometry("geometry").alias("coords"))
    g = g.join(t.segment_dim.select("segment_id", "road_class"), "segment_id", "left").withColumn("road_type", _road_type("road_class"))
    out = FE.split_polyline(g, "coords", "road_type", 13)
    # cast the piece index to match the oracle's integer types
    return K.rounded(out.select("segment_id", F.col("leg").cast("bigint"), F.col("piece").cast("bigint"), "lon1", "lat1", "lon2", "lat2"))


_SERVED = {*GOLD_OUT, "district", "road_class", "length_m", "speed_limit", "predicted_speed"}
_ALIASES = FE.serving_aliases(GOLD_OUT)
_NUMBERS = ", ".join(f"coalesce(CAST({v} AS DOUBLE), 0e0) AS {k}" if v in _SERVED else f"0e0 AS {k}" for k, v in _ALIASES.items())
_TEXTS = ", ".join(f"coalesce({v}, 'unknown') AS {k}" for k, v in FE.SERVING_TEXT_ALIASES.items())
_MISSING = " + ".join(f"CAST({v} IS NULL AS INTEGER)" if v in _SERVED else "1" for v in [*_ALIASES.values(), *FE.SERVING_TEXT_ALIASES.values()])


@register("serving_features", round_sql(oracle(f"""
SELECT city, segment_id, time_bucket, {_NUMBERS}, {_TEXTS}, {_MISSING} AS missing_feature_count,
  CASE WHEN coalesce(freeFlowSpeed, 0e0) > 0 THEN coalesce(currentSpeed, 0e0) / coalesce(freeFlowSpeed, 0e0) ELSE 0e0 END AS speed_ratio,
  CASE WHEN coalesce(weather_rain_1h, 0e0) > 10 THEN 'heavy' WHEN coalesce(weather_rain_1h, 0e0) > 1e-1 THEN 'light' ELSE 'none' END AS rain_level,
  CASE WHEN coalesce(accident_count_1h, 0) > 0 THEN 'accident' WHEN coalesce(news_event_count_1h, 0) > 0 THEN 'other' ELSE 'none' END AS event_type,
  sin({2 * math.pi!r} * hour(time_bucket) / 24e0) AS hour_sin, cos({2 * math.pi!r} * hour(time_bucket) / 24e0) AS hour_cos,
  sin({2 * math.pi!r} * (isodow(time_bucket) - 1) / 7e0) AS dow_sin, cos({2 * math.pi!r} * (isodow(time_bucket) - 1) / 7e0) AS dow_cos
FROM serving""", "serving"), [*_ALIASES, "speed_ratio", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]))
def q_serving_features(spark, sf):
    return K.rounded(FE.serving_features(serving(K.tables(spark, sf))))


def gold_rowbased(t):
    """Lakehouse Gold: traffic, lag, temporal (B peak hours), weather (latest per city), event
    (60-minute look-back) features and row-lead targets on event-level Silver rows."""
    from ..operators import joins as J

    s = _silver_b(t)
    s = W.rolling_time_stats(s)
    s = W.row_lags(s)
    s = s.withColumns({k: v for k, v in T.temporal_features("timestamp", peak_hours=T.PEAK_HOURS_B).items()
                       if k in ("hour_of_day", "day_of_week", "is_peak_hour", "is_weekend")})
    s = J.join_latest_weather(s, K.silver_weather(t))
    s = EV.event_interval_join(s, t.incident_obs, 60)
    return W.row_lead_targets(s)


ROWB_OUT = ["event_id", "speed_rolling_avg_5m", "speed_volatility_15m", "speed_lag_1", "speed_lag_2", "hour_of_day", "is_peak_hour",
            "weather_temperature", "has_rain", "has_accident", "has_any_event", "future_speed_15m", "future_speed_60m"]


def _rowb_sql():
    from .registry import ORACLES

    lags, roll, wx, ev, lead = (ORACLES["row_lags"], ORACLES["rolling_time_stats"], ORACLES["join_latest_weather"],
                                ORACLES["event_interval_join"], ORACLES["row_lead_targets"])
    return f"""
SELECT l.event_id, r.speed_rolling_avg_5m, r.speed_volatility_15m, l.speed_lag_1, l.speed_lag_2,
  CAST(hour(s.timestamp) AS INTEGER) AS hour_of_day, CAST(hour(s.timestamp) IN (7, 8, 9, 11, 12, 13, 17, 18, 19) AS INTEGER) AS is_peak_hour,
  w.weather_temperature, w.has_rain, e.has_accident, e.has_any_event, d.future_speed_15m, d.future_speed_60m
FROM ({lags}) l JOIN ({roll}) r USING (event_id) JOIN ({wx}) w USING (event_id) JOIN ({ev}) e USING (event_id)
JOIN ({lead}) d USING (event_id) JOIN ({oracle("SELECT event_id, timestamp FROM silver_traffic", "silver_traffic")}) s USING (event_id)"""


@register("gold_features_rowbased", round_sql(_rowb_sql(), ["speed_rolling_avg_5m", "speed_volatility_15m", "speed_lag_1", "speed_lag_2",
                                                             "weather_temperature", "future_speed_15m", "future_speed_60m"]))
def q_gold_features_rowbased(spark, sf):
    return K.rounded(gold_rowbased(K.tables(spark, sf)).select(*ROWB_OUT))
