"""Registered queries: data-quality contract checks, roll-up, coverage and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from . import common as K
from .q_gold import gold
from .registry import oracle, register, round_sql, stage

# Contract over the Silver traffic view (a test parameter in the shape of the reference's YAML).
TRAFFIC_CONTRACT = Q.Contract(
    name="silver_traffic",
    required=["city", "segment_id", "time_bucket", "currentSpeed", "freeFlowSpeed", "jamFactor", "road_class"],
    nullable={"city": False, "segment_id": False, "currentSpeed": False, "confidence": True, "lat": False},
    key=["city", "segment_id", "time_bucket"],
    ranges={"currentSpeed": (0.0, 120.0), "confidence": (0.0, 0.9), "lat": (None, 21.05), "wind": (0.0, None)},
    types={"currentSpeed": "numeric", "time_bucket": "timestamp", "city": "string"},
    timestamp="time_bucket", freshness_hours=24.0,
    coverage=["lat", "lon", "confidence"],
    order="event_id", group=["city", "segment_id"],
)


def _duck_contract(c: Q.Contract, table: str, cols: list[str], now: str) -> str:
    parts = []
    missing = [x for x in c.required if x not in cols]
    parts.append(f"SELECT 'required_columns' AS name, '{'FAIL' if missing else 'PASS'}' AS status, CAST({len(missing)} AS BIGINT) AS bad_rows, "
                 f"CAST({len(missing)} AS DOUBLE) AS metric, true AS critical")
    leaks = [x for x in cols if x not in set(c.leakage_allow) and any(t in x.lower() for t in Q.LEAKAGE_TOKENS)]
    parts.append(f"SELECT 'feature_leakage', '{'FAIL' if leaks else 'PASS'}', {len(leaks)}, {len(leaks)}, true")
    nn = [x for x, ok in c.nullable.items() if not ok and x in cols]
    if nn:
        worst = "greatest(" + ", ".join(f"avg(CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END)" for x in nn) + ")"
        total = " + ".join(f"count(*) FILTER (WHERE {x} IS NULL)" for x in nn)
        parts.append(f"SELECT 'null_ratio', CASE WHEN {worst} > {c.null_ratio_threshold} THEN 'FAIL' ELSE 'PASS' END, 0, {worst}, true FROM {table}")
        parts.append(f"SELECT 'nullable_contract', CASE WHEN ({total}) > 0 THEN 'FAIL' ELSE 'PASS' END, {total}, {total}, true FROM {table}")
    key = [x for x in c.key if x in cols]
    if key:
        dup = f"(count(*) - count(DISTINCT struct_pack({', '.join(f'{k} := {k}' for k in key)})))"
        parts.append(f"SELECT 'duplicate_key', CASE WHEN {dup} > 0 THEN 'FAIL' ELSE 'PASS' END, {dup}, {dup}, true FROM {table}")
    for x, (lo, hi) in c.ranges.items():
        if x not in cols:
            parts.append(f"SELECT '{x}_range', 'SKIP', 0, 0, false")
            continue
        cond = [f"CAST({x} AS DOUBLE) IS NOT NULL"]
        if lo is not None:
            cond.append(f"CAST({x} AS DOUBLE) >= {lo!r}")
        if hi is not None:
            cond.append(f"CAST({x} AS DOUBLE) <= {hi!r}")
        bad = f"count(*) FILTER (WHERE NOT ({' AND '.join(cond)}) AND {x} IS NOT NULL)"
        parts.append(f"SELECT '{x}_range', CASE WHEN {bad} > 0 THEN 'FAIL' ELSE 'PASS' END, {bad}, {bad}, true FROM {table}")
    for x, kind in c.types.items():
        if x not in cols:
            parts.append(f"SELECT '{x}_type', 'SKIP', 0, 0, false")
            continue
        if kind == "numeric":
            bad = f"count(*) FILTER (WHERE {x} IS NOT NULL AND TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) IS NULL)"
        elif kind == "timestamp":
            bad = f"count(*) FILTER (WHERE {x} IS NOT NULL AND TRY_CAST(CAST({x} AS VARCHAR) AS TIMESTAMP) IS NULL)"
        else:
            bad = "count(*) FILTER (WHERE false)"
        parts.append(f"SELECT '{x}_type', CASE WHEN {bad} > 0 THEN 'FAIL' ELSE 'PASS' END, {bad}, {bad}, true FROM {table}")
    if c.timestamp:
        inv = (f"(SELECT coalesce(sum(CASE WHEN inv THEN 1 ELSE 0 END), 0) FROM (SELECT {c.timestamp} < lag({c.timestamp}) OVER "
               f"(PARTITION BY {', '.join(c.group)} ORDER BY {c.order}) AS inv FROM {table}) i)") if c.order else "0"
        parts.append(f"SELECT 'timestamp_order', CASE WHEN (count(*) FILTER (WHERE {c.timestamp} IS NULL) + {inv}) > 0 THEN 'FAIL' ELSE 'PASS' END, "
                     f"count(*) FILTER (WHERE {c.timestamp} IS NULL) + {inv}, {inv}, true FROM {table}")
        age = f"greatest(0e0, (epoch_us(TIMESTAMP '{now}') - epoch_us(max({c.timestamp}))) / 3.6e9)"
        parts.append(f"SELECT 'freshness', CASE WHEN max({c.timestamp}) IS NULL THEN 'WARN' WHEN {age} > {c.freshness_hours} THEN 'WARN' ELSE 'PASS' END, "
                     f"0, {age}, false FROM {table}")
    cov = [x for x in c.coverage if x in cols]
    if cov:
        worst = "greatest(" + ", ".join(f"avg(CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END)" for x in cov) + ")"
        parts.append(f"SELECT 'feature_coverage', CASE WHEN {worst} > {c.coverage_threshold} THEN 'WARN' ELSE 'PASS' END, 0, {worst}, false FROM {table}")
    return "\nUNION ALL ".join(parts)


SILVER_COLS = ["event_id", "source", "city", "segment_id", "segment_name", "weather_cell_id", "lat", "lon", "event_time",
               "currentSpeed", "freeFlowSpeed", "jamFactor", "confidence", "timestamp", "source_time_bucket", "time_bucket", "date"]
stage("dq_traffic", "SELECT name, status, CAST(bad_rows AS BIGINT) AS bad_rows, CAST(metric AS DOUBLE) AS metric, critical FROM (\n"
      + _duck_contract(TRAFFIC_CONTRACT, "silver_traffic", SILVER_COLS, K.TEST_NOW) + "\n) c", "silver_traffic")


def dq_results(t):
    return Q.dq_run_contract(K.silver_traffic(t).select(*SILVER_COLS), TRAFFIC_CONTRACT, K.TEST_NOW)


@register("dq_run_contract", round_sql(oracle("SELECT * FROM dq_traffic", "dq_traffic"), ["metric"]))
def q_dq_run_contract(spark, sf):
    return K.rounded(dq_results(K.tables(spark, sf)))


def _subset(name, cond):
    @register(name, round_sql(oracle(f"SELECT * FROM dq_traffic WHERE {cond}", "dq_traffic"), ["metric"]))
    def q(spark, sf):
        return K.rounded(dq_results(K.tables(spark, sf)).filter(F.expr(cond)))
    return q


_subset("dq_schema_checks", "name IN ('required_columns', 'feature_leakage')")
_subset("dq_null_ratio", "name = 'null_ratio'")
_subset("dq_nullable", "name = 'nullable_contract'")
_subset("dq_duplicate_key", "name = 'duplicate_key'")
_subset("dq_range", "name LIKE '%_range'")
_subset("dq_type", "name LIKE '%_type'")
_subset("dq_timestamp_order", "name = 'timestamp_order'")
_subset("dq_freshness", "name = 'freshness'")
_subset("dq_feature_coverage", "name = 'feature_coverage'")


@register("dq_rollup", oracle("""
SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAIL' AND critical) > 0 THEN 'FAIL'
            WHEN count(*) FILTER (WHERE status IN ('WARN', 'FAIL')) > 0 THEN 'WARN' ELSE 'PASS' END AS overall,
  count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned,
  count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'SKIP') AS skipped,
  count(*) FILTER (WHERE status = 'FAIL' AND critical) AS critical_failed FROM dq_traffic""", "dq_traffic"))
def q_dq_rollup(spark, sf):
    return Q.dq_rollup(dq_results(K.tables(spark, sf)))


@register("system_status", oracle(f"""
SELECT CASE WHEN list_has_any(reasons, ['no_data', 'critical_quality_failures']) THEN 'Unhealthy' WHEN len(reasons) > 0 THEN 'Degraded' ELSE 'OK' END AS status, reasons
FROM (
  SELECT list_filter([CASE WHEN n = 0 THEN 'no_data' END, CASE WHEN critical > 0 THEN 'critical_quality_failures' END,
    CASE WHEN critical = 0 AND warned > 0 THEN 'quality_warnings_or_no_evidence' END, CASE WHEN models = 0 THEN 'no_model' END,
    CASE WHEN age > 168 THEN 'stale_data' END], lambda r: r IS NOT NULL) AS reasons
  FROM (SELECT (SELECT count(*) FROM silver_traffic) + (SELECT count(*) FROM silver_weather) AS n,
          least((SELECT (epoch_us(TIMESTAMP '{K.TEST_NOW}') - epoch_us(max(timestamp))) / 3.6e9 FROM silver_traffic),
                (SELECT (epoch_us(TIMESTAMP '{K.TEST_NOW}') - epoch_us(max(timestamp))) / 3.6e9 FROM silver_weather)) AS age) d,
    (SELECT count(*) FILTER (WHERE status = 'FAIL' AND critical) AS critical, count(*) FILTER (WHERE status IN ('WARN', 'FAIL')) AS warned FROM dq_traffic) q,
    (SELECT 0 AS models) m) x""", "silver_traffic", "silver_weather", "dq_traffic"))
def q_system_status(spark, sf):
    """Overall status of the two Silver tables and the traffic contract; no model folder is given here."""
    from .q_misc import pipeline_health

    t = K.tables(spark, sf)
    health = pipeline_health({"silver_traffic": K.silver_traffic(t), "silver_weather": K.silver_weather(t)}, K.TEST_NOW)
    return Q.overall_status(health, Q.dq_rollup(dq_results(t)), model_ready=False)


@register("dq_bucket_coverage", oracle("""
SELECT city, segment_id, buckets, m AS median_buckets FROM (
  SELECT city, segment_id, count(DISTINCT time_bucket) AS buckets FROM silver_traffic GROUP BY ALL) p,
  (SELECT quantile_cont(b, 0.5) AS m FROM (SELECT count(DISTINCT time_bucket) AS b FROM silver_traffic GROUP BY city, segment_id) q) mm
WHERE buckets < m * 75e-2""", "silver_traffic"))
def q_dq_bucket_coverage(spark, sf):
    # 75 % instead of 25 % so the sparse test series yields rows
    return Q.dq_bucket_coverage(K.silver_traffic(K.tables(spark, sf)), share=0.75)


@register("referential_coverage", round_sql(oracle("""
SELECT count(*) AS distinct_keys, count(hit) AS matched, count(hit) / count(*) AS coverage,
  CASE WHEN count(hit) / count(*) < 95e-2 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT DISTINCT segment_id FROM segment_dim WHERE segment_id IS NOT NULL) k
LEFT JOIN (SELECT DISTINCT segment_id, 1 AS hit FROM traffic_obs) r USING (segment_id)""", "traffic_obs", "segment_dim"), ["coverage"]))
def q_referential_coverage(spark, sf):
    t = K.tables(spark, sf)
    # which registered segments report at all: most do not, so the WARN branch is met
    return K.rounded(Q.referential_coverage(t.segment_dim, t.traffic_obs, "segment_id"))


@register("orphan_keys", oracle("""
SELECT DISTINCT segment_id FROM segment_dim WHERE segment_id IS NOT NULL AND segment_id NOT IN (SELECT segment_id FROM traffic_obs)""",
                                "traffic_obs", "segment_dim"))
def q_orphan_keys(spark, sf):
    t = K.tables(spark, sf)
    return Q.orphan_keys(t.segment_dim, t.traffic_obs, "segment_id")


@register("leakage_checks", oracle(f"""
SELECT 'lag_1_matches_source' AS check_name, count(*) FILTER (WHERE g.speed_lag_1 IS NOT NULL AND (s.currentSpeed IS NULL OR s.currentSpeed <> g.speed_lag_1)) AS violations
FROM gold g LEFT JOIN traffic_dedup s ON s.city = g.city AND s.segment_id = g.segment_id AND s.time_bucket = g.time_bucket - INTERVAL ({K.BUCKET}) MINUTE
UNION ALL
SELECT 'target_matches_source', count(*) FILTER (WHERE g.future_speed_{K.HORIZONS[0]}m IS NOT NULL AND (s.currentSpeed IS NULL OR s.currentSpeed <> g.future_speed_{K.HORIZONS[0]}m))
FROM gold g LEFT JOIN traffic_dedup s ON s.city = g.city AND s.segment_id = g.segment_id AND s.time_bucket = g.time_bucket + INTERVAL ({K.HORIZONS[0]}) MINUTE
UNION ALL
SELECT 'asof_weather_not_future', count(*) FILTER (WHERE w.time_bucket > g.time_bucket)
FROM gold g JOIN weather_dedup w ON w.city = g.city AND w.temp = g.weather_temperature AND w.weather_cell_id = g.weather_cell_id
  AND w.time_bucket > g.time_bucket AND NOT EXISTS (SELECT 1 FROM weather_dedup w2 WHERE w2.city = g.city AND w2.weather_cell_id = g.weather_cell_id
  AND w2.temp = g.weather_temperature AND w2.time_bucket <= g.time_bucket)""", "gold", "traffic_dedup", "weather_dedup"))
def q_leakage_checks(spark, sf):
    from ..operators.leakage import leakage_checks

    t = K.tables(spark, sf)
    return leakage_checks(gold(t, keep_weather_time=True), K.traffic_dedup(t), K.BUCKET, K.HORIZONS[0])
