"""Serving views over the latest state of every segment: dashboard, trends, status,
runtime, hotspots by name prefix, corridors, top-k and lookups.

Each view is one grouped aggregate (partial aggregation before the shuffle) or a
filter/projection on the latest rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import traffic as TF
from .risk import risk_level


def dashboard_summary(latest: DataFrame, total_rows: DataFrame | None = None) -> DataFrame:
    """Per city: monitored segments, risk markers (jam >= 3), free/slow/congested counts
    (<3, 3-6, >=6), averages and latest time."""
    jam = F.col("jamFactor")
    out = latest.groupBy("city").agg(
        F.countDistinct("segment_id").alias("monitored_segments"),
        F.count(F.lit(1)).alias("serving_snapshot_rows"),
        F.count_if(jam >= 3).alias("risk_markers"),
        F.count_if(jam < 3).alias("free_flow_segments"),
        F.count_if((jam >= 3) & (jam < 6)).alias("slow_segments"),
        F.count_if(jam >= 6).alias("congested_segments"),
        F.avg("currentSpeed").alias("avg_speed"),
        F.avg(jam).alias("avg_jam_factor"),
        F.max("timestamp").alias("latest_timestamp"),
    )
    if total_rows is not None:
        out = out.join(total_rows.groupBy("city").agg(F.count(F.lit(1)).alias("total_gold_rows")), "city", "left")
    return out


def hourly_trends(df: DataFrame, hours: int = 24, ts: str = "timestamp") -> DataFrame:
    """Per city: rows within ``hours`` of the city's newest row, averaged per clock hour;
    hours without rows do not appear."""
    newest = df.groupBy("city").agg(F.max(ts).alias("_rl_max"))
    w = df.join(newest, "city").filter(F.col(ts) >= F.col("_rl_max") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return w.groupBy("city", F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hour")).agg(
        F.avg("currentSpeed").alias("avg_speed"), F.avg("jamFactor").alias("avg_jam_factor"),
        F.count(F.lit(1)).alias("rows"),
    )


def city_status(latest: DataFrame) -> DataFrame:
    jam = F.col("jamFactor")
    return latest.groupBy("city").agg(
        F.countDistinct("segment_id").alias("total_segments"),
        F.avg("currentSpeed").alias("avg_speed"),
        F.avg((jam >= 3).cast("double")).alias("congestion_ratio"),
        F.max(jam).alias("max_jam_factor"),
        F.count_if(jam >= 6).alias("critical_segment_count"),
        F.max("timestamp").alias("timestamp"),
    )


def city_runtime(latest: DataFrame, cities: DataFrame) -> DataFrame:
    """Configured cities (city, enabled) left-joined to their latest-state aggregate:
    online when enabled and rows exist, else offline."""
    agg = latest.groupBy("city").agg(
        F.countDistinct("segment_id").alias("segment_count"),
        F.max("timestamp").alias("latest_timestamp"),
        F.avg("currentSpeed").alias("avg_speed"),
        F.avg("jamFactor").alias("avg_jam_factor"),
    )
    j = cities.join(agg, "city", "left")
    return j.select(
        "city", "enabled",
        F.when(F.col("enabled") & F.col("segment_count").isNotNull(), "online").otherwise("offline").alias("status"),
        F.coalesce(F.col("segment_count"), F.lit(0)).alias("segment_count"),
        "latest_timestamp", "avg_speed", "avg_jam_factor",
    )


def name_prefix_hotspots(latest: DataFrame, prefix_len: int = 12) -> DataFrame:
    """Latest rows with jam >= 3 grouped by the first characters of the name (id when no name)."""
    cong = latest.filter(F.col("jamFactor") >= 3)
    cid = F.substring(F.coalesce(F.col("segment_name"), F.col("segment_id")), 1, prefix_len)
    g = cong.groupBy("city", cid.alias("cluster_key")).agg(
        F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"),
        F.countDistinct("segment_id").alias("num_segments"),
        F.avg(F.greatest(F.col("freeFlowSpeed") - F.col("currentSpeed"), F.lit(0.0))).alias("avg_congestion"),
        F.avg("jamFactor").alias("avg_jam_factor"),
        F.max("timestamp").alias("detected_at"),
    )
    sev = F.col("avg_jam_factor")
    return g.withColumn("severity", F.when(sev >= 8, "critical").when(sev >= 6, "high").when(sev >= 3, "medium").otherwise("low"))


def corridor_risk(scored: DataFrame, corridor: str = "district", limit: int = 10) -> DataFrame:
    """Mean segment risk per corridor (district, else city), its level, max jam, distinct segments; top N."""
    col = corridor if corridor in scored.columns else "city"
    g = scored.groupBy(F.col(col).alias("corridor_id")).agg(
        F.avg("risk_score").alias("risk_score"), F.max("jamFactor").alias("max_jam_factor"),
        F.countDistinct("segment_id").alias("segment_count"),
    )
    g = g.withColumn("risk_level", risk_level(F.col("risk_score")))
    return g.orderBy(F.col("risk_score").desc(), F.col("corridor_id").asc_nulls_last()).limit(limit)


def top_n_per_city(df: DataFrame, n: int = 250, order: Sequence | None = None) -> DataFrame:
    """At most n rows per city (row_number over a city window; input is one row per segment)."""
    order = order or (F.col("jamFactor").desc(), F.col("segment_id").asc())
    w = Window.partitionBy("city").orderBy(*order)
    return df.withColumn("_rl_rn", F.row_number().over(w)).filter(F.col("_rl_rn") <= n).drop("_rl_rn")


def segment_lookup(latest: DataFrame, ids: DataFrame) -> DataFrame:
    """Latest rows of the requested segment ids (unknown ids give no row)."""
    return latest.join(ids.select("segment_id").distinct(), "segment_id", "left_semi")


def with_congestion_levels(df: DataFrame) -> DataFrame:
    ratio = TF.speed_ratio()
    return df.withColumns({
        "speed_ratio": ratio,
        "congestion_level": TF.congestion_level(ratio),
        "delay_minutes": TF.delay_minutes(ratio, "jamFactor"),
        "severity": TF.severity_from_jam("jamFactor"),
    })
