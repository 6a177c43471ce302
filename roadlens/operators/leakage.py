"""Leakage evidence recomputed from values (not asserted): lag and target columns are
re-joined to the source rows at t -/+ k, and the time at which a row's as-of weather was
measured (carried by Gold as ``weather_asof_time``) is compared with the row's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import add_minutes


def leakage_checks(gold: DataFrame, source: DataFrame, bucket_minutes: int, horizon_minutes: int) -> DataFrame:
    keys = ["city", "segment_id"]
    src = source.select(*keys, "time_bucket", F.col("currentSpeed").alias("_src"))
    lag = gold.select(*keys, "time_bucket", "speed_lag_1").withColumn("_t", add_minutes("time_bucket", -bucket_minutes))
    lag = lag.join(src.withColumnRenamed("time_bucket", "_t"), keys + ["_t"], "left")
    v1 = lag.agg(F.count_if(F.col("speed_lag_1").isNotNull() & (F.col("_src").isNull() | (F.col("_src") != F.col("speed_lag_1")))).alias("violations"))
    tcol = f"future_speed_{horizon_minutes}m"
    tgt = gold.select(*keys, "time_bucket", tcol).withColumn("_t", add_minutes("time_bucket", horizon_minutes))
    tgt = tgt.join(src.withColumnRenamed("time_bucket", "_t"), keys + ["_t"], "left")
    v2 = tgt.agg(F.count_if(F.col(tcol).isNotNull() & (F.col("_src").isNull() | (F.col("_src") != F.col(tcol)))).alias("violations"))
    v3 = gold.agg(F.count_if(F.col("weather_asof_time") > F.col("time_bucket")).alias("violations"))
    return (v1.select(F.lit("lag_1_matches_source").alias("check_name"), "violations")
            .unionByName(v2.select(F.lit("target_matches_source").alias("check_name"), "violations"))
            .unionByName(v3.select(F.lit("asof_weather_not_future").alias("check_name"), "violations")))
