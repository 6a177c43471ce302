"""Grouped aggregates: dedup, continuity, percentiles and serving roll-ups.

All are single ``groupBy().agg()`` plans so Spark combines partial aggregates
map-side before the shuffle; a hot key costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import epoch_seconds

TRAFFIC_KEY = ("city", "segment_id", "time_bucket")
WEATHER_KEY = ("city", "weather_cell_id", "time_bucket")


def last_non_null(col: str, order: Column) -> Column:
    """Last non-null value of ``col`` in ``order`` (pandas groupby ``last``)."""
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), order))


def _dedup(df: DataFrame, keys: Sequence[str], means: Sequence[str], lasts: Sequence[str], tiebreak: str | None) -> DataFrame:
    order = F.struct(F.col("timestamp"), F.col(tiebreak)) if tiebreak and tiebreak in df.columns else F.col("timestamp")
    aggs = [F.max("timestamp").alias("timestamp")]
    aggs += [F.avg(c).alias(c) for c in means if c in df.columns]
    aggs += [last_non_null(c, order).alias(c) for c in lasts if c in df.columns]
    aggs += [F.count(F.lit(1)).alias("rows_collapsed")]
    return df.groupBy(*keys).agg(*aggs)


def dedup_traffic(df: DataFrame, tiebreak: str | None = "event_id") -> DataFrame:
    """One row per (city, segment, bucket): mean speeds/jam/confidence, max time, last non-null attributes.

    ``rows_collapsed`` = input rows folded into the output row; the reference's
    table-wide count is ``sum(rows_collapsed) - count(*)``.
    """
    return _dedup(
        df, TRAFFIC_KEY,
        ("currentSpeed", "freeFlowSpeed", "jamFactor", "confidence"),
        ("lat", "lon", "source", "provider", "segment_name", "weather_cell_id", "geometry", "roadClosure", "date"),
        tiebreak,
    )


def dedup_weather(df: DataFrame, tiebreak: str | None = "event_id") -> DataFrame:
    return _dedup(
        df, WEATHER_KEY,
        ("temp", "feels_like", "humidity", "pressure", "visibility", "rain_1h", "wind_speed", "wind_deg"),
        ("lat", "lon", "source", "provider", "weather_main", "weather_desc"),
        tiebreak,
    )


def dedup_first_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Deterministic ``dropDuplicates(keys)``: keep the row that is first in ``order``.

    ``min_by`` over a struct combines map-side (no per-key sort of all rows).
    """
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def continuity_report(df: DataFrame, bucket_minutes: int = 5, keys: Sequence[str] = ("city", "segment_id"), ts: str = "time_bucket") -> DataFrame:
    """Per segment: bucket range, counts, expected/missing, gap median/max, share of exact gaps, train flags."""
    step = bucket_minutes * 60
    from .windows import _prev_time

    buckets = df.select(*keys, ts).distinct()
    gaps = _prev_time(buckets, keys, ts, bucket_minutes)
    gaps = gaps.withColumn("_gap", (epoch_seconds(ts) - epoch_seconds("_prev_ts")) / F.lit(60.0)).drop("_prev_ts")
    agg = gaps.groupBy(*keys).agg(
        F.min(ts).alias("min_time_bucket"),
        F.max(ts).alias("max_time_bucket"),
        F.count(F.lit(1)).alias("record_count"),
        F.count("_gap").alias("_n_int"),
        F.count_if(F.col("_gap") == bucket_minutes).alias("_n_exact"),
        F.median("_gap").alias("median_interval_minutes"),
        F.max("_gap").alias("max_time_gap_minutes"),
    )
    expected = (F.floor((epoch_seconds("max_time_bucket") - epoch_seconds("min_time_bucket")) / F.lit(step)) + 1).cast("bigint")
    agg = agg.withColumn("expected_bucket_count", expected)
    agg = agg.withColumn("missing_bucket_count", F.greatest(F.col("expected_bucket_count") - F.col("record_count"), F.lit(0)).cast("bigint"))
    return agg.select(
        *keys, "min_time_bucket", "max_time_bucket", "record_count", "expected_bucket_count", "missing_bucket_count",
        (F.col("missing_bucket_count") / F.col("expected_bucket_count")).alias("missing_bucket_ratio"),
        "median_interval_minutes", "max_time_gap_minutes",
        F.when(F.col("_n_int") > 0, F.col("_n_exact") / F.col("_n_int")).alias("correct_interval_ratio"),
        ((F.col("record_count") >= 4) & (F.col("_n_exact") >= 3)).alias("is_train_candidate_15m"),
        ((F.col("record_count") >= 13) & (F.col("_n_exact") >= 12)).alias("is_train_candidate_60m"),
        ((F.col("record_count") >= 49) & (F.col("_n_exact") >= 48)).alias("is_train_candidate_240m"),
    )


def continuity_by_city(report: DataFrame) -> DataFrame:
    return report.groupBy("city").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("record_count").alias("records"),
        F.sum("missing_bucket_count").alias("missing_buckets"),
        F.avg("missing_bucket_ratio").alias("avg_missing_ratio"),
        F.count_if("is_train_candidate_15m").alias("train_candidates_15m"),
        F.count_if("is_train_candidate_60m").alias("train_candidates_60m"),
        F.count_if("is_train_candidate_240m").alias("train_candidates_240m"),
    )


BASELINE_KEYS = ("city", "segment_id", "hour_of_day", "day_of_week")


def speed_percentiles(df: DataFrame, keys: Sequence[str] = BASELINE_KEYS, col: str = "currentSpeed", exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """p15/p50/p85 per group with linear interpolation (``approx`` for very wide groups)."""
    if exact:
        p = F.percentile(F.col(col), F.array(F.lit(0.15), F.lit(0.5), F.lit(0.85)))
    else:
        p = F.percentile_approx(F.col(col), F.array(F.lit(0.15), F.lit(0.5), F.lit(0.85)), accuracy).cast("array<double>")
    return df.groupBy(*keys).agg(p.alias("_p")).select(
        *keys, F.col("_p")[0].alias("p15"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p85")
    )


def baseline_features(df: DataFrame, lookup: DataFrame, keys: Sequence[str] = BASELINE_KEYS) -> DataFrame:
    """Join percentiles (missing -> current speed) and derive ratio, distance and position flags."""
    j = df.join(lookup, list(keys), "left")
    cur = F.col("currentSpeed")
    j = j.withColumns({p: F.coalesce(F.col(p), cur) for p in ("p15", "p50", "p85")})
    free = F.col("freeFlowSpeed")
    spread = F.col("p85") - F.col("p15")
    pos = F.when(F.abs(spread) > 0, (cur - F.col("p15")) / spread).otherwise(F.lit(0.5))
    j = j.withColumns({
        "baseline_congestion_ratio": F.least(F.greatest(F.when(free > 0, F.lit(1.0) - F.col("p50") / free).otherwise(0.0), F.lit(0.0)), F.lit(1.0)),
        "speed_vs_p15": cur - F.col("p15"),
        "speed_vs_p50": cur - F.col("p50"),
        "speed_vs_p85": cur - F.col("p85"),
        "speed_percentile_position": F.least(F.greatest(pos, F.lit(0.0)), F.lit(1.0)),
        "is_below_p15": (cur < F.col("p15")).cast("int"),
        "is_above_p85": (cur > F.col("p85")).cast("int"),
        "is_between_p15_p50": ((cur >= F.col("p15")) & (cur <= F.col("p50"))).cast("int"),
    })
    return j.withColumn("is_anomaly_vs_baseline", ((F.col("is_below_p15") == 1) | (F.col("is_above_p85") == 1)).cast("int"))
