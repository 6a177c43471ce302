"""Gold feature builds composed from operators (verified path A and lakehouse path B)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timefn as T
from ..functions import traffic as TF
from ..operators import aggregates as A
from ..operators import events as EV
from ..operators import joins as J
from ..operators import windows as W
from ..operators.components import materialize


def gold_features(
    traffic_silver_dedup: DataFrame,
    weather_dedup: DataFrame,
    events: DataFrame | None,
    bucket_minutes: int = 5,
    horizons_minutes: Sequence[int] = (15, 60, 240),
    n_lags: int = 12,
    weather_tolerance_minutes: int | None = None,
    keep_weather_time: bool = False,
) -> DataFrame:
    """Path A order: time -> ratio -> exact lags -> strict rolling -> weather as-of ->
    baseline percentiles -> exact targets -> event features.

    Lags and targets come from one blocked window (one shuffle on segment + time block).
    The percentile lookup and the event features are computed from the deduplicated input,
    not from the windowed chain, so the heavy window/as-of chain is evaluated once.
    """
    tol = weather_tolerance_minutes or max(6 * bucket_minutes, 30)
    step = bucket_minutes * 60
    d = traffic_silver_dedup
    if "congestion_ratio" not in d.columns:
        d = d.withColumn("congestion_ratio", TF.congestion_ratio())
    feats = T.temporal_features("time_bucket")
    d = d.withColumns({k: v for k, v in feats.items() if k not in ("week_of_year", "is_holiday")})
    # the deduplicated frame feeds five branches (windows, gaps, percentiles, events, as-of):
    # write it once to the checkpoint folder instead of re-aggregating the raw table per branch
    d = materialize(d)
    lookup = A.speed_percentiles(d)
    ev = EV.event_grid_join(d, events) if events is not None else None
    d = W.gap_features(d, bucket_minutes)
    specs = []
    for k in range(1, n_lags + 1):
        specs.append((f"speed_lag_{k}", "currentSpeed", -k * step))
        specs.append((f"congestion_lag_{k}", "congestion_ratio", -k * step))
    specs += [(f"future_speed_{h}m", "currentSpeed", h * 60) for h in horizons_minutes]
    d = W.exact_offsets(d, ("city", "segment_id"), "time_bucket", specs)
    d = W.with_speed_trends(d)
    d = d.withColumns({f"has_exact_target_{h}m": F.col(f"future_speed_{h}m").isNotNull().cast("int") for h in horizons_minutes})
    d = W.strict_history_rolling(d)
    d = J.asof_weather_backward(d, weather_dedup, tol, keep_time=keep_weather_time)
    d = A.baseline_features(d, lookup)
    if ev is not None:
        d = EV.merge_event_features(d, ev)
    return d
