"""Window operators.

Time-bounded frames (exact offsets, rolling minutes) run over *time blocks*: the
window partition is (keys, block of time) instead of (keys) alone, and only the
rows near a block edge are copied into the neighbouring block as read-only
context. A segment holding a third of all rows is then spread over many tasks,
while every frame still sees every row it needs, so results stay exact.
Row-count frames (lag/lead by rows) cannot be bounded in time and use plain
key partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import epoch_micros, epoch_seconds

_E, _BLK, _CTX = "_rl_epoch", "_rl_block", "_rl_ctx"
EPOCH = _E


def _block_size(back_s: int, ahead_s: int, block_s: int | None, unit: str = "s") -> int:
    need = max(int(back_s), int(ahead_s), 60 if unit == "s" else 60_000_000)
    size = int(block_s) if block_s else need * 8
    if size < need:
        raise ValueError(f"block of {size}s cannot hold a {need}s frame")
    return size


def time_blocked(df: DataFrame, ts: str, back_s: int, ahead_s: int, block_s: int | None = None, unit: str = "s") -> tuple[DataFrame, int]:
    """Tag rows with a time block and copy edge rows into the neighbouring block as context.

    ``unit`` is "s" (epoch seconds) or "us" (epoch microseconds); spans are in that unit.
    """
    size = _block_size(back_s, ahead_s, block_s, unit)
    e = F.col(_E)
    blk = F.floor(e / F.lit(size))
    copies = [F.struct(blk.alias("b"), F.lit(False).alias("c"))]
    if back_s > 0:  # rows near the end of a block are history for the next block
        copies.append(F.when(e >= (blk + 1) * size - back_s, F.struct((blk + 1).alias("b"), F.lit(True).alias("c"))))
    if ahead_s > 0:  # rows near the start of a block are future for the previous block
        copies.append(F.when(e < blk * size + ahead_s, F.struct((blk - 1).alias("b"), F.lit(True).alias("c"))))
    out = (
        df.withColumn(_E, epoch_seconds(ts) if unit == "s" else epoch_micros(ts))
        .withColumn("_rl_copy", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
        .withColumn(_BLK, F.col("_rl_copy.b"))
        .withColumn(_CTX, F.col("_rl_copy.c"))
        .drop("_rl_copy")
    )
    return out, size


def blocked_window_columns(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    back_s: int,
    ahead_s: int,
    build: "callable",
    block_s: int | None = None,
    ordered: bool = True,
    unit: str = "s",
) -> DataFrame:
    """Add the columns returned by ``build(window)`` using time blocks.

    ``build`` receives a Window partitioned by keys + block (and, unless
    ``ordered=False``, ordered by epoch seconds in column ``EPOCH``); it returns a
    dict name -> Column whose frames must not reach further back than ``back_s``
    or further ahead than ``ahead_s``.
    """
    blocked, _ = time_blocked(df, ts, back_s, ahead_s, block_s, unit)
    w = Window.partitionBy(*keys, _BLK)
    cols = build(w.orderBy(_E) if ordered else w)
    return blocked.withColumns(cols).filter(~F.col(_CTX)).drop(_E, _BLK, _CTX)


def exact_offsets(df: DataFrame, keys: Sequence[str], ts: str, specs: Sequence[tuple[str, str, int]], block_s: int | None = None) -> DataFrame:
    """For each (out, col, offset_s): value of ``col`` at exactly ts + offset_s for the same keys, else null.

    A RANGE frame of width zero at the offset picks the single row (keys are unique per ts after dedup).
    """
    back = max([-o for _, _, o in specs if o < 0] + [0])
    ahead = max([o for _, _, o in specs if o > 0] + [0])

    def build(w):
        return {out: F.max(F.col(c)).over(w.rangeBetween(o, o)) for out, c, o in specs}

    return blocked_window_columns(df, keys, ts, back, ahead, build, block_s)


KEYS = ("city", "segment_id")


def exact_lag_join(df: DataFrame, bucket_minutes: int = 5, n_lags: int = 12, keys: Sequence[str] = KEYS, ts: str = "time_bucket") -> DataFrame:
    """speed_lag_k / congestion_lag_k = value at exactly ts - k*bucket, plus trends (verified path)."""
    step = bucket_minutes * 60
    specs = []
    for k in range(1, n_lags + 1):
        specs.append((f"speed_lag_{k}", "currentSpeed", -k * step))
        specs.append((f"congestion_lag_{k}", "congestion_ratio", -k * step))
    out = exact_offsets(df, keys, ts, specs)
    return with_speed_trends(out)


def with_speed_trends(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "speed_trend_1": F.col("speed_lag_1") - F.col("speed_lag_2"),
        "speed_trend_2": F.col("speed_lag_2") - F.col("speed_lag_3"),
    }).withColumn("speed_acceleration", F.col("speed_trend_1") - F.col("speed_trend_2"))


def exact_horizon_target(df: DataFrame, horizons_minutes: Sequence[int] = (15, 60, 240), keys: Sequence[str] = KEYS, ts: str = "time_bucket") -> DataFrame:
    """future_speed_{h}m = speed at exactly ts + h, has_exact_target_{h}m flag."""
    specs = [(f"future_speed_{h}m", "currentSpeed", h * 60) for h in horizons_minutes]
    out = exact_offsets(df, keys, ts, specs)
    return out.withColumns({f"has_exact_target_{h}m": F.col(f"future_speed_{h}m").isNotNull().cast("int") for h in horizons_minutes})


def _mean(cols: list[Column]) -> Column:
    return sum(cols[1:], cols[0]) / F.lit(float(len(cols)))


def _std_samp(cols: list[Column]) -> Column:
    m = _mean(cols)
    ss = sum([(c - m) * (c - m) for c in cols[1:]], (cols[0] - m) * (cols[0] - m))
    return F.sqrt(ss / F.lit(float(len(cols) - 1)))


STRICT_WINDOWS = {"15m": 3, "30m": 6, "60m": 12}


def strict_history_rolling(df: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Mean / sample std over exact lags 1..n; null unless all n lags exist; valid_history flags.

    Arithmetic on the lag columns propagates nulls, which is the "all lags present" rule.
    """
    windows = windows or STRICT_WINDOWS
    cols: dict[str, Column] = {}
    for label, n in windows.items():
        sp = [F.col(f"speed_lag_{i}") for i in range(1, n + 1)]
        cg = [F.col(f"congestion_lag_{i}") for i in range(1, n + 1)]
        cols[f"speed_rolling_avg_{label}"] = _mean(sp)
        cols[f"congestion_rolling_avg_{label}"] = _mean(cg)
        if n <= 6:
            cols[f"speed_volatility_{label}"] = _std_samp(sp)
        cols[f"valid_history_{label}"] = F.when(F.greatest(*[c.isNull() for c in sp]), 0).otherwise(1)
    return df.withColumns(cols)


def rolling_time_stats(df: DataFrame, keys: Sequence[str] = ("segment_id",), ts: str = "timestamp") -> DataFrame:
    """Lakehouse path: avg speed/congestion over the last 5/15/30 minutes incl. the current row,
    sample std over 15 minutes; null -> 0. Frames are RANGE over epoch seconds."""

    def build(w):
        cols = {}
        for label, secs in (("5m", 300), ("15m", 900), ("30m", 1800)):
            frame = w.rangeBetween(-secs, 0)
            cols[f"speed_rolling_avg_{label}"] = F.coalesce(F.avg("currentSpeed").over(frame), F.lit(0.0))
            cols[f"congestion_rolling_avg_{label}"] = F.coalesce(F.avg("congestion_ratio").over(frame), F.lit(0.0))
        cols["speed_volatility_15m"] = F.coalesce(F.stddev_samp("currentSpeed").over(w.rangeBetween(-900, 0)), F.lit(0.0))
        return cols

    return blocked_window_columns(df, keys, ts, 1800, 0, build)


def blocked_row_shift(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Sequence[tuple[str, str, int]],
                      ts: str | None = None, block_s: int = 86_400, block_by: Column | None = None) -> DataFrame:
    """Row-count lag (k < 0) / lead (k > 0) of ``col`` per key, exact, without a per-key partition.

    Rows are split into time blocks (key, block). Shifts that stay inside a block come from a
    window over (key, block); the rows a block needs from its neighbours are the last |K| rows
    of the previous blocks and the first L rows of the following ones, gathered per block
    (at most |K| / L rows each) and spread with a window over the blocks of a key (one row per
    block). A key holding a third of all rows is thus processed block by block. ``block_by``
    overrides the block number (it must not decrease along ``order``), e.g. ranges of an
    arrival sequence number."""
    ts = ts or order[0]
    back = max([-k for _, _, k in specs if k < 0] + [0])
    ahead = max([k for _, _, k in specs if k > 0] + [0])
    cols = sorted({c for _, c, _ in specs})
    x = df.withColumn("_rl_blk", F.floor(epoch_seconds(ts) / F.lit(block_s)) if block_by is None else block_by)
    w_in = Window.partitionBy(*keys, "_rl_blk").orderBy(*order)
    x = x.withColumn("_rl_r", F.row_number().over(w_in)).withColumn("_rl_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_rl_blk")))
    inside = {out: (F.lag(c, -k).over(w_in) if k < 0 else F.lead(c, k).over(w_in)) for out, c, k in specs}
    x = x.withColumns({f"_rl_in_{out}": v for out, v in inside.items()})
    row = F.struct(F.col("_rl_r").alias("r"), *[F.col(c).alias(c) for c in cols])
    parts = []
    if back:
        parts.append(x.filter(F.col("_rl_r") > F.col("_rl_n") - back).groupBy(*keys, "_rl_blk")
                     .agg(F.array_sort(F.collect_list(row)).alias("_rl_tail")))
    if ahead:
        parts.append(x.filter(F.col("_rl_r") <= ahead).groupBy(*keys, "_rl_blk").agg(F.array_sort(F.collect_list(row)).alias("_rl_head")))
    blocks = parts[0] if len(parts) == 1 else parts[0].join(parts[1], [*keys, "_rl_blk"], "full")
    wb = Window.partitionBy(*keys).orderBy("_rl_blk")
    ctx = {}
    if back:
        ctx["_rl_prev"] = F.flatten(F.collect_list("_rl_tail").over(wb.rowsBetween(-back, -1)))
    if ahead:
        ctx["_rl_next"] = F.flatten(F.collect_list("_rl_head").over(wb.rowsBetween(1, ahead)))
    blocks = blocks.select(*keys, "_rl_blk", *[v.alias(k) for k, v in ctx.items()])
    x = x.join(blocks, [*keys, "_rl_blk"], "left")
    r, n = F.col("_rl_r"), F.col("_rl_n")
    out_cols = {}
    for out, c, k in specs:
        if k < 0:
            j = -k
            idx = F.size("_rl_prev") - (F.lit(j) - r)
            cross = F.when(idx >= 1, F.element_at(F.col("_rl_prev"), idx.cast("int"))[c])
            out_cols[out] = F.when(r > j, F.col(f"_rl_in_{out}")).otherwise(cross)
        else:
            idx = r + F.lit(k) - n
            cross = F.when(idx <= F.size("_rl_next"), F.try_element_at(F.col("_rl_next"), idx.cast("int"))[c])
            out_cols[out] = F.when(r + F.lit(k) <= n, F.col(f"_rl_in_{out}")).otherwise(cross)
    x = x.withColumns(out_cols)
    return x.drop(*[c for c in x.columns if c.startswith("_rl_")])


def row_lags(df: DataFrame, keys: Sequence[str] = ("segment_id",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Lakehouse path: lag 1-4 rows of speed, 1-2 of congestion, trends; null -> 0.
    Row-count shifts run over time blocks (see ``blocked_row_shift``)."""
    specs = [(f"speed_lag_{k}", "currentSpeed", -k) for k in range(1, 5)] + [(f"congestion_lag_{k}", "congestion_ratio", -k) for k in range(1, 3)]
    df = blocked_row_shift(df, keys, order, specs)
    lags = [s[0] for s in specs]
    df = df.withColumns({
        "speed_trend_1": F.col("currentSpeed") - F.col("speed_lag_1"),
        "speed_trend_2": F.col("speed_lag_1") - F.col("speed_lag_2"),
    }).withColumn("speed_acceleration", F.col("speed_trend_1") - F.col("speed_trend_2"))
    fill = lags + ["speed_trend_1", "speed_trend_2", "speed_acceleration"]
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.0)) for c in fill})


def row_lead_targets(df: DataFrame, steps: dict[str, int] | None = None, keys: Sequence[str] = ("segment_id",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Lakehouse path: targets as lead 3/12/48 rows; keep rows with at least one target.
    Row-count shifts run over time blocks (see ``blocked_row_shift``)."""
    steps = steps or {"15m": 3, "60m": 12, "240m": 48}
    df = blocked_row_shift(df, keys, order, [(f"future_speed_{h}", "currentSpeed", n) for h, n in steps.items()])
    cond = None
    for h in steps:
        c = F.col(f"future_speed_{h}").isNotNull()
        cond = c if cond is None else cond | c
    return df.filter(cond)


def _prev_time(df: DataFrame, keys: Sequence[str], ts: str, bucket_minutes: int) -> DataFrame:
    out = blocked_row_shift(df.withColumn("_pt", F.col(ts)), keys, [ts], [("_prev_ts", "_pt", -1)],
                            block_s=max(86_400, bucket_minutes * 60 * 16))
    return out.drop("_pt")


def gap_features(df: DataFrame, bucket_minutes: int = 5, keys: Sequence[str] = KEYS, ts: str = "time_bucket") -> DataFrame:
    """Minutes since the previous bucket, exact-previous flag, large-gap flag (previous row found
    over time blocks, see ``blocked_row_shift``)."""
    df = _prev_time(df, keys, ts, bucket_minutes)
    gap = (epoch_seconds(ts) - epoch_seconds("_prev_ts")) / F.lit(60.0)
    df = df.withColumn("time_gap_minutes", gap).drop("_prev_ts")
    return df.withColumns({
        "has_previous_exact_bucket": (F.coalesce(F.col("time_gap_minutes") == bucket_minutes, F.lit(False))).cast("int"),
        "has_large_gap_before": (F.coalesce(F.col("time_gap_minutes"), F.lit(float(bucket_minutes))) > bucket_minutes).cast("int"),
    })


def latest_by_segment(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "timestamp", tiebreak: Sequence[str] = (), city: str | None = None) -> DataFrame:
    """Newest row per key; null times dropped; optional city filter.

    Implemented as a grouped ``max_by`` over a struct of the row rather than a
    ``row_number`` window: the aggregate combines map-side, so a key with a third of
    all rows is reduced before the shuffle instead of landing in one task.
    """
    from ..functions.traffic import normalize_city

    if city is not None and "city" in df.columns:
        df = df.filter(F.col("city") == normalize_city(F.lit(city)))
    df = df.filter(F.col(ts).isNotNull())
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_rl_row"))
    return picked.select(*keys, *[F.col(f"_rl_row.{c}").alias(c) for c in rest])


def district_density(df: DataFrame, keys: Sequence[str] = ("city", "district")) -> DataFrame:
    """Rows per (city, district) as a column: a grouped count joined back (combines map-side)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("district_segment_count"))
    return df.join(counts, list(keys), "left").withColumn(
        "district_segment_count", F.coalesce(F.col("district_segment_count"), F.lit(0))
    )


def timestamp_inversions(df: DataFrame, keys: Sequence[str], ts: str, order: str, block: int = 1_000_000) -> DataFrame:
    """Per key, in arrival order: count of negative time steps and null times. The previous
    row comes from blocks of the arrival sequence (``blocked_row_shift``), not a per-key sort."""
    x = df.withColumn("_t", F.col(ts))
    x = blocked_row_shift(x, keys, [order], [("_prev", "_t", -1)], block_by=F.floor(F.col(order) / F.lit(block)))
    flagged = x.withColumn("_inv", (F.col(ts) < F.col("_prev")).cast("int"))
    return flagged.groupBy(*keys).agg(
        F.coalesce(F.sum("_inv"), F.lit(0)).cast("bigint").alias("inversions"),
        F.count_if(F.col(ts).isNull()).cast("bigint").alias("null_times"),
    )
