"""Contract-driven data-quality checks.

All data checks of a contract become columns of ONE aggregate over the table (one
scan, partial aggregation per task), which is then unpivoted into rows
(name, status, bad_rows, metric, critical). Schema checks (required columns,
suspicious names) read only the schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name fragments that suggest target leakage.
LEAKAGE_TOKENS = ("future_", "target", "prediction", "label", "actual_future")


@dataclass
class Contract:
    name: str
    required: list[str]
    nullable: dict[str, bool] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    null_ratio_threshold: float = 0.05
    timestamp: str | None = None
    freshness_hours: float | None = None
    coverage: list[str] = field(default_factory=list)
    coverage_threshold: float = 0.20
    leakage_allow: list[str] = field(default_factory=list)
    order: str | None = None   # arrival order for timestamp inversions
    group: list[str] = field(default_factory=list)


def _row(name, status, bad, metric, critical) -> Column:
    return F.struct(F.lit(name).alias("name"), status.alias("status") if isinstance(status, Column) else F.lit(status).alias("status"),
                    (bad if isinstance(bad, Column) else F.lit(bad)).cast("bigint").alias("bad_rows"),
                    (metric if isinstance(metric, Column) else F.lit(metric)).cast("double").alias("metric"),
                    F.lit(critical).alias("critical"))


def _type_bad(c: str, kind: str) -> Column:
    col = F.col(c)
    if kind == "numeric":
        return col.isNotNull() & col.cast("string").try_cast("double").isNull()
    if kind == "timestamp":
        return col.isNotNull() & F.try_to_timestamp(col.cast("string")).isNull()
    return F.lit(False)


def dq_run_contract(df: DataFrame, c: Contract, now: str | None = None) -> DataFrame:
    """All checks of one contract -> rows (name, status, bad_rows, metric, critical)."""
    cols = set(df.columns)
    static: list[Column] = []
    missing = [x for x in c.required if x not in cols]
    static.append(_row("required_columns", "FAIL" if missing else "PASS", len(missing), float(len(missing)), True))
    leaks = [x for x in df.columns if x not in set(c.leakage_allow) and any(t in x.lower() for t in LEAKAGE_TOKENS)]
    static.append(_row("feature_leakage", "FAIL" if leaks else "PASS", len(leaks), float(len(leaks)), True))

    work = df
    aggs: dict[str, Column] = {"_n": F.count(F.lit(1))}
    rows: list = []
    nn = [x for x, ok in c.nullable.items() if not ok and x in cols]
    for x in nn:
        aggs[f"_nr_{x}"] = F.avg(F.col(x).isNull().cast("double"))
        aggs[f"_nc_{x}"] = F.count_if(F.col(x).isNull())
    if nn:
        worst = F.greatest(*[F.col(f"_nr_{x}") for x in nn]) if len(nn) > 1 else F.col(f"_nr_{nn[0]}")
        rows.append(lambda: _row("null_ratio", F.when(worst > c.null_ratio_threshold, "FAIL").otherwise("PASS"), 0, worst, True))
        total = sum((F.col(f"_nc_{x}") for x in nn), F.lit(0))
        rows.append(lambda: _row("nullable_contract", F.when(total > 0, "FAIL").otherwise("PASS"), total, total, True))
    key = [x for x in c.key if x in cols]
    if key:
        aggs["_dup"] = F.count(F.lit(1)) - F.count_distinct(F.struct(*[F.col(k) for k in key]))
        rows.append(lambda: _row("duplicate_key", F.when(F.col("_dup") > 0, "FAIL").otherwise("PASS"), F.col("_dup"), F.col("_dup"), True))
    for x, (lo, hi) in c.ranges.items():
        if x not in cols:
            static.append(_row(f"{x}_range", "SKIP", 0, 0.0, False))
            continue
        v = F.col(x).cast("double")
        ok = v.isNotNull()
        if lo is not None:
            ok = ok & (v >= lo)
        if hi is not None:
            ok = ok & (v <= hi)
        aggs[f"_rg_{x}"] = F.count_if(~ok & v.isNotNull())
        rows.append(lambda x=x: _row(f"{x}_range", F.when(F.col(f"_rg_{x}") > 0, "FAIL").otherwise("PASS"), F.col(f"_rg_{x}"), F.col(f"_rg_{x}"), True))
    for x, kind in c.types.items():
        if x not in cols:
            static.append(_row(f"{x}_type", "SKIP", 0, 0.0, False))
            continue
        aggs[f"_ty_{x}"] = F.count_if(_type_bad(x, kind))
        rows.append(lambda x=x: _row(f"{x}_type", F.when(F.col(f"_ty_{x}") > 0, "FAIL").otherwise("PASS"), F.col(f"_ty_{x}"), F.col(f"_ty_{x}"), True))
    if c.timestamp and c.timestamp in cols:
        ts = F.col(c.timestamp)
        aggs["_tnull"] = F.count_if(ts.isNull())
        if c.order and c.group:
            if dict(df.dtypes)[c.order] in ("int", "bigint", "smallint"):
                from .windows import blocked_row_shift

                work = blocked_row_shift(work.withColumn("_t", ts), c.group, [c.order], [("_prev_t", "_t", -1)],
                                         block_by=F.floor(F.col(c.order) / F.lit(1_000_000)))
                work = work.withColumn("_inv", (ts < F.col("_prev_t")).cast("int"))
            else:
                w = Window.partitionBy(*c.group).orderBy(c.order)
                work = work.withColumn("_inv", (ts < F.lag(ts).over(w)).cast("int"))
            aggs["_tinv"] = F.coalesce(F.sum("_inv"), F.lit(0))
        else:
            aggs["_tinv"] = F.lit(0)
        rows.append(lambda: _row("timestamp_order", F.when((F.col("_tnull") + F.col("_tinv")) > 0, "FAIL").otherwise("PASS"),
                                 F.col("_tnull") + F.col("_tinv"), F.col("_tinv"), True))
        if c.freshness_hours is not None and now is not None:
            aggs["_tmax"] = F.max(ts)
            age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp"))
                                          - F.unix_micros(F.col("_tmax").cast("timestamp"))) / F.lit(3.6e9))
            rows.append(lambda: _row("freshness", F.when(F.col("_tmax").isNull(), "WARN").when(age > c.freshness_hours, "WARN").otherwise("PASS"),
                                     0, age, False))
    cov = [x for x in c.coverage if x in cols]
    if cov:
        for x in cov:
            aggs[f"_cv_{x}"] = F.avg(F.col(x).isNull().cast("double"))
        worst_c = F.greatest(*[F.col(f"_cv_{x}") for x in cov]) if len(cov) > 1 else F.col(f"_cv_{cov[0]}")
        rows.append(lambda: _row("feature_coverage", F.when(worst_c > c.coverage_threshold, "WARN").otherwise("PASS"), 0, worst_c, False))
    one = work.agg(*[v.alias(k) for k, v in aggs.items()])
    all_rows = static + [r() for r in rows]
    return one.select(F.explode(F.array(*all_rows)).alias("r")).select("r.*")


def dq_bucket_coverage(df: DataFrame, keys=("city", "segment_id"), ts: str = "time_bucket", share: float = 0.25) -> DataFrame:
    """Segments with fewer distinct buckets than ``share`` x the median over segments."""
    per = df.groupBy(*keys).agg(F.count_distinct(ts).alias("buckets"))
    med = per.select(F.percentile("buckets", F.lit(0.5))).scalar()
    return per.withColumn("median_buckets", med).filter(F.col("buckets") < F.col("median_buckets") * F.lit(share))


def dq_rollup(results: DataFrame) -> DataFrame:
    """Overall status: FAIL if any critical FAIL, else WARN if any WARN/FAIL, else PASS; counts."""
    return results.agg(
        F.when(F.count_if((F.col("status") == "FAIL") & F.col("critical")) > 0, "FAIL")
        .when(F.count_if(F.col("status").isin("WARN", "FAIL")) > 0, "WARN").otherwise("PASS").alias("overall"),
        F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "SKIP").alias("skipped"),
        F.count_if((F.col("status") == "FAIL") & F.col("critical")).alias("critical_failed"),
    )


def overall_status(health: DataFrame, rollup: DataFrame, model_ready: bool, stale_hours: float = 168) -> DataFrame:
    """One row (status, reasons) for a system: ``Unhealthy`` if no dataset has rows or a critical check fails, ``Degraded`` if another
    reason holds, else ``OK``.  ``health`` has rows and age_hours per dataset (a few rows), ``rollup`` is the row of ``dq_rollup``; without
    one, evidence counts as missing.  The freshest dataset decides on staleness."""
    data = health.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("age_hours").alias("age"))
    both = data.join(rollup.agg(F.max("overall").alias("dq")), F.lit(True))  # one row each
    reasons = [
        (F.col("rows") == 0, "no_data"),
        (F.col("dq") == "FAIL", "critical_quality_failures"),
        (F.col("dq").isNull() | (F.col("dq") == "WARN"), "quality_warnings_or_no_evidence"),
        (F.lit(not model_ready), "no_model"),
        (F.col("age") > stale_hours, "stale_data"),
    ]
    both = both.select(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in reasons])).alias("reasons"))
    worst = F.arrays_overlap("reasons", F.array(F.lit("no_data"), F.lit("critical_quality_failures")))
    return both.select(F.when(worst, "Unhealthy").when(F.size("reasons") > 0, "Degraded").otherwise("OK").alias("status"), "reasons")


def referential_coverage(keys: DataFrame, reference: DataFrame, key: str, ref_key: str | None = None, warn_below: float = 0.95) -> DataFrame:
    """Share of distinct non-null keys present in the reference table; WARN below threshold."""
    ref_key = ref_key or key
    k = keys.select(F.col(key).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    r = reference.select(F.col(ref_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    j = k.join(r, "_k", "left")
    return j.agg(F.count(F.lit(1)).alias("distinct_keys"), F.count("_hit").alias("matched"),
                 (F.count("_hit") / F.count(F.lit(1))).alias("coverage")).withColumn(
        "status", F.when(F.col("coverage") < warn_below, "WARN").otherwise("PASS"))


def orphan_keys(keys: DataFrame, reference: DataFrame, key: str, ref_key: str | None = None) -> DataFrame:
    ref_key = ref_key or key
    k = keys.select(F.col(key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return k.join(reference.select(F.col(ref_key).alias(key)), key, "left_anti")
