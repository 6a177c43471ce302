"""Long (metric, value) reports built from one aggregate pass plus small grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fix4(c):
    return (F.floor(c * F.lit(1e4) + F.lit(0.5)).cast("double") / F.lit(1e4)).cast("string")


def metric_report(bronze: DataFrame, top_n: int = 10) -> DataFrame:
    """Totals, duplicate count, missing rates, per-provider/domain counts, flag distribution,
    top sources. One ``agg`` + ``unpivot`` for the scalar metrics; grouped counts for the rest."""
    scalars = bronze.agg(
        F.count(F.lit(1)).cast("string").alias("total_records"),
        F.count_if(F.col("is_exact_duplicate")).cast("string").alias("exact_duplicates"),
        _fix4(F.avg(F.col("published_at").isNull().cast("double"))).alias("missing_published_at_rate"),
        _fix4(F.avg(F.col("summary_text").isNull().cast("double"))).alias("missing_summary_rate"),
    )
    long = scalars.unpivot([], ["total_records", "exact_duplicates", "missing_published_at_rate", "missing_summary_rate"],
                           "metric", "value")
    prov = bronze.groupBy("provider").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("provider:"), F.coalesce(F.col("provider"), F.lit("null"))).alias("metric"), F.col("n").cast("string").alias("value"))
    dom = bronze.groupBy("source_domain").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("domain:"), F.coalesce(F.col("source_domain"), F.lit("null"))).alias("metric"), F.col("n").cast("string").alias("value"))
    flags = bronze.select(F.explode("data_quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("flag:"), F.col("flag")).alias("metric"), F.col("n").cast("string").alias("value"))
    top = (bronze.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("source")).limit(top_n)
           .select(F.concat(F.lit("top_source:"), F.col("source")).alias("metric"), F.col("n").cast("string").alias("value")))
    return long.unionByName(prov).unionByName(dom).unionByName(flags).unionByName(top)


def _blank(c: str):
    text = F.trim(F.col(c).cast("string"))
    return F.col(c).isNull() | text.isin("", "null", "None", "nan")


def event_report(raw: DataFrame, normalized: DataFrame, deduped: DataFrame) -> DataFrame:
    """(metric, value): totals and missing fields of the raw news, cities found, unrelated and usable events before and after dedup, then
    events by category, city, severity and confidence of their time.  One combining aggregate a table; the four distributions come from
    one grouping of (kind, value) pairs.  Empty tables give zeros and no distributions."""
    def counts(df, **metrics):
        one = df.agg(*[F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in metrics.items()])
        return one.unpivot([], list(metrics), "metric", "value")

    total, flag = F.count(F.lit(1)), F.count_if(F.col("is_relevant_for_traffic_model") == 1)
    out = counts(raw, raw_records=total, raw_missing_published_at=F.count_if(_blank("published_at")), raw_missing_summary=F.count_if(_blank("summary")))
    out = out.unionByName(counts(
        normalized, normalized_missing_city_after_detect=F.count_if(F.col("city").isNull()), city_detected_or_retained=F.count("city"),
        unrelated_records=F.count_if(F.col("event_category") == "unrelated"), model_eligible_records_before_dedup=flag))
    out = out.unionByName(counts(deduped, events_after_semantic_dedup=total, model_eligible_events_after_dedup=flag))
    both = normalized.select(F.lit(1).alias("n")).unionAll(deduped.select(F.lit(-1).alias("n")))
    out = out.unionByName(counts(both, events_removed_by_semantic_dedup=F.sum("n")))
    kinds = {"event_category": F.col("event_category"), "city": F.coalesce("city", F.lit("missing")), "severity_score": F.col("severity_score").cast("string"),
             "event_time_confidence": F.col("event_time_confidence")}
    named = F.explode(F.array(*[F.concat(F.lit(f"{k}."), v) for k, v in kinds.items()])).alias("metric")
    per = normalized.select(named).filter("metric IS NOT NULL").groupBy("metric").agg(F.count(F.lit(1)).alias("value"))
    return out.unionByName(per)
