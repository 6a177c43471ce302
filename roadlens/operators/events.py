"""Event-to-traffic range features.

Event features depend only on (city, time bucket), so they are computed once per
distinct (city, bucket) and joined back to segments. Both the grid features and the per-row
look-back read running aggregates over bins of the look-back's width (``look_back``):
linear in rows, no point x event pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import epoch_micros

# Categories that count as active traffic events, relevance threshold, windows.
ACTIVE_CATEGORIES = (
    "accident", "congestion", "flood", "weather_disruption", "roadwork_active", "airport",
    "public_transport", "enforcement", "planned_event",
)
MODEL_RELEVANCE_THRESHOLD = 0.55
ROADWORK = ("roadwork_active", "roadwork_planned")
WEATHERISH = ("weather_disruption", "flood")
HOUR_US = 3_600_000_000

EVENT_FEATURES = (
    "news_event_count_1h", "news_event_count_3h", "news_event_count_6h", "accident_count_1h",
    "congestion_news_count_1h", "roadwork_count_24h", "weather_disruption_count_6h", "flood_count_6h",
    "max_event_severity_1h", "max_event_severity_6h", "avg_traffic_relevance_score_6h", "has_recent_accident",
    "has_recent_roadwork", "has_recent_flood", "has_major_event", "has_weather_disruption",
)


def relevant_events(events: DataFrame, category: str = "event_category", relevance: str = "traffic_relevance_score") -> DataFrame:
    """Events usable as model features: city set, active category, relevance >= 0.55."""
    return events.filter(
        F.col("city").isNotNull() & F.col(category).isin(*ACTIVE_CATEGORIES) & (F.col(relevance) >= MODEL_RELEVANCE_THRESHOLD)
    )


def look_back(points: DataFrame, events: DataFrame, key: str, point_ts: str, event_ts: str, spans_us: Sequence[int],
              measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per distinct point (key, point_ts) and span: aggregates over the events of the key in
    [point - span, point], both ends included. ``measures``: name -> ("sum" or "max", event column); the
    result has one column ``<name>_<i>`` per measure and index of span, null where there is no event.

    A span is cut into bins of its own width: it reaches from a point in one bin to a point in the next, so
    each aggregate is what the first bin holds from there on combined with what the second holds up to the
    point. Both are running aggregates (frames that only grow, which Spark updates row by row), so the
    work is linear in rows however dense a bin is; no point x event pairs arise, and a key with a third of
    all events is spread over its bins."""
    span = F.col("_rl_span")
    every_span = F.explode(F.array(*[F.lit(int(x)) for x in spans_us])).alias("_rl_span")
    g = points.select(key, point_ts).distinct().select(key, point_ts, epoch_micros(point_ts).alias("_rl_t"), every_span)
    # a point reads upwards at its own instant (side 1: after the events of that instant) and downwards at the
    # start of the span (side -1: in descending order also after the events of that instant)
    probes = g.withColumn("_rl_side", F.explode(F.array(F.lit(1), F.lit(-1))))
    probes = probes.withColumn("_rl_t", F.when(F.col("_rl_side") == 1, F.col("_rl_t")).otherwise(F.col("_rl_t") - span))
    ev = events.select(key, epoch_micros(event_ts).alias("_rl_t"), F.lit(0).alias("_rl_side"), *[c.alias(f"_rl_m_{n}") for n, (_, c) in measures.items()], every_span)
    u = probes.unionByName(ev, allowMissingColumns=True).withColumn("_rl_bin", F.floor(F.col("_rl_t") / span))
    order2 = F.col("_rl_t") * 2 + F.col("_rl_side")
    w = Window.partitionBy(key, "_rl_span", "_rl_bin")
    grown = {d: w.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for d, o in (("up", order2), ("down", order2.desc()))}
    agg = {"sum": F.sum, "max": F.max}
    read = u.withColumns({f"_rl_{d}_{n}": agg[kind](f"_rl_m_{n}").over(o) for n, (kind, _) in measures.items() for d, o in grown.items()})
    read = read.filter(F.col("_rl_side") != 0).select(
        key, point_ts, "_rl_span", *[F.when(F.col("_rl_side") == 1, F.col(f"_rl_up_{n}")).otherwise(F.col(f"_rl_down_{n}")).alias(f"_rl_v_{n}") for n in measures])
    return read.groupBy(key, point_ts).agg(*[
        agg[kind](F.when(span == int(x), F.col(f"_rl_v_{n}"))).alias(f"{n}_{i}") for i, x in enumerate(spans_us) for n, (kind, _) in measures.items()])


def event_grid_features(buckets: DataFrame, events: DataFrame, event_ts: str = "event_time") -> DataFrame:
    """Per distinct (city, time_bucket): counts/maxima/averages of relevant events in the last
    1/3/6/24 hours (bounds inclusive); buckets without events get zeros (see ``look_back``)."""
    cat, score = F.col("event_category"), F.col("traffic_relevance_score")

    def hit(cond):
        return "sum", F.when(cond, 1).otherwise(0)

    out = look_back(buckets, events, "city", "time_bucket", event_ts, [h * HOUR_US for h in (1, 3, 6, 24)], {
        "n": hit(F.lit(True)), "accident": hit(cat == "accident"), "congestion": hit(cat == "congestion"), "roadwork": hit(cat.isin(*ROADWORK)),
        "weather": hit(cat.isin(*WEATHERISH)), "flood": hit(cat == "flood"), "severity": ("max", F.col("severity_score")),
        "score": ("sum", score), "scored": hit(score.isNotNull()),
    })
    names = {
        "n_0": "news_event_count_1h", "n_1": "news_event_count_3h", "n_2": "news_event_count_6h", "accident_0": "accident_count_1h",
        "congestion_0": "congestion_news_count_1h", "roadwork_3": "roadwork_count_24h", "weather_2": "weather_disruption_count_6h",
        "flood_2": "flood_count_6h", "severity_0": "max_event_severity_1h", "severity_2": "max_event_severity_6h",
    }
    out = out.select("city", "time_bucket", *[F.col(k).alias(v) for k, v in names.items()], F.try_divide("score_2", "scored_2").alias("avg_traffic_relevance_score_6h"))
    counts = [c for c in EVENT_FEATURES if "count" in c]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts})
    out = out.withColumns({
        "max_event_severity_1h": F.coalesce(F.col("max_event_severity_1h"), F.lit(0)).cast("bigint"),
        "max_event_severity_6h": F.coalesce(F.col("max_event_severity_6h"), F.lit(0)).cast("bigint"),
        "avg_traffic_relevance_score_6h": F.coalesce(F.col("avg_traffic_relevance_score_6h"), F.lit(0.0)),
    })
    return out.withColumns({
        "has_recent_accident": (F.col("accident_count_1h") > 0).cast("int"),
        "has_recent_roadwork": (F.col("roadwork_count_24h") > 0).cast("int"),
        "has_recent_flood": (F.col("flood_count_6h") > 0).cast("int"),
        "has_major_event": (F.col("max_event_severity_6h") >= 4).cast("int"),
        "has_weather_disruption": (F.col("weather_disruption_count_6h") > 0).cast("int"),
    })


def event_grid_join(grid: DataFrame, events: DataFrame, event_ts: str = "event_time") -> DataFrame:
    """(city, segment, bucket) grid with event features of its (city, bucket)."""
    cells = grid.select("city", "segment_id", "time_bucket").distinct()
    feats = event_grid_features(cells.select("city", "time_bucket").distinct(), relevant_events(events), event_ts)
    return cells.join(feats, ["city", "time_bucket"], "left")


def merge_event_features(gold: DataFrame, features: DataFrame, keys: Sequence[str] = ("city", "segment_id", "time_bucket")) -> DataFrame:
    """Left join event features onto Gold, replacing overlapping columns; nulls -> 0 and
    placeholder flags combined with the recent-event flags by max."""
    feat_cols = [c for c in features.columns if c not in keys]
    base = gold.drop(*[c for c in feat_cols if c in gold.columns])
    j = base.join(features, list(keys), "left")
    for c in EVENT_FEATURES:
        if c not in j.columns:
            j = j.withColumn(c, F.lit(0))
    j = j.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in EVENT_FEATURES})
    for flag in ("has_accident", "has_flood", "has_roadwork"):
        if flag not in j.columns:
            j = j.withColumn(flag, F.lit(0))
    return j.withColumns({
        "has_accident": F.greatest(F.coalesce(F.col("has_accident"), F.lit(0)), F.col("has_recent_accident")).cast("int"),
        "has_flood": F.greatest(F.coalesce(F.col("has_flood"), F.lit(0)), F.col("has_recent_flood")).cast("int"),
        "has_roadwork": F.greatest(F.coalesce(F.col("has_roadwork"), F.lit(0)), F.col("has_recent_roadwork")).cast("int"),
        "has_any_event": (F.col("news_event_count_6h") > 0).cast("int"),
        "max_event_severity_1h": F.col("max_event_severity_1h").cast("int"),
        "max_event_severity_6h": F.col("max_event_severity_6h").cast("int"),
    })


EVENT_TYPE_ALIASES = {"accident": "accident", "flood": "flood", "roadwork": "roadwork", "road_work": "roadwork",
                      "roadwork_active": "roadwork", "event": "event", "planned_event": "event"}


def event_interval_join(traffic: DataFrame, events: DataFrame, lookback_minutes: int = 60, ts: str = "timestamp",
                        event_ts: str = "event_time", type_col: str = "event_category", severity: str = "severity_score") -> DataFrame:
    """Lakehouse path, documented rule: events of the same city within the last 60 minutes
    (inclusive) -> has_accident/flood/roadwork/event, max severity per type, has_any_event;
    one output row per input row. Both roadwork spellings are mapped."""
    alias = F.create_map(*[x for k, v in EVENT_TYPE_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    ev = events.select("city", F.col(event_ts).alias("_rl_et"), F.element_at(alias, F.col(type_col)).alias("_rl_kind"),
                       F.col(severity).alias("_rl_sev")).filter(F.col("_rl_kind").isNotNull())
    kinds = ("accident", "flood", "roadwork", "event")
    of = {k: F.when(F.col("_rl_kind") == k, F.col("_rl_sev")) for k in kinds}
    agg = look_back(traffic.select("city", F.col(ts).alias("_rl_p")), ev, "city", "_rl_p", "_rl_et", [lookback_minutes * 60_000_000], {
        **{f"max_{k}": ("max", of[k]) for k in kinds}, **{f"n_{k}": ("sum", F.when(F.col("_rl_kind") == k, 1).otherwise(0)) for k in kinds}})
    agg = agg.select("city", F.col("_rl_p").alias("_rl_t"), *[F.col(f"max_{k}_0").alias(f"max_{k}_severity_1h") for k in kinds], *[F.col(f"n_{k}_0").alias(f"_n_{k}") for k in kinds])
    agg = agg.withColumnRenamed("city", "_rl_city")
    j = traffic.join(agg, (F.col("city") == F.col("_rl_city")) & (F.col(ts) == F.col("_rl_t")), "left").drop("_rl_city", "_rl_t")
    cols = {f"has_{k}": (F.coalesce(F.col(f"_n_{k}"), F.lit(0)) > 0).cast("int") for k in kinds}
    cols.update({f"max_{k}_severity_1h": F.coalesce(F.col(f"max_{k}_severity_1h"), F.lit(0)).cast("int") for k in kinds})
    j = j.withColumns(cols).drop(*[f"_n_{k}" for k in kinds])
    return j.withColumn("has_any_event", F.greatest(*[F.col(f"has_{k}") for k in kinds]))
