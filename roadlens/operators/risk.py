"""Risk scores, predicted hotspots, reliability, alerts and what-if scenarios.

All rules are column expressions; rule lists are arrays filtered per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _num(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


# Risk component weights (sum 1) and level thresholds.
RISK_WEIGHTS = {
    "congestion_ratio": 0.35, "prediction_drop_ratio": 0.25, "upstream_congestion_score": 0.15,
    "rain_severity": 0.10, "event_severity": 0.10, "data_uncertainty": 0.05,
}


def risk_level(score: Column, critical: float = 80, high: float = 60) -> Column:
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= 30, "medium").otherwise("low")


def segment_risk(df: DataFrame, predicted: str | None = "predicted_speed", coverage: str | None = None) -> DataFrame:
    """Six clipped components, weighted .35/.25/.15/.10/.10/.05 -> score 0..100, level, and the
    list of components >= 0.5 (``triggered_rules``)."""
    cur = _num(df, "currentSpeed")
    free = F.coalesce(F.col("freeFlowSpeed").cast("double"), F.greatest(cur, F.lit(1.0))) if "freeFlowSpeed" in df.columns else F.greatest(cur, F.lit(1.0))
    jam = _num(df, "jamFactor")
    pred = F.coalesce(F.col(predicted), cur) if predicted and predicted in df.columns else cur
    comps = {
        "congestion_ratio": F.when(free > 0, _clip01(F.lit(1.0) - cur / free)).otherwise(F.least(jam / 10.0, F.lit(1.0))),
        "prediction_drop_ratio": F.when(cur > 0, _clip01((cur - pred) / cur)).otherwise(F.lit(0.0)),
        "upstream_congestion_score": _clip01(_num(df, "upstream_congestion_score") / 10.0),
        "rain_severity": _clip01(_num(df, "weather_rain_1h") / 30.0 + _num(df, "weather_severity") / 10.0),
        "event_severity": _clip01(_num(df, "max_event_severity_1h") / 10.0 + _num(df, "accident_count_1h") * 0.25
                                  + _num(df, "news_event_count_1h") * 0.08),
        "data_uncertainty": _clip01(F.lit(1.0) - (_num(df, coverage, 1.0) if coverage else F.lit(1.0))),
    }
    out = df.withColumns({f"risk_{k}": v for k, v in comps.items()})
    score = sum((F.lit(w) * F.col(f"risk_{k}") for k, w in RISK_WEIGHTS.items()), F.lit(0.0)) * F.lit(100.0)
    out = out.withColumn("risk_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    rules = F.array(*[F.when(F.col(f"risk_{k}") >= 0.5, F.lit(k)) for k in RISK_WEIGHTS])
    return out.withColumns({"risk_level": risk_level(F.col("risk_score")), "triggered_rules": F.array_compact(rules)})


# Predicted-hotspot thresholds and weights.
HOTSPOT_CONFIG = {
    "low_speed_kph": 20.0, "free_flow_ratio_threshold": 0.5, "speed_drop_pct_threshold": 30.0,
    "high_risk_threshold": 60.0, "critical_risk_threshold": 80.0,
    "weights": {"low_speed": 35.0, "free_flow_ratio": 25.0, "speed_drop": 20.0, "current_jam": 10.0, "context_multiplier": 10.0},
}


def predicted_hotspots(df: DataFrame, predicted: str = "predicted_speed", config: dict | None = None, drop_low: bool = True) -> DataFrame:
    """Threshold rules on the forecast (speed < 20, ratio < .5, drop > 30 %, current jam, context)
    weighted 35/25/20/10/10 -> score, level and rules; "low" dropped; ordered by score desc, speed asc."""
    cfg = config or HOTSPOT_CONFIG
    wts = cfg["weights"]
    pred = F.col(predicted).cast("double")
    cur = _num(df, "currentSpeed")
    free = _num(df, "freeFlowSpeed")
    jam = _num(df, "jamFactor")
    ratio = F.when(free > 0, pred / free)
    drop = F.when(cur > 0, (cur - pred) / cur * 100.0).otherwise(F.lit(0.0))
    rain, wsev = _num(df, "weather_rain_1h"), _num(df, "weather_severity")
    heavy = (_num(df, "has_rain") != 0) & ((rain >= 10) | (wsev >= 2))
    ev_risk = F.least(F.lit(1.0), _num(df, "accident_count_1h") * 0.45 + _num(df, "news_event_count_1h") * 0.15
                      + _num(df, "max_event_severity_1h") / 10.0)
    w_risk = F.least(F.lit(1.0), wsev / 10.0 + F.when(heavy, 0.35).otherwise(0.0))
    out = df.withColumns({
        "speed_drop_pct": drop,
        "predicted_free_flow_ratio": ratio,
        "_c_low": F.when(pred < cfg["low_speed_kph"], 1.0).otherwise(0.0),
        "_c_ratio": F.when(ratio.isNotNull() & (ratio < cfg["free_flow_ratio_threshold"]), 1.0).otherwise(0.0),
        "_c_drop": F.when(drop > cfg["speed_drop_pct_threshold"], 1.0).otherwise(0.0),
        "_c_jam": F.least(F.greatest(jam / 10.0, F.lit(0.0)), F.lit(1.0)),
        "_c_ctx": F.greatest(ev_risk, w_risk),
    })
    score = (F.lit(wts["low_speed"]) * F.col("_c_low") + F.lit(wts["free_flow_ratio"]) * F.col("_c_ratio")
             + F.lit(wts["speed_drop"]) * F.col("_c_drop") + F.lit(wts["current_jam"]) * F.col("_c_jam")
             + F.lit(wts["context_multiplier"]) * F.col("_c_ctx"))
    out = out.withColumn("risk_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))
    out = out.withColumn("risk_level", risk_level(F.col("risk_score"), cfg["critical_risk_threshold"], cfg["high_risk_threshold"]))
    rules = F.array(
        F.when(F.col("_c_low") > 0, F.lit("predicted_speed_below_20")),
        F.when(F.col("_c_ratio") > 0, F.lit("predicted_speed_below_half_free_flow")),
        F.when(F.col("_c_drop") > 0, F.lit("speed_drop_above_30pct")),
        F.when(F.col("_c_jam") >= 0.6, F.lit("current_jam_factor_high")),
        F.when(F.col("_c_ctx") > 0, F.lit("context_risk_signal_present")),
    )
    out = out.withColumn("triggered_rules", F.array_compact(rules)).drop("_c_low", "_c_ratio", "_c_drop", "_c_jam", "_c_ctx")
    if drop_low:
        out = out.filter(F.col("risk_level") != "low")
    return out


# Residual band half-width per horizon (km/h), default 8.
RESIDUAL_BAND = {"15m": 5.0, "60m": 7.5, "240m": 12.0}


def prediction_reliability(df: DataFrame, now: str, horizon: str = "horizon", required: str = "required_feature_count",
                           available: str = "available_feature_count", latest_ts: str = "timestamp",
                           predicted: str = "predicted_speed", fallback: str | None = None) -> DataFrame:
    """coverage = available/required; freshness vs injected now; level high/medium/low;
    band half-width = base + (1 - coverage) * base + base if fallback."""
    req, av = F.col(required).cast("double"), F.col(available).cast("double")
    cov = F.when(req > 0, av / req).otherwise(F.lit(0.0))
    fresh = F.greatest(F.lit(0), (F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp"))
                                  - F.unix_micros(F.col(latest_ts).cast("timestamp"))) / F.lit(1_000_000)).cast("bigint")
    fb = F.coalesce(F.col(fallback), F.lit(False)) if fallback else F.lit(False)
    level = (F.when(fb | (cov < 0.7) | (fresh.isNotNull() & (fresh > 3600)), "low")
             .when((cov < 0.9) | fresh.isNull() | (fresh > 600), "medium").otherwise("high"))
    base_map = F.create_map(*[x for k, v in RESIDUAL_BAND.items() for x in (F.lit(k), F.lit(v))])
    base = F.coalesce(F.element_at(base_map, F.col(horizon)), F.lit(8.0))
    half = base + (F.lit(1.0) - F.least(F.greatest(cov, F.lit(0.0)), F.lit(1.0))) * base + F.when(fb, base).otherwise(0.0)
    speed = F.col(predicted).cast("double")
    return df.withColumns({
        "feature_coverage_ratio": cov,
        "data_freshness_seconds": fresh,
        "reliability_level": level,
        "band_low": F.when(speed.isNotNull(), F.greatest(F.lit(0.0), speed - half)),
        "band_high": F.when(speed.isNotNull(), speed + half),
    })


def speed_alerts(df: DataFrame, predicted: str = "predicted_speed", keep_highest: bool = False) -> DataFrame:
    """CRITICAL < .8*p15, HIGH < .7*p50, MEDIUM < .9*p50, LOW < p50; a deceleration of more than
    20 km/h from lag 1 forces MEDIUM (also over CRITICAL, as specified) unless ``keep_highest``.
    Rows without a rule are dropped. Missing p15/p50 fall back to 20/35, nulls to 0."""
    z = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in df.columns else F.lit(d)
    cur = z("currentSpeed")
    pred = F.coalesce(F.col(predicted).cast("double"), cur) if predicted in df.columns else cur
    p15 = F.coalesce(F.col("p15"), F.lit(20.0)) if "p15" in df.columns else F.lit(20.0)
    p50 = F.coalesce(F.col("p50"), F.lit(35.0)) if "p50" in df.columns else F.lit(35.0)
    sev = (F.when(pred < p15 * 0.8, "CRITICAL").when(pred < p50 * 0.7, "HIGH")
           .when(pred < p50 * 0.9, "MEDIUM").when(pred < p50, "LOW"))
    lag1 = z("speed_lag_1")
    decel = (lag1 > 0) & ((lag1 - cur) > 20)
    if keep_highest:
        forced = F.when(decel & (sev.isNull() | sev.isin("LOW")), F.lit("MEDIUM")).otherwise(sev)
    else:
        forced = F.when(decel, F.lit("MEDIUM")).otherwise(sev)
    reason = (F.when(decel, F.format_string("Rapid deceleration: %.1f km/h (was %.1f km/h)", cur, lag1))
              .when(sev == "CRITICAL", F.format_string("Speed %.1f km/h is <80%% of baseline p15 (%.1f km/h)", pred, p15))
              .when(sev == "HIGH", F.format_string("Speed %.1f km/h is <70%% of baseline p50 (%.1f km/h)", pred, p50))
              .when(sev == "MEDIUM", F.format_string("Speed %.1f km/h is <90%% of baseline p50 (%.1f km/h)", pred, p50))
              .when(sev == "LOW", F.format_string("Speed %.1f km/h is below baseline p50 (%.1f km/h)", pred, p50)))
    out = df.withColumns({"severity": forced, "reason": reason, "alert_predicted_speed": pred, "baseline_p15": p15, "baseline_p50": p50})
    return out.filter(F.col("severity").isNotNull())


def jam_alerts(latest: DataFrame, min_jam: float = 3.0) -> DataFrame:
    """Latest rows with jam >= 3: severity from jam, reason text, id; highest jam first."""
    from ..functions.traffic import severity_from_jam

    base = F.coalesce(F.col("p50"), F.col("freeFlowSpeed"), F.col("currentSpeed")) if "p50" in latest.columns else \
        F.coalesce(F.col("freeFlowSpeed"), F.col("currentSpeed"))
    out = latest.filter(F.col("jamFactor") >= min_jam).withColumns({
        "severity": severity_from_jam("jamFactor"),
        "baseline_p50": base,
        "alert_id": F.concat(F.lit("alert_"), F.col("city"), F.lit("_"), F.col("segment_id")),
    })
    return out.withColumn("reason", F.format_string("Jam factor %.1f; speed %.1f km/h versus baseline %.1f km/h",
                                                    F.col("jamFactor"), F.col("currentSpeed"), F.col("baseline_p50")))


def alert_reasons(alerts: DataFrame) -> DataFrame:
    """why[] sentences, recommended action, confidence and affected segments per alert."""
    why = F.array_compact(F.array(
        F.format_string("Jam factor is %.1f with speed %.1f km/h versus baseline %.1f km/h",
                        F.col("jamFactor"), F.col("currentSpeed"), F.col("baseline_p50")),
        F.when(F.col("risk_score").isNotNull(), F.format_string("Risk score is %.1f/100 (%s)", F.col("risk_score"), F.col("risk_level")))
        if "risk_score" in alerts.columns else F.lit(None).cast("string"),
        F.when(F.size(F.col("triggered_rules")) > 0, F.concat(F.lit("Triggered risk signals: "), F.array_join(F.slice(F.col("triggered_rules"), 1, 3), ", ")))
        if "triggered_rules" in alerts.columns else F.lit(None).cast("string"),
    ))
    action = (F.when(F.col("severity").isin("CRITICAL", "HIGH"), "Prioritize monitoring this corridor and suggest an alternative route.")
              .when(F.col("severity") == "MEDIUM", "Monitor the segment and keep route alternatives ready.")
              .otherwise("Track the segment; no immediate intervention required."))
    return alerts.withColumns({"why": why, "recommended_action": action, "confidence_level": F.lit("medium"),
                               "affected_segments": F.array(F.col("segment_id").cast("string"))})


def join_operator_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts left-joined to the latest stored operator status per alert id (append-only
    history, newest wins by ``max_by``); default active; dismissed alerts removed."""
    latest = actions.groupBy("alert_id").agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"))
    j = alerts.join(latest, "alert_id", "left").withColumn("status", F.coalesce(F.col("status"), F.lit("active")))
    return j.withColumn("acknowledged", F.col("status") == "acknowledged").filter(F.col("status") != "dismissed")


def scenario_impact(latest: DataFrame, scenarios: list[dict], predicted: str = "predicted_speed") -> DataFrame:
    """Every latest segment under every scenario (rain mm, event type, peak flag): speed
    multipliers, simulated speed, delta, percent and risk before/after. Scenarios are a
    parameter list; each segment row is expanded by ``explode`` (no join)."""
    base = F.coalesce(F.col(predicted), F.col("currentSpeed"), F.lit(0.0)) if predicted in latest.columns else F.coalesce(F.col("currentSpeed"), F.lit(0.0))
    lits = [F.struct(F.lit(s["scenario_id"]).alias("scenario_id"), F.lit(float(s.get("rain_1h_mm", 0.0))).alias("rain_1h_mm"),
                     F.lit(s.get("event_type", "none")).alias("event_type"),
                     F.lit(bool(s.get("is_peak_hour", False))).alias("is_peak_hour_scenario")) for s in scenarios]
    j = latest.withColumn("baseline_speed", base).withColumn("_rl_s", F.explode(F.array(*lits))).select("*", "_rl_s.*").drop("_rl_s")
    rain = F.coalesce(F.col("rain_1h_mm"), F.lit(0.0))
    ev = F.lower(F.coalesce(F.col("event_type"), F.lit("none")))
    m_rain = F.when(rain > 0, F.greatest(F.lit(0.65), F.lit(1.0) - F.least(rain, F.lit(40.0)) * 0.008)).otherwise(1.0)
    m_ev = F.when(ev == "accident", 0.72).when(ev == "flood", 0.78).when(ev == "roadwork", 0.86).otherwise(1.0)
    m_peak = F.when(F.coalesce(F.col("is_peak_hour_scenario"), F.lit(False)), 0.9).otherwise(1.0)
    sim = F.greatest(F.lit(0.0), F.col("baseline_speed") * m_rain * m_ev * m_peak)
    j = j.withColumn("simulated_speed", sim)
    j = j.withColumn("speed_delta", F.col("simulated_speed") - F.col("baseline_speed"))
    j = j.withColumn("speed_delta_pct", F.when(F.col("baseline_speed") > 0, F.col("speed_delta") / F.col("baseline_speed") * 100.0).otherwise(0.0))
    if "weather_rain_1h" in j.columns:
        j = j.withColumn("weather_rain_1h", F.when(rain > 0, rain).otherwise(F.col("weather_rain_1h")))
        j = j.withColumn("weather_severity", F.when(rain > 0, F.greatest(F.coalesce(F.col("weather_severity").cast("double"), F.lit(0.0)),
                                                                          F.least(F.lit(10.0), rain / 3.0))).otherwise(F.col("weather_severity").cast("double")))
    if "news_event_count_1h" in j.columns:
        hit = ev.isin("accident", "flood", "roadwork")
        j = j.withColumn("news_event_count_1h", F.when(hit, F.greatest(F.col("news_event_count_1h").cast("double"), F.lit(1.0))).otherwise(F.col("news_event_count_1h").cast("double")))
        j = j.withColumn("max_event_severity_1h", F.when(hit, F.greatest(F.col("max_event_severity_1h").cast("double"), F.lit(7.0))).otherwise(F.col("max_event_severity_1h").cast("double")))
    before = segment_risk(j, predicted="baseline_speed").select(*j.columns, F.col("risk_score").alias("baseline_risk_score"))
    after = segment_risk(before, predicted="simulated_speed").withColumnRenamed("risk_score", "simulated_risk_score")
    return after.drop(*[c for c in after.columns if c.startswith("risk_")], "triggered_rules")
