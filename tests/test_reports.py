"""Overall status and the event half of the report on small tables."""

from roadlens.operators import quality as Q
from roadlens.operators.reports import event_report

HEALTH = "dataset string, rows long, age_hours double"


def status(spark, health, dq, model=True):
    row = Q.overall_status(spark.createDataFrame(health, HEALTH), spark.createDataFrame(dq, "overall string"), model).first()
    return row.status, row.reasons


def test_overall_status(spark):
    fresh, old = [("a", 5, 3.0), ("b", 1, 900.0)], [("a", 5, 169.0)]
    assert status(spark, fresh, [("PASS",)]) == ("OK", [])
    assert status(spark, fresh, [("WARN",)], False) == ("Degraded", ["quality_warnings_or_no_evidence", "no_model"])
    assert status(spark, old, []) == ("Degraded", ["quality_warnings_or_no_evidence", "stale_data"])
    assert status(spark, old, [("FAIL",)]) == ("Unhealthy", ["critical_quality_failures", "stale_data"])
    assert status(spark, [("a", 0, None)], [("PASS",)]) == ("Unhealthy", ["no_data"])
    assert status(spark, [], [("PASS",)]) == ("Unhealthy", ["no_data"])


def test_event_report(spark):
    raw = spark.createDataFrame([(None, "x"), ("2024", " "), ("nan", None)], "published_at string, summary string")
    schema = "city string, event_category string, severity_score int, event_time_confidence string, is_relevant_for_traffic_model int"
    events = spark.createDataFrame([("hanoi", "flood", 4, "high", 1), ("hanoi", "flood", 4, "low", 1), (None, "unrelated", 0, None, 0)], schema)
    got = {r.metric: r.value for r in event_report(raw, events, events.limit(2)).collect()}
    assert got == {
        "raw_records": 3, "raw_missing_published_at": 2, "raw_missing_summary": 2, "normalized_missing_city_after_detect": 1, "city_detected_or_retained": 2,
        "unrelated_records": 1, "model_eligible_records_before_dedup": 2, "events_after_semantic_dedup": 2, "model_eligible_events_after_dedup": 2,
        "events_removed_by_semantic_dedup": 1, "event_category.flood": 2, "event_category.unrelated": 1, "city.hanoi": 2, "city.missing": 1,
        "severity_score.4": 2, "severity_score.0": 1, "event_time_confidence.high": 1, "event_time_confidence.low": 1}
    none = {r.metric: r.value for r in event_report(raw.limit(0), events.limit(0), events.limit(0)).collect()}
    assert len(none) == 10 and set(none.values()) == {0}
