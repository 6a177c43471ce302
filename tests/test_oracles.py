"""Registered queries against their DuckDB oracles (same parquet tables), the way the
driver's correctness gate compares them: row count, column names, order-free value hash."""

import pytest

import __spark_entry__ as E
from shared import SF_SMALL
from roadlens.plans.catalog import ORACLES, QUERIES
from tools.oracle_check import digest, duck_connect, type_mismatches

# a cross-section of every section of the inventory (the full list runs in tools/oracle_check.py)
SELECTED = [
    "clean_traffic", "dedup_traffic", "exact_lag_join", "exact_horizon_target", "strict_history_rolling", "latest_by_segment",
    "top_congested", "continuity_report", "asof_weather_backward", "asof_weather_nearest", "join_latest_weather",
    "event_grid_join", "event_interval_join", "speed_percentiles", "baseline_features", "gold_features", "dashboard_summary",
    "segment_risk", "predicted_hotspots", "speed_alerts", "scenario_impact", "clean_html", "canonical_url", "classify_event",
    "bronze_news", "normalize_events", "extract_links", "simhash_near_dups", "minhash_near_dups", "layered_dedup",
    "fuzzy_event_groups", "graph_edges", "degree_centrality", "dbscan_labels", "dq_run_contract", "dq_rollup", "leakage_checks",
    "regression_metrics", "walk_forward", "perturbation_attribution", "drop_low_variance", "rolling_time_stats",
    "row_lags", "shape_traffic_record", "parse_geometry", "read_traffic_jsonl", "upsert", "stream_to_bronze", "stream_dedup",
    "stream_bucket_agg", "gold_features_rowbased",
]


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", SELECTED)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols, drows = [d[0] for d in res.description], res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert not type_mismatches(sdf, duck, E.oracle_sql()[name])
    assert len(srows) == len(drows)
    assert digest(scols, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_an_oracle_or_is_model_dependent():
    missing = set(QUERIES) - set(ORACLES)
    assert missing <= {"train_regressor", "batch_predict", "geojson_features"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
