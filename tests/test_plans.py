"""Plan assertions: no cross products or Python UDFs where none are promised, and column
pruning / filter pushdown reach the Parquet scan."""

import pytest

import __spark_entry__ as E
from shared import SF_SMALL

NO_CROSS = ["gold_features", "event_grid_join", "asof_weather_backward", "asof_weather_nearest", "snap_to_segment",
            "simhash_near_dups", "minhash_near_dups", "dbscan_labels", "fuzzy_event_groups"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["gold_features", "bronze_news", "normalize_events", "dq_run_contract", "simhash64"])
def test_no_python_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["clean_weather"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "PushedFilters" in plan
