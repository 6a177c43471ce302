"""Planted leaks are found by the recomputed evidence."""

import datetime as dt

from roadlens.operators.leakage import leakage_checks


def at(minute):
    return dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=minute)


def test_planted_leaks(spark):
    gold = spark.createDataFrame(
        [("h", "s", at(5), 10.0, 30.0, at(5)), ("h", "s", at(10), 20.0, 99.0, at(12)), ("h", "s", at(15), 77.0, None, None)],
        "city string, segment_id string, time_bucket timestamp_ntz, speed_lag_1 double, future_speed_10m double, weather_asof_time timestamp_ntz")
    source = spark.createDataFrame([("h", "s", at(k), v) for k, v in ((0, 10.0), (5, 20.0), (10, 25.0), (15, 30.0), (20, 31.0))],
                                   "city string, segment_id string, time_bucket timestamp_ntz, currentSpeed double")
    got = {r.check_name: r.violations for r in leakage_checks(gold, source, 5, 10).collect()}
    assert got == {"lag_1_matches_source": 1, "target_matches_source": 1, "asof_weather_not_future": 1}
