"""Models: categorical columns."""

from roadlens.operators import ml as M


def test_categorical_columns_decide_and_nulls_read_as_the_most_frequent(spark):
    rows = [("a'b", 1.0, 10.0)] * 30 + [("c", 1.0, 50.0)] * 20 + [(None, None, 10.0)] * 5
    df = spark.createDataFrame(rows, "kind string, x double, y double")
    assert M.model_features(df.withColumn("x", df.x + (df.y % 7)), [], {}, "y") == (["x"], ["kind"])
    model = M.train_regressor(df, ["x"], "y", categorical=["kind"])
    new = spark.createDataFrame([(1, "a'b", 1.0), (2, "c", 1.0), (3, None, 1.0), (4, "unseen", 1.0)], "id int, kind string, x double")
    got = {r.id: r.p for r in M.batch_predict(model, new, ["x"], ["id"], "p", ["kind"]).collect()}
    assert abs(got[1] - 10) < 1 and abs(got[2] - 50) < 1 and got[3] == got[1] and got[4] is not None


def test_low_variance_by_sketch_and_count(spark):
    from pyspark.sql import functions as F

    from roadlens.operators import ml

    n = 20_000
    df = spark.range(n).select(
        F.when(F.col("id") < 100, F.col("id")).otherwise(F.lit(7)).cast("double").alias("dominated"),  # 99.505 %: 100 others, one of them 7 itself
        F.when(F.col("id") < 102, F.col("id") + 100).otherwise(F.lit(7)).alias("just_below"), F.lit(1.5).alias("constant"),
        F.lit(None).cast("double").alias("nothing"), F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("kind"),
        F.when(F.col("id") % 400 == 0, F.lit("x")).when(F.col("id") % 2 == 0, F.lit("y")).alias("text"), F.col("id").alias("y"))
    got = {r.column: r.reason for r in ml.drop_low_variance(df, ["key"], {"nothing": "leak"}, "y").collect()}
    assert got == {"dominated": "low_variance", "constant": "constant", "nothing": "leak", "key": "metadata_or_non_model_column", "kind": "non_numeric_model_feature", "text": "low_variance"}
    assert {r.column: r.reason for r in ml.drop_low_variance(df.limit(0).select("just_below", "y"), [], {}, "y").collect()} == {"just_below": "all_null"}


def _series(spark, n=400):
    """Speed follows its lag, by city; the future columns are known for the early rows only."""
    return spark.sql(f"""
      SELECT CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS city, concat('s', id % 4) AS segment_id,
        timestamp_ntz '2024-01-01' + make_dt_interval(0, id div 4) AS time_bucket, CASE WHEN id = 5 THEN double('NaN') WHEN id = 9 THEN double('Infinity') ELSE double(id % 7) END AS x,
        CASE WHEN id = 7 THEN NULL ELSE int(id % 5) END AS k, int(id % 10 <> 3) AS full_history,
        CASE WHEN id < {n} - 8 THEN 10D * (id % 7) + (id % 2) END AS future_speed_15m, CASE WHEN id < {n} - 16 THEN 5D * (id % 5) END AS future_speed_60m
      FROM range({n})""")


def test_training_dataset_splits_by_time_and_fills(spark):
    from pyspark.sql import functions as F

    rows = M.training_dataset(_series(spark), 15, "full_history").collect()
    assert len(rows) == sum(i % 10 != 3 for i in range(392)) and all(r.target_speed == r.future_speed_15m for r in rows)
    of = {s: [r.time_bucket for r in rows if r.split == s] for s in ("train", "validation", "test")}
    assert max(of["train"]) < min(of["validation"]) <= max(of["validation"]) < min(of["test"])
    assert abs(len(of["train"]) / len(rows) - 0.7) < 0.02 and abs(len(of["test"]) / len(rows) - 0.15) < 0.02
    assert all(r.x is not None and abs(r.x) < 10 and r.k is not None for r in rows)
    one = M.training_dataset(_series(spark), 60, "full_history", "a")
    assert {r.city for r in one.select("city").distinct().collect()} == {"a"}
    none = M.training_dataset(_series(spark).filter(F.lit(False)), 15, "full_history")
    assert none.count() == 0 and {"target_speed", "split"} <= set(none.columns)


def test_one_model_per_horizon_scored_on_later_rows(spark):
    series = _series(spark).cache()
    data = {f"{h}m": M.training_dataset(series, h, "full_history").cache() for h in (15, 60)}
    data["none"] = data["15m"].filter("split = 'test'")
    leaks = {c: "later" for c in series.columns if c.startswith("future_")}
    models = M.train_horizons(data, ["segment_id", "time_bucket"], leaks, kind="rf")
    assert set(models) == {"15m", "60m"}
    assert all(set(numeric) <= {"x", "k", "full_history"} and categorical == ["city"] for _, numeric, categorical in models.values())
    got = M.predict_horizons(models, series, ["city", "segment_id", "time_bucket"])
    assert got.columns == ["city", "segment_id", "time_bucket", "predicted_speed_15m", "predicted_speed_60m"]
    assert got.count() == 400 and got.filter("predicted_speed_15m IS NULL OR predicted_speed_60m IS NULL").count() == 0
    metrics = {r.horizon: r for r in M.held_out_metrics(models, data).collect()}
    for name in models:
        assert metrics[name].n == data[name].filter("split = 'test'").count() and metrics[name].r2 > 0.8
