"""Model data and evaluation: splits, baselines, metrics, attribution, coverage and
pyspark.ml training. Metrics are single aggregates; per-slice/per-fold metrics are one
grouped aggregate over an unpivoted or fold-expanded frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import epoch_micros
from .selection import exact_modes, exact_percentiles


def _metric_aggs(y: Column, p: Column) -> list[Column]:
    err = y - p
    nz = F.abs(y) > 1e-9
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(nz, F.abs(err / y))) * 100.0).alias("mape"),
        F.when(F.count(F.lit(1)) > 1, F.lit(1.0) - F.sum(err * err) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    ]


def regression_metrics(df: DataFrame, y: str, yhat: str, group: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE over non-zero truth, R^2 (null if n < 2), optionally per group."""
    d = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    aggs = _metric_aggs(F.col(y), F.col(yhat))
    return d.groupBy(*group).agg(*aggs) if group else d.agg(*aggs)


def error_percentiles(df: DataFrame, y: str, yhat: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles (interpolated) and maximum of the absolute error, by distributed selection: no group is sorted or gathered."""
    e = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull()).select(*group, F.abs(F.col(y) - F.col(yhat)).alias("_ae"))
    names = ["p50_abs_error", "p90_abs_error", "p95_abs_error", "max_abs_error"]
    return exact_percentiles(e, "_ae", (0.5, 0.9, 0.95, 1.0), group).select(*group, *[F.col(f"p{i}").alias(n) for i, n in enumerate(names)])


def sliced_metrics(df: DataFrame, y: str, yhat: str, slices: Sequence[str]) -> DataFrame:
    """Metrics per (slice column, slice value): the slice columns are unpivoted, then one groupBy."""
    base = df.select(F.col(y).alias("_y"), F.col(yhat).alias("_p"), *[F.col(s).cast("string").alias(s) for s in slices])
    long = base.unpivot(["_y", "_p"], list(slices), "slice", "slice_value")
    return regression_metrics(long, "_y", "_p", ["slice", "slice_value"])


def split_by_time_quantile(df: DataFrame, ts: str = "time_bucket", train_q: float = 0.7, valid_q: float = 0.85) -> DataFrame:
    """<= q.70 train, <= q.85 validation, else test; quantiles of time, linearly interpolated."""
    e = epoch_micros(ts)
    q = exact_percentiles(df.select(e.alias("_e")), "_e", (train_q, valid_q)).first()
    upto = lambda v: e <= F.lit(v).cast("double")
    return df.withColumn("split", F.when(upto(q.p0), "train").when(upto(q.p1), "validation").otherwise("test"))


def split_by_order(df: DataFrame, ts: str = "time_bucket", validation_fraction: float = 0.2) -> DataFrame:
    """First (1 - f) of the rows in time order are train. Whole time buckets are assigned: the
    cumulative row count per distinct time (a small table) decides, so no global row sort."""
    per = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = df.select(F.count(F.lit(1))).scalar()
    cut = F.greatest(F.lit(1), F.floor(total * F.lit(1.0 - validation_fraction)))
    per = per.withColumn("_cum", F.sum("_n").over(w)).withColumn("split", F.when(F.col("_cum") <= cut, "train").otherwise("validation"))
    return df.join(per.select(ts, "split"), ts, "left")


def baseline_predictors(df: DataFrame, y: str, train_filter: Column) -> DataFrame:
    """Per-row predictions of the reference baselines: train mean/median, current speed,
    historical p50, lag 1, rolling means of 3 and 6 lags."""
    train = df.filter(train_filter)
    m = train.select(F.avg(y)).scalar()
    md = F.lit(exact_percentiles(train, y, (0.5,)).first().p0).cast("double")
    return df.withColumns({
        "pred_train_mean": m, "pred_train_median": md, "pred_current_speed": F.col("currentSpeed"),
        "pred_historical_p50": F.col("p50"), "pred_lag_1": F.col("speed_lag_1"),
        "pred_rolling_mean_3": F.col("speed_rolling_avg_15m"), "pred_rolling_mean_6": F.col("speed_rolling_avg_30m"),
    })


def walk_forward(df: DataFrame, folds: Sequence[tuple[str, str]], y: str, ts: str = "time_bucket") -> DataFrame:
    """Expanding-window folds (train_end, val_end): the train-mean baseline of each fold scored
    on (train_end, val_end]. Rows are expanded to their folds with ``explode`` of the fold list."""
    arr = F.array(*[F.struct(F.lit(i + 1).alias("fold"), F.lit(a).cast("timestamp_ntz").alias("train_end"),
                             F.lit(b).cast("timestamp_ntz").alias("val_end")) for i, (a, b) in enumerate(folds)])
    x = df.select(F.col(ts).alias("_t"), F.col(y).alias("_y")).filter(F.col("_y").isNotNull()).withColumn("f", F.explode(arr)).select("_t", "_y", "f.*")
    means = x.filter(F.col("_t") <= F.col("train_end")).groupBy("fold").agg(F.avg("_y").alias("_m"), F.count(F.lit(1)).alias("train_rows"))
    val = x.filter((F.col("_t") > F.col("train_end")) & (F.col("_t") <= F.col("val_end"))).join(means, "fold")
    return regression_metrics(val, "_y", "_m", ["fold", "train_rows"])


def feature_reference_values(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Median of numeric features (interpolated), most frequent value of text features (lowest on ties); null for a
    feature without values.  Medians by distributed selection over all features at once, modes by combining counts."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], list(numeric), "feature", "_v")
    found = exact_percentiles(long, "_v", (0.5,), ["feature"]).select("feature", F.col("p0").cast("string").alias("reference_value"))
    if text:
        found = found.unionByName(exact_modes(df, text).select(F.col("column").alias("feature"), F.col("value").alias("reference_value")))
    names = df.sparkSession.createDataFrame([(c,) for c in [*numeric, *text]], "feature string")
    return names.join(found, "feature", "left")


def perturbation_attribution(df: DataFrame, id_col: str, weights: dict[str, float], intercept: float, reference: dict[str, float],
                             top_n: int = 5) -> DataFrame:
    """Replace one feature at a time by its reference value and score with a linear model:
    contribution = prediction - prediction(perturbed); |c| < .001 dropped; top-n by |c|."""
    feats = [f for f in weights if f in reference]
    pred = sum((F.lit(w) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f, w in weights.items()), F.lit(intercept))
    x = df.select(F.col(id_col), pred.alias("prediction"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value"),
                 F.lit(float(reference[f])).alias("baseline_value"), F.lit(float(weights[f])).alias("w")) for f in feats])).alias("c"))
    x = x.select(id_col, "prediction", "c.*").withColumn("contribution", F.col("w") * (F.col("value") - F.col("baseline_value")))
    x = x.filter(F.abs("contribution") >= 0.001)
    w = Window.partitionBy(id_col).orderBy(F.abs("contribution").desc(), F.col("feature"))
    x = x.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top_n)
    return x.withColumn("direction", F.when(F.col("contribution") > 0, "raises_speed").otherwise("lowers_speed")).drop("w")


def feature_coverage(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("city", "segment_id")) -> DataFrame:
    """Required/available features per row, then per segment: average coverage and level."""
    avail = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    x = df.withColumn("_cov", avail / F.lit(float(len(features))))
    g = x.groupBy(*keys).agg(F.lit(len(features)).alias("required_feature_count"), F.avg(avail).alias("avg_available"),
                             F.avg("_cov").alias("avg_coverage"))
    return g.withColumn("coverage_level", F.when(F.col("avg_coverage") >= 0.9, "high").when(F.col("avg_coverage") >= 0.7, "medium").otherwise("low"))


def drop_low_variance(df: DataFrame, protected: Sequence[str], leakage: dict[str, str], target: str, dominance: float = 0.995) -> DataFrame:
    """(column, reason) for columns a model must not use: leakage-prone, metadata, all-null,
    constant, dominated by one value (>= 99.5 % of non-null rows), non-numeric.

    Two combining aggregates, and no cell is shuffled: the first finds per column the count, the least and the greatest value, and the
    one value that can dominate.  (Of the hashes of the values in order, a value of more than 51 % of the rows holds the middle
    by more than the sketch's bounded error, so the approximate median of the hashes is that value's for certain.)  The second
    counts that value.  One row per column reaches the driver."""
    if dominance <= 0.51:
        raise ValueError("dominance must be above 0.51")
    spark = df.sparkSession
    cand = [c for c in df.columns if c != target and c not in leakage and c not in protected]
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")}
    value = {c: F.col(f"`{c}`").cast("string") for c in cand}
    # 52 bits: the sketch works in doubles
    hashed = {c: F.when(v.isNotNull(), F.xxhash64(v).bitwiseAND(F.lit((1 << 52) - 1))) for c, v in value.items()}
    rows = [(c, r) for c, r in leakage.items() if c in df.columns and c != target]
    rows += [(c, "metadata_or_non_model_column") for c in protected if c in df.columns and c != target]
    if cand:
        first = df.agg(*[x for i, c in enumerate(cand) for x in (
            F.count(value[c]).alias(f"n{i}"), F.min(value[c]).alias(f"lo{i}"), F.max(value[c]).alias(f"hi{i}"),
            F.percentile_approx(hashed[c], 0.5, 1000).alias(f"h{i}"))]).first()
        counts = [F.count(F.when(hashed[c] == F.lit(first[f"h{i}"]), 1)).alias(f"k{i}") for i, c in enumerate(cand) if first[f"n{i}"]]
        top = df.agg(*counts).first().asDict() if counts else {}
        for i, c in enumerate(cand):
            if not first[f"n{i}"]:
                rows.append((c, "all_null"))
            elif first[f"lo{i}"] == first[f"hi{i}"]:
                rows.append((c, "constant"))
            elif top[f"k{i}"] / first[f"n{i}"] >= dominance:
                rows.append((c, "low_variance"))
            elif c not in numeric:
                rows.append((c, "non_numeric_model_feature"))
    return spark.createDataFrame(rows, "column string, reason string")


def model_features(df: DataFrame, protected: Sequence[str], leakage: dict[str, str], target: str) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns that ``drop_low_variance`` keeps; text columns that it names only
    for not being numeric are the categorical ones."""
    reasons = {r["column"]: r["reason"] for r in drop_low_variance(df, protected, leakage, target).collect()}
    open_ = {c: t for c, t in df.dtypes if c != target and reasons.get(c, "non_numeric_model_feature") == "non_numeric_model_feature"}
    return [c for c in open_ if c not in reasons], [c for c, t in open_.items() if c in reasons and t == "string"]


def _model_columns(features: Sequence[str], categorical: Sequence[str]) -> list[Column]:
    number = {c: F.col(c).cast("double") for c in features}
    number = {c: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for c, x in number.items()}
    return [x.alias(f"_f_{c}") for c, x in number.items()] + [F.col(c).cast("string").alias(f"_c_{c}") for c in categorical]


def train_regressor(train: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", seed: int = 42, categorical: Sequence[str] = ()):
    """pyspark.ml pipeline: median imputation of numbers, most frequent value (lowest on ties) and one-hot for
    categorical columns (unseen values get no column), vector assembly, gradient-boosted trees (or a random
    forest / linear model). Returns the fitted PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    data = train.select(*_model_columns(features, categorical), F.col(label).cast("double").alias(label)).filter(F.col(label).isNotNull())
    casted = [f"_f_{c}" for c in features]
    stages = [Imputer(inputCols=casted, outputCols=[f"{c}_i" for c in casted], strategy="median")]
    texts = [f"_c_{c}" for c in categorical]
    if texts:
        modes = data.agg(*[F.mode(F.col(f"`{c}`"), True).alias(c) for c in texts]).first().asDict()
        quoted = {c: "'" + (m or "").replace("\\", "\\\\").replace("'", "\\'") + "'" for c, m in modes.items()}
        stages += [SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(`{c}`, {quoted[c]}) AS `{c}_m`" for c in texts) + " FROM __THIS__"),
                   StringIndexer(inputCols=[f"{c}_m" for c in texts], outputCols=[f"{c}_n" for c in texts], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}_n" for c in texts], outputCols=[f"{c}_h" for c in texts])]
    stages.append(VectorAssembler(inputCols=[f"{c}_i" for c in casted] + [f"{c}_h" for c in texts], outputCol="features", handleInvalid="keep"))
    if kind == "gbt":
        stages.append(GBTRegressor(featuresCol="features", labelCol=label, maxIter=30, maxDepth=5, seed=seed))
    elif kind == "rf":
        stages.append(RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=50, seed=seed))
    else:
        stages.append(LinearRegression(featuresCol="features", labelCol=label))
    return Pipeline(stages=stages).fit(data)


def batch_predict(model, rows: DataFrame, features: Sequence[str], keep: Sequence[str], out: str = "predicted_speed", categorical: Sequence[str] = ()) -> DataFrame:
    data = rows.select(*keep, *_model_columns(features, categorical))
    return model.transform(data).select(*keep, F.col("prediction").alias(out))


def training_dataset(features: DataFrame, horizon: int, history: str, city: str | None = None) -> DataFrame:
    """Rows of one horizon to learn from: those with an exact target and a whole short history (``history`` = 1), of one city or of all.
    + ``target_speed`` and ``split`` (train, validation, test by time, in that order); infinities, NaN and nulls of number columns
    become 0, save the targets'.  No row qualifies: an empty frame with these columns."""
    target = f"future_speed_{horizon}m"
    rows = features.filter(F.col(target).isNotNull() & (F.col(history) == 1))
    if city is not None:
        rows = rows.filter(F.col("city") == city)
    rows = rows.withColumn("target_speed", F.col(target).cast("double"))
    real = [c for c, t in rows.dtypes if t in ("double", "float") and c != "target_speed" and not c.startswith("future_speed_")]
    whole = [c for c, t in rows.dtypes if t in ("int", "bigint", "smallint", "tinyint")]
    finite = {c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c)).otherwise(F.lit(0).cast("double")) for c in real}
    rows = rows.withColumns({**finite, **{c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in rows.dtypes if c in whole}})
    return rows.withColumn("split", F.lit("test")) if rows.isEmpty() else split_by_time_quantile(rows)


def train_horizons(datasets: dict[str, DataFrame], protected: Sequence[str], leakage: dict[str, str], kind: str = "gbt", seed: int = 42) -> dict[str, tuple]:
    """{name: (model, numeric, categorical)}: one model per horizon, fitted on the rows of split ``train`` by the columns that
    ``drop_low_variance`` keeps there.  Horizons without such rows or columns are left out.  Datasets should be stored tables: a fit reads its
    rows several times."""
    models = {}
    for name, rows in datasets.items():
        train = rows.filter("split = 'train'").drop("split")
        numeric, categorical = model_features(train, protected, leakage, "target_speed")
        if numeric and not train.isEmpty():
            models[name] = (train_regressor(train, numeric, "target_speed", kind, seed, categorical), numeric, categorical)
    return models


def predict_horizons(models: dict[str, tuple], rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` + ``predicted_speed_<name>`` for every horizon, all in one pass over the rows."""
    used = list(dict.fromkeys([*keep, *[c for _, numeric, categorical in models.values() for c in (*numeric, *categorical)]]))
    rows, made = rows.select(*used), []
    for name, (model, numeric, categorical) in models.items():
        out = f"predicted_speed_{name}"
        rows = batch_predict(model, rows, numeric, [*used, *made], out, categorical)
        made.append(out)
    return rows.select(*keep, *made)


def held_out_metrics(models: dict[str, tuple], datasets: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Metrics per horizon (and ``by``) on the rows of split ``test``, which are later than all that the models saw."""
    scored = None
    for name, (model, numeric, categorical) in models.items():
        one = batch_predict(model, datasets[name].filter("split = 'test'"), numeric, [*by, "target_speed"], "prediction", categorical)
        one = one.withColumn("horizon", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    if scored is None:
        raise ValueError("no horizon has rows to learn from")
    return regression_metrics(scored, "target_speed", "prediction", ["horizon", *by])
