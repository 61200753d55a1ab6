"""Loading checks, JSON records, and a small forecaster fit."""

import math

import pytest

from framewise.sources.io import DataValidationError, json_records, load_dataset, require_columns


def test_require_columns_names_missing(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(DataValidationError, match=r"dataset t: no column z among x, y"):
        require_columns(df, ["x", "z"], "t")


def test_load_dataset_filters_both_ends(spark, small_dir):
    df = load_dataset(spark, f"{small_dir}/lineitem.parquet", "lineitem", ["l_shipdate"],
                      date_col="l_shipdate", start="1995-01-01", end="1995-01-31")
    r = df.selectExpr("min(CAST(l_shipdate AS DATE)) lo", "max(CAST(l_shipdate AS DATE)) hi").first()
    assert str(r.lo) >= "1995-01-01" and str(r.hi) <= "1995-01-31"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan


def test_json_records_nan_to_null(spark):
    df = spark.createDataFrame([(1, float("nan"), math.inf, None)], "a int, b double, c double, d date")
    assert json_records(df).first()[0] == '{"a":1,"b":null,"c":null,"d":null}'


def test_small_forecaster_fit(spark, small_dir):
    from framewise.operators import features as FT
    from framewise.operators import model as M
    from framewise.sources.adapters import adapters
    a = adapters(spark, small_dir)
    feats = FT.feature_matrix(a.sales_lines, a.products, a.social_signals, a.inventory)
    fc, pred = M.fit_and_test(feats, max_iter=3, max_depth=4)
    assert fc.n_trees == M.best_round(fc.losses) and len(fc.losses) == 3
    m = M.forecast_metrics(pred).first()
    assert m["test_rows"] > 0 and m["rmse"] >= 0
    assert len(fc.importances) == len(FT.FEATURE_COLUMNS)
    f = M.forecast(fc, feats, 14)
    assert f.count() == 2 * feats.select("sku_id").distinct().count()
    assert f.where("lower_bound < 0 OR upper_bound < forecasted_demand").count() == 0


def test_write_outputs_csv_and_parquet(spark, tmp_path):
    from framewise.sources.io import write_outputs
    df = spark.createDataFrame([("A", ["x", "y"]), ("B", [])], "sku_id string, drivers array<string>")
    write_outputs(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    write_outputs(df, str(tmp_path / "c"), "csv")
    back = {r.sku_id: r.drivers for r in spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()}
    assert back == {"A": '["x","y"]', "B": "[]"}


def test_forecaster_save_load(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from framewise.operators.model import Forecaster
    df = spark.createDataFrame([(float(i), float(i % 3), float(i)) for i in range(40)], "a double, b double, label double")
    pm = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                          GBTRegressor(maxIter=2, maxDepth=2)]).fit(df)
    from framewise.operators.features import CategoryEncoder
    codes = CategoryEncoder.fit(spark.createDataFrame([("x",), (None,)], "c string"), ["c"])
    fc = Forecaster(pm, ["a", "b"], 2.5, [0.5, 0.4], codes)
    fc.save(str(tmp_path / "m"))
    again = Forecaster.load(str(tmp_path / "m"))
    assert again.losses == [0.5, 0.4] and again.encoder.columns == ("c",)
    assert [tuple(r) for r in again.loss_path(spark).collect()] == [(1, math.sqrt(0.5), True), (2, math.sqrt(0.4), True)]
    assert (again.feature_cols, again.test_rmse, again.n_trees) == (["a", "b"], 2.5, 2)
    p1 = [r.predicted for r in fc.predict(df).orderBy("a").collect()]
    p2 = [r.predicted for r in again.predict(df).orderBy("a").collect()]
    assert p1 == p2


def test_duplicates_tell_nulls_apart(spark):
    from framewise.sources.io import data_quality_summary
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None), ("", None)], "x string, y string")
    r = data_quality_summary({"d": df}).first()
    assert (r["row_count"], r["duplicate_count"]) == (5, 1)


def test_missing_columns_are_named(spark, tmp_path):
    import pytest
    from framewise.sources.io import DataValidationError, load_named
    path = str(tmp_path / "returns.csv")
    spark.createDataFrame([("r1", "S1")], "return_id string, sku_id string").write.option("header", "true").csv(path)
    with pytest.raises(DataValidationError, match="no column return_date, return_reason among return_id, sku_id"):
        load_named(spark, "returns", path)


def test_date_range_reaches_the_scan(spark, small_dir):
    from framewise.operators.signals import sales_velocity
    from framewise.sources.adapters import adapters
    plan = sales_velocity(adapters(spark, small_dir).sales_lines)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def _signal(spark, n, seed):
    """A noisy step: boosting gains for many rounds, then only fits noise."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    r = np.random.default_rng(seed)
    x = r.uniform(0, 10, (n, 2))
    y = np.floor(x[:, 0]) + r.normal(0, 1.0, n)
    return spark.createDataFrame([(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y)]).toDF("features", "label").cache()


def test_early_stopping_waits_and_keeps_the_best_round(spark):
    from pyspark.ml.regression import GBTRegressor
    from framewise.operators.model import best_round, boost
    fit, validation = _signal(spark, 400, 1), _signal(spark, 200, 2)
    args = dict(stepSize=0.1, maxDepth=3, seed=5, subsamplingRate=0.75)
    model, losses = boost(fit, validation, max_iter=40, patience=8, **args)
    best = best_round(losses)
    assert model.getNumTrees == best and min(losses) == losses[best - 1]
    assert len(losses) == 40 or len(losses) - best >= 8
    assert best > 3 and losses[best - 1] < losses[0]
    # the path of a longer fit starts as that of a shorter one, so stages agree
    longer = GBTRegressor(featuresCol="features", labelCol="label", maxIter=len(losses), **args).fit(fit)
    assert list(longer.evaluateEachIteration(validation, "squared"))[:5] == pytest.approx(losses[:5])
    assert model.evaluateEachIteration(validation, "squared")[-1] == pytest.approx(min(losses))


def test_best_round():
    from framewise.operators.model import best_round
    assert best_round([3.0, 1.0, 2.0, 1.0]) == 2 and best_round([]) == 0 and best_round([float("nan"), 2.0]) == 2


def test_boost_without_validation_rows(spark):
    from framewise.operators.model import boost
    fit = _signal(spark, 60, 1)
    model, losses = boost(fit, fit.limit(0), max_iter=2, patience=40, maxDepth=2, seed=1)
    assert model.getNumTrees == 2 and losses == []


def test_encoder_codes_and_unseen_labels(spark, tmp_path):
    from framewise.operators.features import CategoryEncoder
    first = spark.createDataFrame([("a", "z"), ("b", None), ("a", "y")], "c string, d string")
    enc = CategoryEncoder.fit(first, ["c", "d"])
    enc.save(str(tmp_path / "codes"))
    again = CategoryEncoder.load(spark, str(tmp_path / "codes"))
    other = spark.createDataFrame([(1, "b", "y"), (2, "new", None), (3, None, "z")], "id int, c string, d string")
    for e in (enc, again):
        assert sorted(map(tuple, e.transform(other).select("id", "c_enc", "d_enc").collect())) == [(1, 1, 1), (2, -1, 0), (3, -1, 2)]


def test_predictions_are_computed_once(spark):
    import datetime as dt
    from framewise.operators import model as M
    rows = [(f"S{s}", dt.date(2023, 1, 2) + dt.timedelta(days=7 * w), (s + w) % 7, float(w % 5)) for s in range(12) for w in range(60)]
    feats = spark.createDataFrame(rows, "sku_id string, date date, demand bigint, f double")
    fc, pred = M.fit_and_test(feats, feature_cols=["f"], max_iter=2, max_depth=2)
    plan = pred._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "UDF" not in plan
    _, test = M.time_split(feats)
    want = fc.predict(test).select("sku_id", "date", "demand", "predicted")
    assert sorted(map(tuple, pred.collect())) == sorted(map(tuple, want.collect())) and pred.count() > 0


def test_future_rows_aggregate_the_last_weeks_alone(spark, small_dir):
    import datetime as dt
    from pyspark.sql import functions as F
    from framewise.operators import features as FT
    from framewise.operators import model as M
    from framewise.sources.adapters import adapters
    a = adapters(spark, small_dir)
    feats = FT.feature_matrix(a.sales_lines, a.products, a.social_signals, a.inventory).where("sku_id <= 'SKU000000000012'")
    hi = feats.agg(F.max("date")).first()[0]
    # SKUs that end at different weeks, rows without a SKU, a SKU without any date
    ends = F.when(F.col("sku_id").endswith("3"), hi - dt.timedelta(days=70)).otherwise(hi)
    feats = feats.where(F.col("date") <= ends).withColumn("sku_id", F.when(~F.col("sku_id").endswith("5"), F.col("sku_id")))
    feats = feats.withColumn("date", F.when(~F.col("sku_id").endswith("7") | F.col("sku_id").isNull(), F.col("date"))).localCheckpoint()
    future = M.future_rows(feats, 14)
    got = {(r["sku_id"], r["date"]): r for r in future.collect()}
    weeks = [hi + dt.timedelta(days=7), hi + dt.timedelta(days=14)]
    skus = {r["sku_id"] for r in feats.select("sku_id").distinct().collect()}
    assert set(got) == {(s, w) for s in skus for w in weeks} and None in skus and len(skus) > 5
    last = {}
    for r in feats.collect():
        if r["sku_id"] not in last or (r["date"] is not None and r["date"] > last[r["sku_id"]]["date"]):
            last[r["sku_id"]] = r
    for (s, w), r in got.items():
        for c in ("demand", "lag_1w", "lag_52w", "rolling_mean_13w", "ewm_4w", "sku_mean_demand", "days_of_supply"):
            assert r[c] == (None if last[s]["date"] is None else last[s][c]), (s, w, c)
    # the filter on the weeks lies below the aggregate of whole rows
    plan = future._jdf.queryExecution().optimizedPlan().toString()
    assert f">= {hi - dt.timedelta(days=70)}" in plan


MODEL_QUERIES = ["evaluate_test", "feature_importance_top20", "forecast", "forecast_lookup", "forecast_metrics", "test_predictions",
                 "training_loss_path"]


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_model_queries_fit_with_the_settings_of_the_library(spark, small_dir, monkeypatch, name):
    import datetime as dt
    from pyspark.sql import functions as F
    from framewise.operators import features as FT
    from framewise.operators import model as M
    from framewise.plans import REGISTRY, q_model
    from framewise.sources.adapters import adapters
    rows = [(f"S{s}", dt.date(2023, 1, 2) + dt.timedelta(days=7 * w), (s + w) % 7) for s in range(12) for w in range(60)]
    feats = spark.createDataFrame(rows, "sku_id string, date date, demand bigint").select(
        "*", *[F.col("demand").cast("double").alias(c) for c in FT.FEATURE_COLUMNS])
    seen = []
    monkeypatch.setattr(q_model, "_FITS", {})
    monkeypatch.setattr(FT, "feature_matrix", lambda *_, **__: feats)
    monkeypatch.setattr(M, "boost", lambda fit, validation, max_iter, patience, **params: seen.append((max_iter, patience, params)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        REGISTRY[name].build(adapters(spark, small_dir))
    max_iter, patience, params = seen[0]
    assert (max_iter, patience) == (800, 40)
    assert {k: params[k] for k in ("stepSize", "maxDepth", "minInstancesPerNode", "subsamplingRate", "featureSubsetStrategy", "seed")} == dict(
        stepSize=0.03, maxDepth=8, minInstancesPerNode=5, subsamplingRate=0.75, featureSubsetStrategy="0.7", seed=42)
