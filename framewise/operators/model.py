"""Demand forecast model and evaluation.

Boosted trees on ``log1p(demand)`` with Spark ML's ``GBTRegressor`` over
the weekly feature matrix.  The modelled library uses XGBoost; the
parameters map where Spark has an equivalent (no gamma / L1 / L2), so the
model is approximate, not equal.  Training is distributed by Spark ML.

Early stopping with patience is staged: Spark's own rule stops at the first
round without gain, so the trees are fitted without it, the loss of every round
is measured on the validation rows, and more rounds are fitted only while the
best one is less than ``patience`` rounds old.  The same seed grows the same
trees, so the loss of earlier rounds stays as it was, and the model kept is the
one that ends at the best round.

The training rows are staged once in the shared folder: the boosting reads
them three times and leaves the memory to its own binned rows, a lost executor
costs a reread of its files, and a row's place never changes between passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.expr import round_half_even
from framewise.functions.ranks import global_row_number
from framewise.operators import features as FT
from framewise.operators.features import CategoryEncoder
from framewise.session import stage

# The modelled forecaster's settings.
FORECAST_PARAMS = dict(max_iter=800, step_size=0.03, max_depth=8, min_instances=5, subsample=0.75,
                       colsample=0.7, seed=42, patience=40)
EARLY_STOP_VALIDATION_MIN_ROWS = 200
EARLY_STOP_VALIDATION_SHARE = 0.10
TEST_MONTHS = 3
INTERVAL_Z = 1.28


def time_split(feats: DataFrame, months: int = TEST_MONTHS, last: date | None = None) -> tuple[DataFrame, DataFrame]:
    """cutoff = last week - ``months`` calendar months; train ``<=``, test
    ``>`` (A22).  The last week is one scalar over the frame, unless known."""
    last = last or feats.select(F.max("date")).first()[0]
    cutoff = F.add_months(F.lit(last).cast("date"), -months)
    return feats.where(F.col("date") <= cutoff), feats.where(F.col("date") > cutoff)


def split_summary(feats: DataFrame, months: int = TEST_MONTHS) -> DataFrame:
    """Rows and date range of each side of :func:`time_split`."""
    cut = feats.agg(F.add_months(F.max("date"), -months).alias("_cut"))
    return (feats.crossJoin(F.broadcast(cut))
                 .withColumn("split", F.when(F.col("date") <= F.col("_cut"), "train").otherwise("test"))
                 .groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_week"),
                                       F.max("date").alias("last_week"), F.countDistinct("sku_id").alias("skus")))


def _with_validation_flag(train: DataFrame) -> DataFrame:
    """Flag the early-stopping rows: the last ``max(200, 10 %)`` rows in
    (sku_id, date) order, as the modelled trainer slices its row array.

    The grid is dense, so every SKU has the same W training weeks: the last
    k rows are the last k // W SKUs whole plus the last k % W weeks of the
    SKU before them.  SKUs are ranked from the end with a distributed row
    number (one row per SKU), not by numbering every row in one task."""
    b = train.agg(F.countDistinct("date").alias("w"), F.countDistinct("sku_id").alias("s"),
                  F.min("date").alias("lo")).first()
    w, s, lo = int(b["w"]), int(b["s"]), b["lo"]
    if w == 0:
        return train.withColumn("is_val", F.lit(False))
    k = max(EARLY_STOP_VALIDATION_MIN_ROWS, int(w * s * EARLY_STOP_VALIDATION_SHARE))
    whole, part = k // w, k % w
    ranks = global_row_number(train.select("sku_id").distinct(), ["-sku_id"], "_r")
    week = (F.datediff(F.col("date"), F.lit(lo)) / 7).cast("int")
    flag = (F.col("_r") <= whole) | ((F.col("_r") == whole + 1) & (week >= w - part))
    return train.join(ranks, "sku_id", "left").withColumn("is_val", flag).drop("_r")


@dataclass
class Forecaster:
    model: PipelineModel
    feature_cols: list[str]
    test_rmse: float | None = None
    losses: list[float] = field(default_factory=list)       # validation loss after each round
    encoder: CategoryEncoder | None = None

    @property
    def importances(self) -> list[tuple[str, float]]:
        imp = self.model.stages[-1].featureImportances.toArray().tolist()
        return sorted(zip(self.feature_cols, imp), key=lambda t: (-t[1], t[0]))

    def predict(self, feats: DataFrame) -> DataFrame:
        """``expm1`` of the prediction, floored at 0."""
        out = self.model.transform(feats)
        return out.withColumn("predicted", F.greatest(F.expm1("prediction"), F.lit(0.0))).drop(
            "features", "prediction")

    @property
    def n_trees(self) -> int:
        return self.model.stages[-1].getNumTrees

    def loss_path(self, spark: SparkSession) -> DataFrame:
        """Validation RMSE (of log demand) after each round that was fitted,
        and the rounds that the model keeps."""
        rows = [(i + 1, math.sqrt(x), i < self.n_trees) for i, x in enumerate(self.losses)]
        return spark.createDataFrame(rows, "round int, validation_rmse double, kept boolean")

    def save(self, path: str) -> None:
        """Persist the fitted pipeline with its columns, test RMSE, losses and
        category codes (A06)."""
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.feature_cols, self.test_rmse, self.losses, self.encoder is not None)], STATE) \
            .write.mode("overwrite").json(f"{path}/state")
        if self.encoder is not None:
            self.encoder.save(f"{path}/codes")

    @classmethod
    def load(cls, path: str) -> "Forecaster":
        spark = SparkSession.getActiveSession()
        state = spark.read.schema(STATE).json(f"{path}/state").first()
        encoder = CategoryEncoder.load(spark, f"{path}/codes") if state["coded"] else None
        return cls(PipelineModel.load(f"{path}/model"), list(state["feature_cols"]), state["test_rmse"], list(state["losses"] or []), encoder)


STATE = "feature_cols array<string>, test_rmse double, losses array<double>, coded boolean"


def best_round(losses: list[float]) -> int:
    """The first round with the least loss, from 1 (0: no loss is a number)."""
    known = [(x, i + 1) for i, x in enumerate(losses) if not math.isnan(x)]
    return min(known)[1] if known else 0


def boost(fit: DataFrame, validation: DataFrame, max_iter: int, patience: int, **params) -> tuple[GBTRegressionModel, list[float]]:
    """Boosted trees on ``features`` / ``label`` that end at the round with the
    least validation loss, once ``patience`` more rounds have not lowered it
    (or ``max_iter`` is reached).  Rounds double from stage to stage, so all
    stages together cost at most twice the last one."""
    gbt = GBTRegressor(featuresCol="features", labelCol="label", **params)
    rounds = min(max_iter, patience + max(patience // 4, 1))
    if validation.isEmpty():
        return gbt.setMaxIter(max_iter).fit(fit), []
    while True:
        model = gbt.setMaxIter(rounds).fit(fit)
        losses = [float(x) for x in model.evaluateEachIteration(validation, "squared")]
        best = best_round(losses)
        if rounds >= max_iter or rounds - best >= patience:
            break
        rounds = min(max_iter, 2 * rounds)
    return (model if best in (0, rounds) else first_trees(model, best)), losses


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model that ends after ``n`` trees.  Spark has no public way to cut a
    fitted model, so its JVM constructor is called with fewer trees."""
    java, gateway = model._java_obj, SparkSession.getActiveSession().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], float(java.treeWeights()[i])
    cut = GBTRegressionModel(gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures()))
    cut.setFeaturesCol(model.getFeaturesCol())
    return cut


def train_forecaster(train: DataFrame, feature_cols: list[str] | None = None, **params) -> Forecaster:
    """Fit the boosted-tree forecaster on ``log1p(demand)`` (A23), all rows
    including zero weeks; the last rows of the training period only decide
    where the trees end (see :func:`boost`)."""
    p = {**FORECAST_PARAMS, **params}
    cols = list(feature_cols or FT.FEATURE_COLUMNS)
    assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    rows = _with_validation_flag(train).withColumn("label", F.log1p(F.col("demand").cast("double")))
    data = assembler.transform(stage(rows.select(*cols, "label", "is_val"), "training")).select("features", "label", "is_val")
    model, losses = boost(data.where(~F.col("is_val")), data.where("is_val"), p["max_iter"], p["patience"],
                          stepSize=p["step_size"], maxDepth=p["max_depth"], minInstancesPerNode=p["min_instances"],
                          subsamplingRate=p["subsample"], featureSubsetStrategy=str(p["colsample"]), seed=p["seed"],
                          checkpointInterval=10, maxBins=64, maxMemoryInMB=1024)
    return Forecaster(PipelineModel([assembler, model]), cols, losses=losses)


def evaluate(df: DataFrame, y: str = "demand", pred: str = "predicted") -> DataFrame:
    """MAPE (y != 0 rows, 0 if none), RMSE, MAE, R^2 (ss_tot = 0 -> 1 if
    ss_res = 0 else 0), bias % = mean(pred - y) / mean(y) * 100 (0 if the
    mean is 0), in one aggregation (A25)."""
    yv, pv = F.col(y).cast("double"), F.col(pred).cast("double")
    a = df.agg(
        F.avg(F.when(yv != 0, F.abs((yv - pv) / yv))).alias("_mape"),
        F.sqrt(F.avg((yv - pv) * (yv - pv))).alias("rmse"),
        F.avg(F.abs(yv - pv)).alias("mae"),
        F.sum((yv - pv) * (yv - pv)).alias("_ss_res"),
        F.count(yv).alias("_n"), F.sum(yv).alias("_sy"), F.sum(yv * yv).alias("_syy"),
        F.avg(pv - yv).alias("_bias"), F.avg(yv).alias("_my"))
    ss_tot = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("_n")
    r2 = F.when(ss_tot == 0, F.when(F.col("_ss_res") == 0, 1.0).otherwise(0.0)).otherwise(
        F.lit(1.0) - F.col("_ss_res") / ss_tot)
    bias = F.when(F.col("_my") == 0, 0.0).otherwise(round_half_even(F.col("_bias") / F.col("_my") * F.lit(100.0), 4))
    return a.select((F.coalesce("_mape", F.lit(0.0)) * 100.0).alias("mape"), "rmse", "mae",
                    r2.alias("r2"), bias.alias("bias_pct"))


def forecast_metrics(pred: DataFrame) -> DataFrame:
    """Test-period metrics of the fitted model (A24): MAPE, wMAPE and MAE on
    weeks with demand, RMSE on all weeks, R^2 in log space on all weeks."""
    y, p = F.col("demand").cast("double"), F.col("predicted")
    ly, lp = F.log1p(y), F.log1p(p)
    a = pred.agg(
        F.avg(F.when(y > 0, F.abs(y - p) / y)).alias("_mape"),
        F.sum(F.when(y > 0, F.abs(y - p))).alias("_abs"), F.sum(F.when(y > 0, y)).alias("_sy"),
        F.avg(F.when(y > 0, F.abs(y - p))).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.sum((ly - lp) * (ly - lp)).alias("_res"), F.count(ly).alias("_n"),
        F.sum(ly).alias("_sl"), F.sum(ly * ly).alias("_sll"),
        F.count(F.lit(1)).alias("test_rows"))
    ss_tot = F.col("_sll") - F.col("_sl") * F.col("_sl") / F.col("_n")
    return a.select(
        (F.col("_mape") * 100.0).alias("mape"),
        (F.col("_abs") / (F.col("_sy") + F.lit(1e-9)) * 100.0).alias("wmape"),
        "mae", "rmse", (F.lit(1.0) - F.try_divide(F.col("_res"), ss_tot)).alias("r2_log"), "test_rows")


def fit_and_test(feats: DataFrame, encoder: CategoryEncoder | None = None, **params) -> tuple[Forecaster, DataFrame]:
    """Split, fit on the training weeks, predict the test weeks (A26); the
    forecaster keeps the ``encoder`` of the features.  The predictions are
    staged: every metric would walk all trees again."""
    train, test = time_split(feats)
    fc = train_forecaster(train, **params)
    fc.encoder = encoder
    pred = stage(fc.predict(test).select("sku_id", "date", "demand", "predicted"), "predictions")
    fc.test_rmse = pred.agg(F.sqrt(F.avg((F.col("demand") - F.col("predicted")) ** 2))).first()[0]
    return fc, pred


def feature_importance(fc: Forecaster, spark, top: int = 20) -> DataFrame:
    """Top features by importance (A28); the table has one row per feature."""
    rows = fc.importances[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def future_rows(feats: DataFrame, days: int = 90) -> DataFrame:
    """Feature rows of the weeks to forecast: weeks = max(1, (days + 6) // 7)
    Mondays after the last week.

    Each SKU's last observed feature row is carried to every future week;
    calendar features, month / week priors (the SKU mean where the SKU has no
    history for that month or week) and the interactions that use them are
    recomputed; ``weeks_since_launch`` advances by one."""
    n_weeks = max(1, (days + 6) // 7)
    ends = feats.groupBy("sku_id").agg(F.max("date").alias("d")).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    hi = ends["hi"]
    # no SKU's last week lies before ``lo``, so the wide rows of earlier weeks are not aggregated
    late = feats.where(F.col("date").isNull() | (F.col("date") >= F.lit(ends["lo"]).cast("date")))
    last = late.groupBy("sku_id").agg(F.max_by(F.struct(*[c for c in feats.columns if c != "sku_id"]),
                                               F.col("date")).alias("r")).select("sku_id", "r.*")
    future = last.withColumn("date", F.explode(F.sequence(F.date_add(F.lit(hi), 7),
                                                          F.date_add(F.lit(hi), 7 * n_weeks),
                                                          F.expr("INTERVAL 7 DAYS"))))
    future = future.drop("month", "quarter", "week_of_year", "year", "month_sin", "month_cos", "woy_sin",
                         "woy_cos", "q_sin", "q_cos")
    future = FT.calendar_features(future).withColumn("weeks_since_launch", F.col("weeks_since_launch") + 1)
    mprior = feats.groupBy("sku_id", "month").agg(F.avg("demand").alias("_mp"))
    wprior = feats.groupBy("sku_id", "week_of_year").agg(F.avg("demand").alias("_wp"))
    future = (future.join(mprior, ["sku_id", "month"], "left").join(wprior, ["sku_id", "week_of_year"], "left")
                    .withColumn("sku_month_mean", F.coalesce("_mp", "sku_mean_demand"))
                    .withColumn("sku_woy_mean", F.coalesce("_wp", "sku_mean_demand"))
                    .drop("_mp", "_wp"))
    return FT.interaction_features(future)


def _forecast_rows(pred: DataFrame, test_rmse: float) -> DataFrame:
    """``sku_id``, ``date`` as ``yyyy-MM-dd``, ``forecasted_demand`` and the
    +-1.28 test RMSE bounds, the lower floored at 0, rounded to 2 dp."""
    band, p = INTERVAL_Z * test_rmse, F.col("predicted")
    return pred.select("sku_id", F.date_format("date", "yyyy-MM-dd").alias("date"),
                       round_half_even(p, 2).alias("forecasted_demand"),
                       round_half_even(F.greatest(p - F.lit(band), F.lit(0.0)), 2).alias("lower_bound"),
                       round_half_even(p + F.lit(band), 2).alias("upper_bound"))


def forecast(fc: Forecaster, feats: DataFrame, days: int = 90) -> DataFrame:
    """Future weekly demand per SKU (A27), see :func:`future_rows`."""
    pred = fc.predict(future_rows(feats, days).select("sku_id", "date", *fc.feature_cols))
    return _forecast_rows(pred, fc.test_rmse or 0.0)


def week_prior_forecast(weekly: DataFrame, days: int = 90, test_rmse: float = 0.0, last: date | None = None) -> DataFrame:
    """The same table without a model: each SKU's mean demand of the same ISO
    week (its overall mean where it has no such week).  A baseline, and a
    forecast that any engine can recompute."""
    n_weeks = max(1, (days + 6) // 7)
    hi = last or weekly.agg(F.max("date")).first()[0]       # the last week, if not known
    # sums of a week of the year give the mean of all weeks too, so the weeks are summed once
    sums = weekly.groupBy("sku_id", F.weekofyear("date").alias("_w")).agg(F.sum("demand").alias("_s"), F.count("demand").alias("_n"))
    mean = lambda s, n: F.try_divide(s.cast("double"), n.cast("double"))
    prior = F.when(F.col("_w").isNotNull() & F.col("sku_id").isNotNull(), F.struct("_w", mean(F.col("_s"), F.col("_n")).alias("_p")))
    own = sums.groupBy("sku_id").agg(mean(F.sum("_s"), F.sum("_n")).alias("_m"), F.map_from_entries(F.collect_list(prior)).alias("_priors"))
    future = own.withColumn("date", F.explode(F.sequence(F.date_add(F.lit(hi), 7), F.date_add(F.lit(hi), 7 * n_weeks),
                                                         F.expr("INTERVAL 7 DAYS"))))
    return _forecast_rows(future.withColumn("predicted", F.coalesce(F.col("_priors")[F.weekofyear("date")], "_m")), test_rmse)
