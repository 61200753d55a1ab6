"""The weekly operators on whole arrays: same values as on rows, NULL weeks
included, without a window, a sort of weekly rows or a cached frame."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import features as FT
from framewise.operators import model as M


def _sales(spark):
    rng = np.random.default_rng(5)
    start = dt.date(2023, 10, 2)
    rows = [(s, start + dt.timedelta(days=int(d)), int(rng.integers(1, 9))) for s in "ABC" for d in rng.integers(0, 460, 40)]
    rows += [("A", start + dt.timedelta(days=50), None), (None, start, 4), ("D", start + dt.timedelta(days=461), 2)]
    return spark.createDataFrame(rows, "sku_id string, date date, quantity_sold bigint")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", [FT.rolling_stats, FT.ewm_features, FT.lag_features])
def test_series_equals_rows(spark, operator):
    sales = _sales(spark)
    on_series = operator(FT.DemandSeries.of(sales))
    got, want = (sorted(map(str, df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).collect()))
                 for df in (on_series, operator(FT.weekly_demand(sales))))
    assert got == want and len(got) > 200
    assert "Window" not in _plan(on_series) and "Generate" not in _plan(on_series)


def test_slices_do_not_change_values(spark, monkeypatch):
    series = FT.DemandSeries.of(_sales(spark))
    whole = FT.Weeks(__import__("pyarrow").array([[1, 2, 3], [4, 5]]))
    assert whole.back(whole.x, 1).tolist() == [0, 1, 2, 0, 4] and whole.back(whole.x, 9).tolist() == [0] * 5
    assert whole.mean(4).tolist() == [0, 0.5, 1, 0, 2]
    assert series.frame.count() == 5


def test_holiday_weeks_of_thirty_years(spark):
    days = [dt.date(1995, 1, 2) + dt.timedelta(days=i) for i in range(0, 11000, 3)]
    df = FT.holiday_week_flag(spark.createDataFrame([(d,) for d in days], "date date"))
    got = {r["date"]: r["has_holiday_week"] for r in df.collect()}
    for d in days:
        week = [d + dt.timedelta(days=i) for i in range(7)]
        assert got[d] == int(any((x.month, x.day) in FT.HOLIDAYS for x in week)), d
    assert "sequence(" not in _plan(df) and "lambda" not in _plan(df)


def test_matrix_of_some_columns(spark, small_dir):
    from framewise.sources.adapters import adapters
    a = adapters(spark, small_dir)
    cols = ["prior_x_ewm13", "mention_lag1w"]
    tables = (a.sales_lines, a.products, a.social_signals, a.inventory)
    some, whole = FT.feature_matrix(*tables, columns=cols), FT.feature_matrix(*tables)
    assert some.columns == ["sku_id", "date", "demand", *cols]
    assert whole.select(*some.columns).exceptAll(some).count() == 0 == some.exceptAll(whole.select(*some.columns)).count()


def test_training_caches_no_frame(spark, monkeypatch):
    held = []
    monkeypatch.setattr(M, "boost", lambda fit, *_, **__: held.append((fit, spark._jsc.getPersistentRDDs().size())) or 1 / 0)
    rows = [("S%d" % s, dt.date(2024, 1, 1) + dt.timedelta(days=7 * w), s + w, float(w)) for s in range(30) for w in range(20)]
    before = spark._jsc.getPersistentRDDs().size()
    with pytest.raises(ZeroDivisionError):
        M.train_forecaster(spark.createDataFrame(rows, "sku_id string, date date, demand bigint, f double"), ["f"])
    fit, persistent = held[0]
    assert persistent == before and not fit.is_cached and "InMemoryTableScan" not in _plan(fit) and "Join" not in _plan(fit)


def test_week_prior_reads_the_weeks_once(spark):
    weekly = FT.weekly_demand(_sales(spark))
    got = M.week_prior_forecast(weekly, 90)
    assert _plan(got).count("Generate posexplode") <= 1 and "SortMergeJoin" not in _plan(got) and "BroadcastHashJoin" not in _plan(got)
    rows = weekly.where("sku_id = 'B'").toPandas()
    rows["w"] = [d.isocalendar().week for d in rows["date"]]
    means = rows.groupby("w")["demand"].mean()
    for r in got.where("sku_id = 'B'").collect():
        w = dt.date.fromisoformat(r["date"]).isocalendar().week
        assert r["forecasted_demand"] == pytest.approx(means.get(w, rows["demand"].mean()), abs=0.006)


def test_matrix_rows_are_finished_and_equal_the_row_operators(spark):
    start = dt.date(2023, 10, 2)
    sales = _sales(spark).union(spark.createDataFrame([("A", start + dt.timedelta(days=462), None), ("D", start + dt.timedelta(days=469), 1)],
                                                      "sku_id string, date date, quantity_sold bigint"))
    products = spark.createDataFrame([("A", dt.date(2023, 11, 1), "x"), ("B", None, None), ("C", dt.date(2030, 1, 1), "y")],
                                     "sku_id string, launch_date date, c string").select(
        "sku_id", "launch_date", *[F.col("c").alias(c) for c in FT.CAT_COLS])
    social = spark.createDataFrame([("A", dt.date(2023, 11, 6), 70, 0.25, 3), ("A", dt.date(2023, 12, 6), None, float("nan"), None),
                                    ("B", dt.date(2024, 1, 3), 10, None, 5)],
                                   "sku_id string, week_start date, trend_index int, sentiment_score double, mention_count bigint")
    stock = spark.createDataFrame([("A", 3.0), ("B", None)], "sku_id string, days_of_supply double")
    got = FT.feature_matrix(sales, products, social, stock)
    w = FT.sku_demand_encoding(FT.holiday_week_flag(FT.calendar_features(FT.weekly_demand(sales))))
    w = FT.inventory_features(FT.social_weekly_lag(FT.weeks_since_launch(w, products), social), stock)
    w = FT.category_codes(w.where("sku_id <> 'A'"), products, skus=sales.select("sku_id").distinct()).fillna(0)
    cols = [c for c in got.columns if c in w.columns]
    assert len(cols) > 25 and got.columns == ["sku_id", "date", "demand", *FT.FEATURE_COLUMNS]
    assert [t for c, t in got.dtypes if c in cols] == [dict(w.dtypes)[c] for c in cols]
    seen = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*cols).collect())
    assert seen(got.where("sku_id <> 'A'")) == seen(w)
    # A has a week of unknown units: its running values are 0 from there on, as is what they are multiplied with
    a = got.where("sku_id = 'A'").orderBy("date").collect()
    assert {r["sku_mean_x_month_sin"] for r in a} == {0.0} and a[-1]["prior_x_ewm4"] == a[-1]["ewm_4w"] == 0.0
    assert {(r["trend_index_lag1w"], r["sentiment_lag1w"], r["mention_lag1w"]) for r in a} == {
        (70.0, 0.25, 3.0), (50.0, 0.0, 100.0), (50.0, 0.6, 100.0)}
    assert got.where(" or ".join(f"{c} is null" for c in got.columns[1:])).count() == 0
    # the rows come out of one step and meet no join
    assert "Join" not in _plan(got).split("MapInArrow")[0]
