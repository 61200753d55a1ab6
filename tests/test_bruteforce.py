"""Operators checked against direct (brute-force) definitions on small
fixtures: the EWM recursion, rolling frames, the closed-form diagnostics and
the distributed rank / quantile helpers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.functions.ranks import avg_tie_pct_rank, exact_quantiles, exact_quantiles_by, global_row_number, place
from framewise.operators import diagnostics as D
from framewise.operators import features as FT


def _weekly(spark, series: dict[str, list[int]]):
    start = dt.date(2024, 1, 1)
    rows = [(k, start + dt.timedelta(days=7 * i), int(v)) for k, vals in series.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "sku_id string, date date, demand bigint")


def test_ewm_matches_recursion(spark):
    rng = np.random.default_rng(1)
    # 1,200 weeks cross two block boundaries of the default 512-week block
    series = {"A": rng.integers(0, 20, 1200).tolist(), "B": [0] * 10 + [5] * 30, "C": [3]}
    spans = [1, 2, *FT.EWM_SPANS, 100, 300, 2000]
    out = FT.ewm_features(_weekly(spark, series), spans).toPandas()
    for sku, vals in series.items():
        x = [0.0] + [float(v) for v in vals[:-1]]
        got = out[out.sku_id == sku].sort_values("date")
        for span in spans:
            a = 2.0 / (span + 1.0)
            y, exp = 0.0, []
            for i, xi in enumerate(x):
                y = xi if i == 0 else (1 - a) * y + a * xi
                exp.append(y)
            np.testing.assert_allclose(got[f"ewm_{span}w"].to_numpy(), exp, rtol=1e-9, atol=1e-12)


def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(2)
    vals = rng.integers(0, 9, 40).tolist()
    out = FT.rolling_stats(_weekly(spark, {"A": vals})).toPandas().sort_values("date")
    sh = pd.Series([0] + vals[:-1], dtype=float)
    for w in FT.ROLL_MEANS:
        np.testing.assert_allclose(out[f"rolling_mean_{w}w"], sh.rolling(w, min_periods=1).mean())
    np.testing.assert_allclose(out["rolling_std_13w"], sh.rolling(13, min_periods=1).std().fillna(0))
    np.testing.assert_allclose(out["rolling_median_13w"], sh.rolling(13, min_periods=1).median())


def _sales(spark, cells):
    return spark.createDataFrame([(s, d, q) for s, d, q in cells], "sku_id string, date date, quantity_sold bigint")


def _dense(cells):
    df = pd.DataFrame(cells, columns=["sku_id", "date", "q"])
    daily = df.groupby(["sku_id", "date"])["q"].sum().reset_index()
    days = pd.date_range(daily.date.min(), daily.date.max(), freq="D").date
    idx = pd.MultiIndex.from_product([daily.sku_id.unique(), days], names=["sku_id", "date"])
    return daily.set_index(["sku_id", "date"]).reindex(idx, fill_value=0).reset_index()


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(3)
    start = dt.date(2024, 1, 1)
    out = []
    for s in ["A", "B", "C", "D"]:
        for d in rng.choice(120, size=int(rng.integers(5, 80)), replace=False):
            out.append((s, start + dt.timedelta(days=int(d)), int(rng.integers(1, 6))))
    out.append(("E", start + dt.timedelta(days=3), 2))
    return out


def test_sku_acf7_and_zero_days_match_dense_grid(spark, cells):
    full = _dense(cells)
    acfs = []
    for _, g in full.groupby("sku_id"):
        ts = g.sort_values("date")["q"].astype(float)
        if ts.std() > 0:
            acfs.append(ts.autocorr(lag=7))
    got = D.sku_acf7(_sales(spark, cells)).first()
    assert got["acf7_mean"] == pytest.approx(np.nanmean(acfs), rel=1e-9)
    assert got["acf7_std"] == pytest.approx(np.nanstd(acfs), rel=1e-9)

    full = full.sort_values(["sku_id", "date"])
    full["lag7"] = full.groupby("sku_id")["q"].shift(7).fillna(0)
    zero = full[full.q == 0]
    z = D.zero_day_analysis(_sales(spark, cells)).first()
    assert z["zero_days"] == len(zero)
    assert z["zero_lag7_zero_pct"] == pytest.approx((zero.lag7 == 0).mean() * 100, rel=1e-12)

    st = D.sku_daily_stats(_sales(spark, cells)).toPandas().set_index("sku_id").sort_index()
    exp = full.groupby("sku_id")["q"].agg(["mean", "std", "max", "sum"])
    np.testing.assert_allclose(st["mean"], exp["mean"])
    np.testing.assert_allclose(st["std"], exp["std"])
    assert st["max"].tolist() == exp["max"].tolist()


def test_global_ranks_and_quantiles(spark):
    rng = np.random.default_rng(4)
    vals = rng.integers(0, 30, 500).tolist()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, v double")
    rn = global_row_number(df, ["-v", "id"], "rn", buckets=7, cell_rows=20).toPandas()
    exp = pd.DataFrame({"id": range(500), "v": vals}).sort_values(["v", "id"], ascending=[False, True])
    assert rn.sort_values("rn")["id"].tolist() == exp["id"].tolist()
    for rows in (3, 1 << 16):
        q = exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.9], cell_rows=rows).first()
        for p in [0.1, 0.25, 0.5, 0.9]:
            assert q[f"q_{int(p * 100)}"] == pytest.approx(np.quantile(vals, p))
        by = exact_quantiles_by(df.withColumn("g", F.col("id") % 3), "g", "v", [0.25, 0.5], cell_rows=rows).collect()
        assert {(r["g"], r["q_25"], r["q_50"]) for r in by} == \
            {(g, np.quantile(vals[g::3], 0.25), np.quantile(vals[g::3], 0.5)) for g in range(3)}
        pr = avg_tie_pct_rank(df, "v", "pr", buckets=5, cell_rows=rows).toPandas().sort_values("id")
        np.testing.assert_allclose(pr["pr"], pd.Series(vals, dtype=float).rank(pct=True))


ORDERS = {
    "double": ("double", [0.0, -1.5, 1e-300, 1e300, float("inf"), float("-inf"), float("nan"), 3.0, 3.0000000001, None] + [(i + 1) / 7 for i in range(60)]),
    "string": ("string", ["", "SKU0000", "SKU0000001", None, "été", "é", "zz", "a"] + [f"SKU-LONG-COMMON-PREFIX-{i:04d}" for i in range(60)]),
    "long": ("long", [-(1 << 63), (1 << 63) - 1, 0, -1, None] + [7 + i for i in range(60)]),
    "date": ("date", [dt.date(1960, 1, 1), None] + [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]),
}


@pytest.mark.parametrize("kind", ORDERS)
@pytest.mark.parametrize("desc", [False, True])
def test_cells_follow_the_order(spark, kind, desc):
    """Row numbers equal one global sort, whatever the type of the key; cells
    hold at most the wanted rows where keys differ early enough."""
    dtype, values = ORDERS[kind]
    df = spark.createDataFrame([(i, values[i % len(values)]) for i in range(3 * len(values))], f"id long, v {dtype}")
    order = ["-v" if desc else "v", "id"]
    got = [r["id"] for r in global_row_number(df, order, "rn", buckets=64, cell_rows=4).orderBy("rn").collect()]
    assert got == [r["id"] for r in df.orderBy(F.desc("v") if desc else F.asc("v"), "id").collect()]
    placed = place(df, order, buckets=64, cell_rows=4)
    assert placed.rows.groupBy(*placed.cells).count().agg(F.max("count")).first()[0] <= 6


def test_plan_does_not_grow_with_partitions(spark):
    df = spark.range(50_000).select("id", (F.xxhash64("id") % 100_000).cast("double").alias("v"))
    plans = []
    for buckets in (16, 6000):
        placed = place(df, ["v", "id"], buckets, cell_rows=8)
        plans.append(len(placed.rows._jdf.queryExecution().analyzed().toString()))
    assert plans[1] < 3 * plans[0]


@pytest.mark.parametrize("partitions", [2, 4, 16, 200])
def test_global_ranks_at_any_partitioning(spark, partitions):
    """More rows than any sampler takes whole, extra columns, NULLs, and one
    value held by a third of the rows."""
    n = 400_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        v = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 11 == 0, F.lit(None)) \
            .otherwise((F.xxhash64("id") % 5000).cast("double"))
        df = spark.range(n).select("id", v.alias("v"), F.concat(F.lit("x"), F.col("id")).alias("extra"))
        pdf = df.select("id", "v").toPandas().sort_values("id")
        got = avg_tie_pct_rank(df, "v", "pr").toPandas().sort_values("id")
        np.testing.assert_allclose(got["pr"], pdf["v"].rank(pct=True), rtol=1e-12)
        rn = global_row_number(df.where("v is not null"), ["-v", "id"], "rn").toPandas().sort_values("rn")
        exp = pdf[pdf.v.notna()].sort_values(["v", "id"], ascending=[False, True])
        assert rn["rn"].tolist() == list(range(1, len(exp) + 1))
        assert rn["id"].tolist() == exp["id"].tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("weeks", [1, 7, 90])
def test_series_kernel_equals_the_windows(spark, weeks):
    rng = np.random.default_rng(weeks)
    series = {k: rng.integers(0, 40, weeks).tolist() for k in "ABC"} | {"D": [5] * weeks, "E": [0] * (weeks - 1) + [3]}
    grid = _weekly(spark, series)
    lo = dt.date(2024, 1, 1)
    arrays = spark.createDataFrame(list(series.items()), "sku_id string, q array<bigint>")
    got = FT.series_features(arrays, lo, weeks).select("sku_id", "sku_mean_demand", "sku_log_mean", "sku_cv", F.inline("_rows"))
    got = got.select("*", "_last13.*").drop("_last13").withColumn("date", F.date_add(F.lit(lo), F.col("_w") * 7)).toPandas()
    want = FT.ewm_features(FT.rolling_stats(FT.lag_features(grid)))
    want = FT.sku_woy_prior(FT.sku_month_prior(FT.sku_demand_encoding(FT.calendar_features(want)))).toPandas()
    got, want = (d.sort_values(["sku_id", "date"]).reset_index(drop=True) for d in (got, want))
    cols = [c for c in got.columns if c not in ("sku_id", "date", "_w")]
    assert got[["sku_id", "date"]].equals(want[["sku_id", "date"]]) and len(cols) == 23
    np.testing.assert_allclose(got[cols].astype(float), want[cols].astype(float), rtol=1e-9, atol=1e-12)
