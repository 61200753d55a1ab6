"""Demand diagnostics.

The modelled script builds a dense SKU x day grid in memory.  Here the grid
is never materialised: every statistic is written in closed form over the
non-zero cells (one row per SKU and sale day, pre-aggregated with map-side
combine) plus the calendar length D.  Zero cells contribute nothing to sums,
so e.g. the grid mean is S / D and the sample variance is
(D * sum(q^2) - S^2) / (D (D - 1)).  Lagged products need the one self-join
of the non-zero cells on (sku, date + lag).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.expr import week_monday
from framewise.functions.ranks import exact_quantiles_by, global_row_number

ACF_LAGS = [1, 2, 7, 14, 30, 90]
SKU_ACF_LAG = 7
CONCENTRATION_PCTS = [0.1, 0.2, 0.5]
BOTTOM_N = 50
ZERO_PREDICTABLE_SHARE = 0.7


def _cells(sales: DataFrame) -> DataFrame:
    """Non-zero (sku, day) cells: units summed per SKU and date."""
    return sales.groupBy("sku_id", "date").agg(F.sum("quantity_sold").alias("q"))


def _bounds(cells: DataFrame) -> DataFrame:
    """One row: first and last sale day and the day count D."""
    return cells.agg(F.min("date").alias("d_lo"), F.max("date").alias("d_hi")).select(
        "d_lo", "d_hi", (F.datediff("d_hi", "d_lo") + 1).cast("long").alias("n_days"))


def describe_quantity(sales: DataFrame) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear), max of the line
    quantity (A78).  ``percentile`` keeps one count per distinct value, and a
    quantity has few distinct values."""
    q = F.col("quantity_sold")
    return sales.agg(
        F.count(q).alias("count"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("std"),
        F.min(q).cast("double").alias("min"),
        F.percentile(q, 0.25).alias("p25"), F.percentile(q, 0.5).alias("p50"),
        F.percentile(q, 0.75).alias("p75"), F.max(q).cast("double").alias("max"))


def demand_sparsity(sales: DataFrame) -> DataFrame:
    """Active SKUs, date range, grid cells, non-zero cells, fill %."""
    cells = _cells(sales)
    agg = cells.agg(F.countDistinct("sku_id").alias("active_skus"), F.count(F.lit(1)).alias("nonzero_cells"))
    out = agg.crossJoin(_bounds(cells))
    return out.select(
        "active_skus", F.col("d_lo").alias("start_date"), F.col("d_hi").alias("end_date"), "n_days",
        (F.col("active_skus") * F.col("n_days")).alias("total_cells"), "nonzero_cells",
        (F.col("nonzero_cells") * F.lit(100.0) / (F.col("active_skus") * F.col("n_days"))).alias("fill_pct"))


def sku_daily_stats(sales: DataFrame) -> DataFrame:
    """Per SKU on the dense daily grid: mean, sample std, max, sum."""
    cells = _cells(sales)
    per = cells.groupBy("sku_id").agg(
        F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss"),
        F.max("q").alias("mx"), F.count(F.lit(1)).alias("c"))
    d = F.col("n_days")
    var_num = (d * F.col("ss") - F.col("s") * F.col("s")).cast("double")
    std = F.when(d > 1, F.sqrt(F.greatest(var_num, F.lit(0.0)) / (d * (d - 1)).cast("double")))
    mx = F.when(F.col("c") < d, F.greatest(F.col("mx"), F.lit(0))).otherwise(F.col("mx"))
    return per.crossJoin(F.broadcast(_bounds(cells))).select(
        "sku_id", (F.col("s") / d.cast("double")).alias("mean"), std.alias("std"),
        mx.cast("long").alias("max"), F.col("s").cast("long").alias("sum"))


def sku_daily_stats_summary(sales: DataFrame) -> DataFrame:
    """``describe()`` of the per-SKU grid statistics (A80), long form: one
    row per statistic with count, mean, std, min, quartiles, max."""
    stats = sku_daily_stats(sales)
    names = ["mean", "std", "max", "sum"]
    long = stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in names])))
    basic = long.groupBy("stat").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                     F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = exact_quantiles_by(long, "stat", "v", [0.25, 0.5, 0.75])
    return basic.join(F.broadcast(quartiles), "stat", "left").select(          # a row per statistic
        "stat", "count", "mean", "std", "min", F.col("q_25").alias("p25"), F.col("q_50").alias("p50"), F.col("q_75").alias("p75"), "max")


def _daily_totals(sales: DataFrame) -> DataFrame:
    """Total units per calendar day, every day of the range (0 if none).
    One row per day: bounded by the calendar, not by the data volume."""
    cells = _cells(sales)
    tot = cells.groupBy("date").agg(F.sum("q").alias("x"))
    days = _bounds(cells).select(F.explode(F.sequence("d_lo", "d_hi")).alias("date"))
    return days.join(tot, "date", "left").select("date", F.coalesce("x", F.lit(0)).cast("double").alias("x"))


def demand_acf(sales: DataFrame, lags=ACF_LAGS) -> DataFrame:
    """Pearson autocorrelation of total daily demand at each lag (A81):
    corr(x_t, x_{t-lag}) over the days where both exist."""
    x = _daily_totals(sales)
    lag_df = x.select("date", "x", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    prev = x.select(F.col("date").alias("pdate"), F.col("x").alias("px"))
    pairs = lag_df.join(prev, F.col("pdate") == F.date_sub("date", F.col("lag")), "inner")
    return pairs.groupBy("lag").agg(F.corr("x", "px").alias("acf"))


def sku_acf7(sales: DataFrame, lag: int = SKU_ACF_LAG) -> DataFrame:
    """Lag-7 autocorrelation of every SKU's dense daily series (SKUs whose
    series is not constant), then its mean and population std over SKUs
    (A82).  The modelled script samples 20 SKUs; this covers all of them.

    For a series x_0..x_{D-1} and pairs a_t = x_t, b_t = x_{t-lag}, t >= lag:
    the sums of a, b, a^2, b^2 are the SKU totals minus the first / last
    ``lag`` days, and sum(a b) comes from the self-join of non-zero cells on
    (sku, date + lag); zero cells add nothing to any of them."""
    cells = _cells(sales)
    b = F.broadcast(_bounds(cells))
    c = cells.crossJoin(b)
    head = F.col("date") < F.date_add("d_lo", lag)
    tail = F.col("date") > F.date_sub("d_hi", lag)
    q, q2 = F.col("q").cast("double"), (F.col("q") * F.col("q")).cast("double")
    per = c.groupBy("sku_id").agg(
        F.sum(q).alias("s"), F.sum(q2).alias("ss"),
        F.sum(F.when(head, q).otherwise(0.0)).alias("s_head"), F.sum(F.when(head, q2).otherwise(0.0)).alias("ss_head"),
        F.sum(F.when(tail, q).otherwise(0.0)).alias("s_tail"), F.sum(F.when(tail, q2).otherwise(0.0)).alias("ss_tail"),
        F.first("n_days").alias("n_days"))
    later = cells.select("sku_id", F.date_sub("date", lag).alias("date"), F.col("q").alias("q_next"))
    sab = (cells.join(later, ["sku_id", "date"], "inner")
                .groupBy("sku_id").agg(F.sum((F.col("q") * F.col("q_next")).cast("double")).alias("sab")))
    j = per.join(sab, "sku_id", "left")
    d = F.col("n_days").cast("double")
    m = d - F.lit(float(lag))
    sa, sb = F.col("s") - F.col("s_head"), F.col("s") - F.col("s_tail")
    saa, sbb = F.col("ss") - F.col("ss_head"), F.col("ss") - F.col("ss_tail")
    num = m * F.coalesce(F.col("sab"), F.lit(0.0)) - sa * sb
    den = F.sqrt((m * saa - sa * sa) * (m * sbb - sb * sb))
    r = F.when((m > 1) & (den > 0), num / den)
    varying = d * F.col("ss") - F.col("s") * F.col("s") > 0
    per_sku = j.where(varying).select("sku_id", r.alias("acf7"))
    return per_sku.agg(F.count("acf7").alias("n_skus"), F.avg("acf7").alias("acf7_mean"),
                       F.stddev_pop("acf7").alias("acf7_std"))


def _period_index(sales: DataFrame, key, name: str) -> DataFrame:
    by = sales.groupBy(key.alias(name)).agg(F.sum("quantity_sold").alias("units"))
    return by.crossJoin(F.broadcast(by.agg(F.avg("units").alias("_mu")))).select(
        name, "units", (F.col("units") / F.col("_mu")).alias("index"))


def month_index(sales: DataFrame) -> DataFrame:
    """Units by calendar month / mean of the month totals."""
    return _period_index(sales, F.month("date"), "month")


def dow_index(sales: DataFrame) -> DataFrame:
    """Units by weekday (Monday = 0) / mean of the weekday totals."""
    return _period_index(sales, F.weekday("date"), "dow")


def demand_concentration(sales: DataFrame, pcts=CONCENTRATION_PCTS, bottom_n: int = BOTTOM_N) -> DataFrame:
    """Share of units in the top 10 / 20 / 50 % of SKUs (k = max(1,
    int(n p))), units of the bottom 50 SKUs, top and bottom SKU (A85).
    SKUs are ordered by units desc, then sku_id; the rank is a distributed
    row number (one row per SKU, no single-task window)."""
    tot = sales.groupBy("sku_id").agg(F.sum("quantity_sold").alias("units"))
    ranked = global_row_number(tot, ["-units", "sku_id"], "rn")
    n = tot.agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("all_units"))
    j = ranked.crossJoin(F.broadcast(n))
    cols = [F.first("n").alias("n_skus")]
    for p in pcts:
        k = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(p))))
        tag = int(round(p * 100))
        cols.append(F.max(k).cast("long").alias(f"top{tag}_k"))
        cols.append((F.sum(F.when(F.col("rn") <= k, F.col("units")).otherwise(0)) * F.lit(100.0)
                     / F.first("all_units")).alias(f"top{tag}_share_pct"))
    cols += [
        F.sum(F.when(F.col("rn") > F.col("n") - bottom_n, F.col("units")).otherwise(0)).alias(f"bottom{bottom_n}_units"),
        F.max(F.when(F.col("rn") == 1, F.col("sku_id"))).alias("top_sku"),
        F.max(F.when(F.col("rn") == 1, F.col("units"))).alias("top_units"),
        F.max(F.when(F.col("rn") == F.col("n"), F.col("sku_id"))).alias("bottom_sku"),
        F.max(F.when(F.col("rn") == F.col("n"), F.col("units"))).alias("bottom_units"),
    ]
    return j.agg(*cols)


SOCIAL_CORR_VARS = ["quantity_sold", "trend_index", "mention_count", "sentiment_score"]


def social_sales_corr(sales: DataFrame, social: DataFrame) -> DataFrame:
    """Weekly units per SKU inner-joined to the weekly mean social values
    per SKU, Pearson matrix of the four columns in long form (A86).  Both
    sides are keyed by the Monday of their week."""
    sw = (sales.groupBy("sku_id", week_monday("date").alias("week"))
               .agg(F.sum("quantity_sold").cast("double").alias("quantity_sold")))
    so = (social.groupBy("sku_id", week_monday("week_start").alias("week"))
                .agg(F.avg("trend_index").alias("trend_index"),
                     F.avg("mention_count").alias("mention_count"),
                     F.avg("sentiment_score").alias("sentiment_score")))
    m = sw.join(so, ["sku_id", "week"], "inner")
    v = SOCIAL_CORR_VARS
    pairs = [(a, b) for i, a in enumerate(v) for b in v[i + 1:]]
    wide = m.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("var_a"), F.lit(a).alias("var_b"), F.lit(1.0).alias("r")) for a in v]
    for a, b in pairs:
        rows.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"`{a}|{b}`").alias("r")))
        rows.append(F.struct(F.lit(b).alias("var_a"), F.lit(a).alias("var_b"), F.col(f"`{a}|{b}`").alias("r")))
    return wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def feature_demand_corr(sales: DataFrame) -> DataFrame:
    """Pearson r of daily SKU units with month, weekday, year, weekend,
    quarter and the SKU's grid mean, over sale days (A87), long form."""
    cells = _cells(sales)
    means = sku_daily_stats(sales).select("sku_id", F.col("mean").alias("sku_mean"))
    d = cells.join(means, "sku_id", "inner").select(
        F.col("q").cast("double").alias("q"), F.month("date").alias("month"), F.weekday("date").alias("dow"),
        F.year("date").alias("year"), (F.weekday("date") >= 5).cast("int").alias("weekend"),
        F.quarter("date").alias("quarter"), "sku_mean")
    feats = ["month", "dow", "year", "weekend", "quarter", "sku_mean"]
    wide = d.where(F.col("q") > 0).agg(*[F.corr("q", F.col(f).cast("double")).alias(f) for f in feats])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r"))
                                            for f in feats])).alias("e")).select("e.*")


def zero_day_analysis(sales: DataFrame, lag: int = SKU_ACF_LAG) -> DataFrame:
    """Zero and non-zero SKU-days of the dense grid and the share of zero
    days whose value ``lag`` days earlier is also zero (missing = 0) (A88).

    Zero days with a non-zero lag are non-zero cells e (e + lag <= last day)
    whose cell e + lag is zero: (non-zero cells before last - lag) minus
    (non-zero pairs e, e + lag)."""
    cells = _cells(sales).where(F.col("q") > 0)
    b = F.broadcast(_bounds(_cells(sales)))
    later = cells.select("sku_id", F.date_sub("date", lag).alias("date"), F.lit(1).alias("nz_next"))
    c = cells.join(later, ["sku_id", "date"], "left").crossJoin(b)
    agg = c.agg(
        F.countDistinct("sku_id").alias("skus"), F.count(F.lit(1)).alias("nonzero_days"),
        F.sum(F.when(F.col("date") <= F.date_sub("d_hi", lag), 1).otherwise(0)).alias("n_early"),
        F.sum(F.coalesce("nz_next", F.lit(0))).alias("n_pairs"), F.first("n_days").alias("n_days"))
    # SKUs whose every cell sums to 0 still belong to the grid
    skus = _cells(sales).agg(F.countDistinct("sku_id").alias("all_skus"))
    j = agg.crossJoin(skus)
    total = F.col("all_skus") * F.col("n_days")
    zero = total - F.col("nonzero_days")
    zero_lag_nz = F.col("n_early") - F.col("n_pairs")
    share = F.when(zero > 0, (zero - zero_lag_nz) / zero.cast("double"))
    return j.select(
        zero.cast("long").alias("zero_days"), F.col("nonzero_days").cast("long").alias("nonzero_days"),
        (zero * F.lit(100.0) / total).alias("zero_pct"),
        (F.col("nonzero_days") * F.lit(100.0) / total).alias("nonzero_pct"),
        (share * F.lit(100.0)).alias("zero_lag7_zero_pct"),
        (F.coalesce(share, F.lit(0.0)) > F.lit(ZERO_PREDICTABLE_SHARE)).alias("predictable"))
