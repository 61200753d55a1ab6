"""Customer signals: velocity, returns, trending, seasonality, segment
preferences, latent demand (A29-A38)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.expr import (
    clip, right_closed_band, round_half_even, safe_div,
)
from framewise.functions.ranks import avg_tie_pct_rank

MOMENTUM_EDGES = [-20.0, 20.0]
MOMENTUM_LABELS = ["decelerating", "stable", "accelerating"]


def sales_velocity(sales: DataFrame, window_days: int = 30) -> DataFrame:
    """Per-SKU units in the current window ``[m - w, m]`` (w + 1 days) and the
    prior window ``[m - 2w, m - w - 1]`` (w days), m = last sale date.

    The last date is fetched first (one row), so the window's start is a
    literal that reaches the scan as a pushed filter; one filtered pass with
    two conditional sums then replaces two aggregates and a full outer join.
    Only SKUs with a sale in either window are returned.
    momentum: change <= -20 decelerating, (-20, 20] stable, > 20 accelerating.
    """
    last = sales.agg(F.max("date")).first()[0]
    m = F.lit(last).cast("date")
    age = F.datediff(m, F.col("date"))
    start = last - dt.timedelta(days=2 * window_days) if last is not None else None
    recent = sales.where(F.col("date") >= F.lit(start).cast("date"))
    agg = recent.groupBy("sku_id").agg(
        F.coalesce(F.sum(F.when(age <= window_days, F.col("quantity_sold"))), F.lit(0))
         .alias("current_velocity"),
        F.coalesce(F.sum(F.when(age > window_days, F.col("quantity_sold"))), F.lit(0))
         .alias("prior_velocity"),
    )
    cur, prior = F.col("current_velocity"), F.col("prior_velocity")
    change = F.when(prior > 0, (cur - prior).cast("double") / prior * F.lit(100.0)).otherwise(F.lit(0.0))
    return (agg.withColumn("velocity_change_pct", change)
               .withColumn("momentum", right_closed_band("velocity_change_pct", MOMENTUM_EDGES,
                                                         MOMENTUM_LABELS)))


def return_rate_analysis(sales: DataFrame, returns: DataFrame,
                         products: DataFrame | None = None) -> DataFrame:
    """Per SKU: units sold, return rows, top reason, quality-issue share,
    return rate % (2 dp, half-even), flags.  Full outer join of the sold and
    returned SKU sets; both sides are aggregated by ``sku_id`` first so the
    join reuses their partitioning.

    Ties for the top reason go to the alphabetically smallest reason (the
    modelled code takes the first seen, which depends on file order).
    """
    sold = sales.groupBy("sku_id").agg(F.sum("quantity_sold").alias("total_sold"))
    ret = returns.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("total_returned"),
        F.mode("return_reason", deterministic=True).alias("top_return_reason"),
        F.avg(F.when(F.col("return_reason") == "quality_issue", F.lit(1.0)).otherwise(F.lit(0.0)))
         .alias("quality_issue_pct"),
    )
    j = sold.join(ret, "sku_id", "full")
    total_sold = F.coalesce(F.col("total_sold"), F.lit(0)).cast("bigint")
    total_ret = F.coalesce(F.col("total_returned"), F.lit(0)).cast("bigint")
    rate = F.coalesce(safe_div(total_ret.cast("double"),
                               F.when(total_sold != 0, total_sold.cast("double"))) * F.lit(100.0),
                      F.lit(0.0))
    out = j.select(
        "sku_id",
        total_sold.alias("total_sold"),
        total_ret.alias("total_returned"),
        "top_return_reason",
        "quality_issue_pct",
        round_half_even(rate, 2).alias("return_rate_pct"),
    )
    out = (out.withColumn("is_problematic", F.col("return_rate_pct") > 15)
              .withColumn("quality_flag", F.coalesce(F.col("quality_issue_pct") > 0.40, F.lit(False))))
    if products is not None and "supplier_id" in products.columns:
        out = out.join(products.select("sku_id", "supplier_id"), "sku_id", "left")
    return out


def _with_minmax_norms(df: DataFrame, cols: list[str]) -> DataFrame:
    """Attach ``_n_<c>`` = min-max normalised ``c`` (0 when constant).  All
    bounds come from one aggregate row attached by broadcast, so the input is
    aggregated once, not once per bound."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    out = df.crossJoin(F.broadcast(df.agg(*aggs)))
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(f"_n_{c}", F.when(hi == lo, F.lit(0.0))
                                         .otherwise((F.col(c) - lo).cast("double") / (hi - lo)))
    return out.drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])


def recent_social(social: DataFrame, weeks: int = 4) -> DataFrame:
    """Social rows of the last ``weeks + 1`` weeks (week >= max week - 4w)."""
    max_week = social.select(F.max("week_start")).scalar()
    return social.where(F.col("week_start") >= F.date_sub(max_week, 7 * weeks))


def trending_scores(social: DataFrame, sales: DataFrame) -> DataFrame:
    """All SKUs with recent social activity and their composite trend score
    (before the top-n cut)."""
    recent = recent_social(social)
    agg = recent.groupBy("sku_id").agg(
        F.avg("mention_count").alias("mention_count_4wk_avg"),
        F.avg("sentiment_score").alias("sentiment_score"),
        F.sum("influencer_mentions").alias("influencer_mentions"),
    )
    vel = sales_velocity(sales).select("sku_id", "velocity_change_pct")
    merged = (agg.join(vel, "sku_id", "left")
                 .withColumn("velocity_change_pct", F.coalesce("velocity_change_pct", F.lit(0.0))))
    cols = ["mention_count_4wk_avg", "sentiment_score", "velocity_change_pct", "influencer_mentions"]
    merged = _with_minmax_norms(merged, cols)
    score = (F.lit(0.40) * F.col("_n_mention_count_4wk_avg")
             + F.lit(0.30) * F.col("_n_sentiment_score")
             + F.lit(0.20) * F.col("_n_velocity_change_pct")
             + F.lit(0.10) * F.col("_n_influencer_mentions"))
    return (merged.withColumn("trend_score", round_half_even(score, 4))
                  .drop(*[f"_n_{c}" for c in cols]))


def platform_breakdown(social: DataFrame) -> DataFrame:
    """Per SKU a map platform -> recent mentions, with 0 for every platform
    seen in the recent window but not for this SKU.  The platform list is one
    row (a handful of values) attached by broadcast, so there is no
    SKU x platform grid."""
    recent = recent_social(social)
    plist = recent.agg(F.array_sort(F.collect_set("platform")).alias("_plats"))
    per = (recent.groupBy("sku_id", "platform").agg(F.sum("mention_count").alias("m"))
                 .groupBy("sku_id").agg(F.map_from_entries(F.collect_list(F.struct("platform", "m")))
                                         .alias("_m"))
                 .crossJoin(F.broadcast(plist)))
    platforms = F.col("_plats")
    return per.select(
        "sku_id",
        F.map_from_arrays(platforms, F.transform(
            platforms, lambda p: F.coalesce(F.element_at(F.col("_m"), p), F.lit(0)).cast("bigint")))
         .alias("platform_breakdown"))


def trending_skus(social: DataFrame, sales: DataFrame, top_n: int = 15) -> DataFrame:
    """Top-n SKUs by trend score (ties by ``sku_id``) with the platform map.
    The top-n is a distributed take-ordered, the map is joined after it."""
    top = trending_scores(social, sales).orderBy(F.col("trend_score").desc(), "sku_id").limit(top_n)
    return top.join(platform_breakdown(social), "sku_id", "left")


def demand_seasonality(sales: DataFrame) -> DataFrame:
    """Month -> mean over SKUs of (month total / SKU's mean month total),
    each ratio rounded to 4 dp; SKUs with a zero mean are skipped."""
    monthly = (sales.groupBy("sku_id", F.year("date").alias("year"), F.month("date").alias("month"))
                    .agg(F.sum("quantity_sold").alias("q")))
    sku_mean = monthly.groupBy("sku_id").agg(F.avg("q").alias("mean_q"))
    idx = (monthly.join(sku_mean, "sku_id")
                  .where(F.col("mean_q") > 0)
                  .select("month", round_half_even(F.col("q") / F.col("mean_q"), 4).alias("ix")))
    return idx.groupBy("month").agg(F.avg("ix").alias("seasonality_index"))


PREFERENCE_PAIRS = {
    "age_group_x_frame_shape": ("customer_age_group", "frame_shape"),
    "gender_x_price_point": ("customer_gender", "price_point"),
    "channel_x_category": ("channel", "category"),
    "region_x_frame_shape": ("region", "frame_shape"),
}


def segment_preference(sales: DataFrame, products: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Long form of a row-normalised pivot: ``(row, col, quantity, share)``
    with share = cell / row total, 4 dp.  Rows or columns with a NULL label
    are dropped (as a pivot table drops them).  Cells absent from the data
    are share 0 and are not listed; ``to_wide`` pivots when needed.  Lines are
    summed per SKU and segment before they meet the products, so a hot SKU is
    a few rows by then."""
    per_sku = (sales.where(F.col(row_col).isNotNull()).groupBy("sku_id", row_col)
                    .agg(F.sum("quantity_sold").alias("_q")))
    cells = (per_sku.join(products.select("sku_id", col_col), "sku_id").where(F.col(col_col).isNotNull())
                    .groupBy(row_col, col_col).agg(F.sum("_q").alias("quantity")))
    row_tot = cells.groupBy(row_col).agg(F.sum("quantity").alias("_rt"))
    return (cells.join(row_tot, row_col)
                 .select(F.col(row_col).alias("row_value"), F.col(col_col).alias("col_value"),
                         "quantity",
                         round_half_even(safe_div(F.col("quantity").cast("double"), F.col("_rt")), 4)
                          .alias("share")))


def to_wide(long_df: DataFrame, values: list[str] | None = None) -> DataFrame:
    """Pivot a long preference table to the heat-map shape (0 fill).  Pass
    ``values`` to avoid the extra job that discovers the column labels."""
    return (long_df.groupBy("row_value").pivot("col_value", values).agg(F.first("share"))
                   .fillna(0.0))


def customer_segment_preferences(sales: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    return {name: segment_preference(sales, products, r, c) for name, (r, c) in PREFERENCE_PAIRS.items()}


def wishlist_demand_proxy(sales: DataFrame, inventory: DataFrame | None = None,
                          window_days: int = 30) -> DataFrame:
    """Latent demand = average-tie percent rank of current velocity / dos_norm,
    dos_norm = SKU mean days of supply / max(max of those, 1), clipped to
    [0.01, 1], NULL -> 0.5.  Without inventory the score is the rank."""
    vel = sales_velocity(sales, window_days)
    vel = avg_tie_pct_rank(vel, "current_velocity", "velocity_rank")
    if inventory is None:
        return vel.withColumn("latent_demand_score", F.col("velocity_rank"))
    inv = inventory.groupBy("sku_id").agg(F.avg("days_of_supply").alias("_dos"))
    max_dos = inv.select(F.greatest(F.max("_dos"), F.lit(1.0))).scalar()
    inv = inv.select("sku_id", clip(F.col("_dos") / max_dos, 0.01, 1.0).alias("dos_norm"))
    merged = (vel.join(inv, "sku_id", "left")
                 .withColumn("dos_norm", F.coalesce("dos_norm", F.lit(0.5))))
    return merged.withColumn("latent_demand_score", F.col("velocity_rank") * (F.lit(1.0) / F.col("dos_norm")))
