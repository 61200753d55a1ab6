"""Report queries behind the API routes and dashboard pages.

The HTTP layer itself is not rebuilt; each route's data is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators.signals import sales_velocity

# The columns that a recommendation shows, in order.
REC_DISPLAY_COLUMNS = [
    "sku_id", "name", "frame_shape", "urgency_band", "recommended_qty",
    "estimated_cost_usd", "estimated_margin_usd", "margin_pct",
    "preferred_supplier", "supplier_risk_band", "confidence_score", "price_point",
]


def _by_urgency() -> list:
    return [F.col("urgency_score").desc(), F.col("sku_id")]


def overview_kpis(inventory: DataFrame, products: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Critical (<7 days) and at-risk (<14) SKU counts, revenue at risk and
    overstock cost from the portfolio row, active SKU count (A63)."""
    inv = (inventory.groupBy("sku_id").agg(F.avg("days_of_supply").alias("dos"))
                    .agg(F.count_if(F.col("dos") < 7).alias("critical_skus"),
                         F.count_if(F.col("dos") < 14).alias("at_risk_skus")))
    act = products.agg(F.count_if(F.col("is_active")).alias("active_skus"))
    port = portfolio.select(F.col("projected_revenue_at_risk_usd").alias("revenue_at_risk_usd"),
                            "overstock_cost_usd")
    return inv.crossJoin(port).crossJoin(act)


def top_recommendations(recs: DataFrame, n: int = 15) -> DataFrame:
    """First ``n`` by urgency (A64): a distributed take-ordered."""
    return recs.orderBy(*_by_urgency()).limit(n)


def frame_mix(recs: DataFrame) -> DataFrame:
    """Recommendation count per frame shape, NULL shapes dropped."""
    return recs.where(F.col("frame_shape").isNotNull()).groupBy("frame_shape").agg(
        F.count(F.lit(1)).alias("count"))


def treemap(recs: DataFrame, products: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` recommendations (by urgency) with a known shape and
    category (A66)."""
    cat = products.select("sku_id", "category")
    td = (recs.where(F.col("frame_shape").isNotNull()).join(cat, "sku_id", "left")
              .where(F.col("category").isNotNull()))
    return (td.orderBy(*_by_urgency()).limit(n)
              .select("sku_id", "category", "frame_shape", "estimated_cost_usd", "urgency_score"))


def treemap_rollup(tree: DataFrame) -> DataFrame:
    """category > shape > sku hierarchy of buy cost (``rollup``)."""
    return (tree.rollup("category", "frame_shape", "sku_id")
                .agg(F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
                     F.grouping_id().alias("level")))


def product_catalogue(products: DataFrame, active_only: bool = True) -> DataFrame:
    """Products, optionally active only."""
    return products.where(F.col("is_active")) if active_only else products


def sales_history(sales: DataFrame, skus: Sequence[str] | None = None,
                  start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Daily units per SKU for a SKU list (None = all) and an inclusive date
    range, one filtered aggregate instead of a loop over SKUs (A68)."""
    df = sales
    if skus is not None:
        df = df.where(F.col("sku_id").isin(list(skus)))
    if start_date:
        df = df.where(F.col("date") >= F.to_date(F.lit(start_date)))
    if end_date:
        df = df.where(F.col("date") <= F.to_date(F.lit(end_date)))
    return df.groupBy("sku_id", "date").agg(F.sum("quantity_sold").alias("quantity_sold"))


def forecast_lookup(forecast: DataFrame, skus: Sequence[str] | DataFrame) -> DataFrame:
    """Forecast rows of a SKU list (a list, or a DataFrame of ``sku_id``:
    then a semi join) (A69)."""
    if isinstance(skus, DataFrame):
        return forecast.join(skus.select("sku_id").distinct(), "sku_id", "left_semi")
    return forecast.where(F.col("sku_id").isin(list(skus)))


def critical_stock_skus(inventory: DataFrame, threshold: float = 7.0) -> DataFrame:
    """SKUs whose mean days of supply is below the threshold."""
    return (inventory.groupBy("sku_id").agg(F.avg("days_of_supply").alias("days_of_supply"))
                     .where(F.col("days_of_supply") < threshold).select("sku_id"))


def social_bubble(trending: DataFrame, velocity: DataFrame) -> DataFrame:
    """Trending SKUs with their current velocity and momentum."""
    return trending.join(velocity.select("sku_id", "current_velocity", "momentum"), "sku_id", "left")


def top_return_rates(return_rates: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` by return rate (ties by SKU)."""
    return return_rates.orderBy(F.col("return_rate_pct").desc(), "sku_id").limit(n)


def filter_recommendations(recs: DataFrame, urgency: Sequence[str] | None = None,
                           price_points: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    """Filter by urgency bands and price points, the 12 display columns, the
    first ``limit`` rows by urgency, and the total match count (A74)."""
    df = recs
    if urgency:
        df = df.where(F.col("urgency_band").isin(list(urgency)))
    if price_points:
        df = df.where(F.col("price_point").isin(list(price_points)))
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    page = df.orderBy(*_by_urgency()).limit(limit).select(*REC_DISPLAY_COLUMNS)
    return page.crossJoin(total)


def recommendation_detail(recs: DataFrame, sku_id) -> DataFrame:
    """One SKU's recommendation row; empty when unknown (A75).  ``sku_id`` may
    be a literal or a scalar Column."""
    return recs.where(F.col("sku_id") == (sku_id if isinstance(sku_id, F.Column) else F.lit(sku_id)))


def _json_array(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """The first ``n`` rows by ``key`` as one JSON array text (n is small)."""
    top = df.orderBy(F.col(key).desc(), "sku_id").limit(n)
    docs = F.array_sort(F.collect_list(F.struct((-F.col(key)).alias("_k"), F.col("sku_id").alias("_id"),
                                                F.to_json(F.struct(*df.columns)).alias("_j"))))
    return top.agg(F.concat(F.lit("["), F.array_join(F.transform(docs, lambda s: s["_j"]), ","),
                            F.lit("]")).alias(name))


def assistant_context(portfolio: DataFrame, recs: DataFrame, trending: DataFrame) -> DataFrame:
    """One row with the three JSON documents the assistant prompt is built
    from: portfolio summary, top 10 recommendations, top 5 trending (A76)."""
    port = portfolio.select(F.to_json(F.struct(*portfolio.columns)).alias("portfolio_summary"))
    return (port.crossJoin(_json_array(recs, "urgency_score", 10, "top_recommendations"))
                .crossJoin(_json_array(trending, "trend_score", 5, "trending_skus")))


def signal_counts(sales: DataFrame, trending: DataFrame, return_rates: DataFrame,
                  window_days: int = 30) -> DataFrame:
    """Accelerating / decelerating SKU counts, the top trending SKU and the
    problematic-return SKU count (A77)."""
    vel = sales_velocity(sales, window_days).agg(
        F.count_if(F.col("momentum") == "accelerating").alias("accelerating_skus"),
        F.count_if(F.col("momentum") == "decelerating").alias("decelerating_skus"))
    top = trending.agg(F.min_by(F.struct("sku_id", "trend_score"),
                                F.struct(-F.col("trend_score"), F.col("sku_id"))).alias("_t"))
    prob = return_rates.agg(F.count_if(F.col("is_problematic")).alias("problematic_skus"))
    return (vel.crossJoin(top).crossJoin(prob)
               .select("accelerating_skus", "decelerating_skus",
                       F.col("_t.sku_id").alias("top_trending_sku"),
                       F.col("_t.trend_score").alias("top_trend_score"), "problematic_skus"))
