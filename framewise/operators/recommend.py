"""Recommendations: buy list, clearance, stock transfers, portfolio summary
(A45-A50)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.expr import (
    clip, conditional_list, right_closed_band, round_half_even,
)
from framewise.functions.ranks import avg_tie_pct_rank
from framewise.operators.supply import supplier_risk_scores

# Urgency bands and the costs that order quantities assume.
URGENCY_EDGES = [0.25, 0.50, 0.75]
URGENCY_LABELS = ["low", "medium", "high", "critical"]
ORDERING_COST = 150.0
UNIT_COST_BASE = 80.0

# The columns of the buy list, in order.
BUY_COLUMNS = [
    "sku_id", "name", "frame_shape", "material", "color", "price_point",
    "current_stock", "projected_demand_90d", "gap", "recommended_qty",
    "urgency_score", "urgency_band", "estimated_cost_usd", "estimated_margin_usd",
    "margin_pct", "preferred_supplier", "supplier_risk_band", "lead_time_days",
    "demand_signal_drivers", "similar_alternatives", "confidence_score",
]


def inventory_by_sku(inventory: DataFrame) -> DataFrame:
    """Store rows summed per SKU (one shuffle on ``sku_id``)."""
    return inventory.groupBy("sku_id").agg(
        F.sum("quantity_on_hand").alias("quantity_on_hand"),
        F.sum("quantity_on_order").alias("quantity_on_order"),
        F.avg("days_of_supply").alias("days_of_supply"),
    )


def demand_signal_drivers(velocity_score="velocity_score", days_of_supply="days_of_supply",
                          gap="gap", reliability="reliability_score") -> F.Column:
    """First three triggered drivers, else ``standard_replenishment``."""
    # Thresholds and labels, in order.
    arr = conditional_list([
        (F.col(velocity_score) > 0.7, "high_velocity"),
        (F.col(days_of_supply) < 14, "critical_stock"),
        (F.col(gap) > 50, "demand_gap"),
        (F.col(reliability) < 0.6, "supplier_risk"),
    ])
    return F.when(F.size(arr) == 0, F.array(F.lit("standard_replenishment"))).otherwise(F.slice(arr, 1, 3))


def similar_alternatives(similar: DataFrame, n: int = 3) -> DataFrame:
    """Per SKU the ids of its ``n`` most similar SKUs, best first.
    ``similar`` is the long top-n table of :func:`similarity.similar_skus_all`
    (bounded per SKU), so the collect is bounded by ``n``."""
    top = similar.where(F.col("rank") <= n)
    return top.groupBy("sku_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "similar_sku_id"))),
                    lambda s: s["similar_sku_id"]).alias("similar_alternatives"))


def buy_recommendations(inventory: DataFrame, suppliers: DataFrame, product_supplier: DataFrame,
                        products: DataFrame, sales: DataFrame, forecast: DataFrame | None = None,
                        similar: DataFrame | None = None) -> DataFrame:
    """Urgency-ranked buy list: one row for **every** inventory SKU.

    Inputs are reduced to one row per SKU before any join (inventory sum,
    sales rate, forecast sum), so every join is SKU-grain; suppliers and
    products are dimension joins.  Global scalars (max velocity, whole-span
    days, last sale date) are one-row aggregates.
    """
    inv = inventory_by_sku(inventory).withColumn(
        "current_stock", F.col("quantity_on_hand") + F.col("quantity_on_order"))
    if forecast is not None and "forecasted_demand" in forecast.columns:
        proj = forecast.groupBy("sku_id").agg(F.sum("forecasted_demand").alias("projected_demand_90d"))
        df = inv.join(proj, "sku_id", "left")
    else:
        df = inv.withColumn("projected_demand_90d", F.lit(None).cast("double"))

    span = sales.select(F.greatest(F.lit(1), F.datediff(F.max("date"), F.min("date")))).scalar()
    m = sales.select(F.max("date")).scalar()
    rates = sales.groupBy("sku_id").agg(
        F.sum("quantity_sold").alias("_tot"),
        F.sum(F.when(F.col("date") >= F.date_sub(m, 30), F.col("quantity_sold"))).alias("_v30"),
    ).select("sku_id", (F.col("_tot") / span.cast("double")).alias("_daily"), "_v30")
    df = (df.join(rates, "sku_id", "left")
            .withColumn("avg_daily_sales", F.coalesce("_daily", F.lit(0.1)))
            .withColumn("vel30d", F.coalesce(F.col("_v30"), F.lit(0)))
            .withColumn("projected_demand_90d",
                        F.coalesce("projected_demand_90d", F.col("avg_daily_sales") * F.lit(90.0)))
            .withColumn("gap", clip(F.col("projected_demand_90d") - F.col("current_stock"), 0.0)))
    annual = F.col("avg_daily_sales") * F.lit(365.0)
    holding = max(0.25 * UNIT_COST_BASE, 0.01)
    df = df.withColumn("eoq", round_half_even(
        clip(F.sqrt(F.lit(2.0) * annual * F.lit(ORDERING_COST) / F.lit(holding)), 1.0), 0).cast("int"))
    df = df.withColumn("recommended_qty",
                       round_half_even(F.greatest(F.col("gap"), F.col("eoq").cast("double")), 0).cast("int"))

    mx = df.agg(F.greatest(F.max("vel30d").cast("double"), F.lit(0.001)).alias("_mx"))
    df = (df.crossJoin(F.broadcast(mx))
            .withColumn("velocity_score", clip(F.col("vel30d") / F.col("_mx"), 0.0, 1.0)))

    ps = (product_supplier.where(F.col("sku_id").isNotNull())
          .groupBy("sku_id").agg(F.min("supplier_id").alias("supplier_id")))
    sup = supplier_risk_scores(suppliers).select("supplier_id", "reliability_score", "lead_time_days",
                                                 "risk_band")
    df = (df.join(ps, "sku_id", "left").join(sup, "supplier_id", "left")
            .withColumn("reliability_score", F.coalesce("reliability_score", F.lit(0.75)))
            .withColumn("lead_time_days", F.coalesce(F.col("lead_time_days").cast("double"), F.lit(60.0)))
            .withColumn("supplier_risk_band", F.coalesce("risk_band", F.lit("unknown"))))

    urgency = (F.lit(0.4) * (F.lit(1.0) - clip(F.col("days_of_supply") / F.lit(90.0), 0.0, 1.0))
               + F.lit(0.3) * F.col("velocity_score")
               + F.lit(0.2) * clip(F.col("gap") / F.greatest(F.col("projected_demand_90d"), F.lit(0.001)),
                                   0.0, 1.0)
               + F.lit(0.1) * (F.lit(1.0) - F.col("reliability_score")))
    df = (df.withColumn("urgency_score", round_half_even(clip(urgency, 0.0, 1.0), 4))
            .withColumn("urgency_band", right_closed_band("urgency_score", URGENCY_EDGES, URGENCY_LABELS)))

    meta = products.select("sku_id", "name", "frame_shape", "material", "color", "price_point",
                           "cost_price", "retail_price")
    df = (df.join(meta, "sku_id", "left")
            .withColumn("cost_price", F.coalesce("cost_price", F.lit(50.0)))
            .withColumn("retail_price", F.coalesce("retail_price", F.lit(150.0)))
            .withColumn("estimated_cost_usd", round_half_even(F.col("recommended_qty") * F.col("cost_price"), 2)))

    df = avg_tie_pct_rank(df, "velocity_score", "_vel_pct")
    unit_margin = F.col("retail_price") - F.col("cost_price")
    df = (df.withColumn("sell_through_rate", clip(F.lit(0.50) + F.lit(0.40) * F.col("_vel_pct"), 0.30, 0.95))
            .withColumn("estimated_margin_usd",
                        round_half_even(F.col("recommended_qty") * unit_margin * F.col("sell_through_rate"), 2))
            .withColumn("margin_pct", F.coalesce(
                round_half_even(F.try_divide(unit_margin, F.when(F.col("retail_price") != 0,
                                                                 F.col("retail_price"))) * F.lit(100.0), 1),
                F.lit(0.0)))
            .withColumn("demand_signal_drivers", demand_signal_drivers())
            .withColumn("confidence_score", round_half_even(clip(
                F.lit(0.5) + F.lit(0.3) * F.col("velocity_score")
                + F.lit(0.2) * (F.lit(1.0) - clip(F.col("days_of_supply") / F.lit(180.0), 0.0, 1.0)),
                0.0, 1.0), 4)))
    if similar is not None:
        df = (df.join(similar_alternatives(similar), "sku_id", "left")
                .withColumn("similar_alternatives",
                            F.coalesce("similar_alternatives", F.array().cast("array<string>"))))
    else:
        df = df.withColumn("similar_alternatives", F.array().cast("array<string>"))
    return df.select(*[c if c != "preferred_supplier" else F.col("supplier_id").alias("preferred_supplier")
                       for c in BUY_COLUMNS])


def clearance_alerts(inventory: DataFrame, products: DataFrame, velocity: DataFrame,
                     days_overstock_threshold: int = 120) -> DataFrame:
    """SKUs with mean days of supply above the threshold **and** decelerating
    momentum (semi join), with carrying cost, markdown tier and recovery (A48).
    Without a ``momentum`` column the momentum test is skipped."""
    inv = inventory.groupBy("sku_id").agg(
        F.avg("days_of_supply").alias("days_of_supply"),
        F.sum("quantity_on_hand").alias("quantity_on_hand"),
    ).where(F.col("days_of_supply") > days_overstock_threshold)
    if "momentum" in velocity.columns:
        inv = inv.join(velocity.where(F.col("momentum") == "decelerating").select("sku_id"), "sku_id", "left_semi")
    meta = products.select("sku_id", F.col("name").alias("sku_name"), "cost_price", "retail_price")
    df = (inv.join(meta, "sku_id", "left")
             .withColumn("cost_price", F.coalesce("cost_price", F.lit(50.0)))
             .withColumn("retail_price", F.coalesce("retail_price", F.lit(150.0))))
    dos = F.col("days_of_supply")
    md = F.when(dos < 180, F.lit(15.0)).when(dos < 270, F.lit(25.0)).otherwise(F.lit(40.0))
    return df.select(
        "sku_id", "sku_name", "days_of_supply", "quantity_on_hand",
        round_half_even(F.lit(0.25) * F.col("cost_price") * F.col("quantity_on_hand") * (dos / F.lit(365.0)), 2)
         .alias("carrying_cost_usd"),
        md.alias("recommended_markdown_pct"),
        round_half_even(F.col("quantity_on_hand") * F.col("retail_price") * (F.lit(1.0) - md / F.lit(100.0))
                        * F.lit(0.7), 2).alias("estimated_recovery_usd"),
        F.when(dos < 270, F.lit("markdown")).otherwise(F.lit("liquidate")).alias("action"),
    )


def allocation_optimizer(inventory: DataFrame) -> DataFrame:
    """Stock transfers for SKUs whose total on-hand is below the mean reorder
    point and that are stocked in at least two stores: from the fullest store
    to the emptiest, 25 % of the largest store stock (at least 1) (A49).

    One aggregate per SKU; arg-max/min via ``min_by`` over ``(-qty, store)``
    and ``(qty, store)`` so ties go to the smallest store id.
    """
    agg = inventory.groupBy("sku_id").agg(
        F.sum("quantity_on_hand").alias("total_qty"),
        F.avg("reorder_point").alias("reorder_point"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max("quantity_on_hand").alias("max_qty"),
        F.min_by("store_id", F.struct(-F.col("quantity_on_hand"), F.col("store_id"))).alias("from_store_id"),
        F.min_by("store_id", F.struct(F.col("quantity_on_hand"), F.col("store_id"))).alias("to_store_id"),
    )
    lim = agg.where((F.col("total_qty") < F.col("reorder_point")) & (F.col("n_rows") >= 2))
    return lim.select(
        "sku_id", "from_store_id", "to_store_id",
        F.greatest(F.lit(1), F.floor(F.col("max_qty") * F.lit(0.25)).cast("bigint")).alias("transfer_qty"),
        F.concat(F.lit("Rebalance stock: "), F.col("from_store_id"), F.lit(" has surplus, "),
                 F.col("to_store_id"), F.lit(" is below reorder point")).alias("rationale"),
    )


def _top5_ids(df: DataFrame, score: str) -> DataFrame:
    """Ids of the 5 largest ``score`` values (ties by id): a distributed
    take-ordered first, then a 5-element collect."""
    top = df.select("sku_id", F.coalesce(F.col(score), F.lit(0.0)).alias("_s")) \
            .orderBy(F.col("_s").desc(), "sku_id").limit(5)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_s"), F.col("sku_id")))),
                               lambda s: s["sku_id"]).alias("ids"))


def portfolio_summary(recs: DataFrame, clearance: DataFrame, inventory: DataFrame,
                      products: DataFrame) -> DataFrame:
    """One row of portfolio KPIs (A50): one-row aggregates joined together."""
    r = recs.agg(
        round_half_even(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 2).alias("total_buy_budget_usd"),
        F.count(F.lit(1)).alias("total_skus_to_buy"),
        F.count_if(F.col("urgency_band") == "critical").alias("critical_skus"),
        F.count_if(F.col("urgency_band") == "high").alias("high_priority_skus"),
        round_half_even(F.coalesce(F.sum("estimated_margin_usd"), F.lit(0.0)), 2)
         .alias("estimated_margin_improvement_usd"),
    )
    crit = (inventory.groupBy("sku_id").agg(F.avg("days_of_supply").alias("dos"))
                     .agg(F.count_if(F.col("dos") < 7).alias("_n_crit")))
    price = products.agg(F.coalesce(F.avg("retail_price"), F.lit(100.0)).alias("_avg_price"))
    c = clearance.agg(
        round_half_even(F.coalesce(F.sum("carrying_cost_usd"), F.lit(0.0)), 2).alias("overstock_cost_usd"),
        F.count(F.lit(1)).alias("overstock_sku_count"),
        round_half_even(F.coalesce(F.sum("estimated_recovery_usd"), F.lit(0.0)), 2)
         .alias("capital_freed_if_clearance_usd"),
    )
    t_opp = _top5_ids(recs, "urgency_score").withColumnRenamed("ids", "top_5_opportunities")
    t_risk = _top5_ids(clearance, "days_of_supply").withColumnRenamed("ids", "top_5_risks")
    row = r.crossJoin(crit).crossJoin(price).crossJoin(c).crossJoin(t_opp).crossJoin(t_risk)
    return row.select(
        "total_buy_budget_usd", "total_skus_to_buy", "critical_skus", "high_priority_skus",
        round_half_even(F.col("_n_crit") * F.col("_avg_price") * F.lit(30.0), 2).alias("projected_revenue_at_risk_usd"),
        "overstock_cost_usd", "overstock_sku_count", "estimated_margin_improvement_usd",
        "capital_freed_if_clearance_usd", "top_5_opportunities", "top_5_risks",
    )
