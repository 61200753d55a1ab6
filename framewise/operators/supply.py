"""Supply chain: supplier risk, reorder quantities, cost and material alerts,
health summary (A39-A44)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.expr import (
    clip, conditional_list, right_closed_band, round_half_even, title_case,
)

RISK_EDGES = [0.35, 0.60]
RISK_LABELS = ["low", "medium", "high"]

# Fixed values: (material, country, level) rules of the modelled library.
DEFAULT_MATERIAL_RULES = [
    ("titanium", "China", "high"),
    ("acetate", "Italy", "medium"),
    ("stainless_steel", "China", "medium"),
    ("tr90", "China", "low"),
]

ORDERING_COST = 150.0
UNIT_COST_BASE = 80.0
SAFETY_STOCK_DAYS = 30


def supplier_risk_scores(suppliers: DataFrame) -> DataFrame:
    """risk = clip((1 - reliability)*.40 + capacity*.35 + lead/120*.25, 0, 1),
    4 dp half-even; band right-closed (.35 -> low, .60 -> medium); flags."""
    raw = ((F.lit(1.0) - F.col("reliability_score")) * F.lit(0.40)
           + F.col("capacity_utilization") * F.lit(0.35)
           + (F.col("lead_time_days") / F.lit(120.0)) * F.lit(0.25))
    risk = round_half_even(clip(raw, 0.0, 1.0), 4)
    on_time = (F.col("on_time_delivery_rate") if "on_time_delivery_rate" in suppliers.columns
               else F.lit(1.0))
    return (suppliers.withColumn("risk_score", risk)
                     .withColumn("risk_band", right_closed_band("risk_score", RISK_EDGES, RISK_LABELS))
                     .withColumn("risk_flags", conditional_list([
                         (F.col("reliability_score") < 0.5, "low_reliability"),
                         (F.col("capacity_utilization") > 0.85, "high_capacity"),
                         (F.col("lead_time_days") > 90, "long_lead_time"),
                         (on_time < 0.70, "poor_on_time_delivery"),
                     ])))


def _sales_span_days(sales: DataFrame) -> F.Column:
    """``max(1, (max date - min date).days)`` as a scalar subquery."""
    return sales.select(F.greatest(F.lit(1), F.datediff(F.max("date"), F.min("date")))).scalar()


def reorder_recommendations(inventory: DataFrame, sales: DataFrame, suppliers: DataFrame,
                            product_supplier: DataFrame, forecast: DataFrame | None = None,
                            safety_stock_days: int = SAFETY_STOCK_DAYS) -> DataFrame:
    """EOQ-based reorder list of the SKUs whose cover is below lead time +
    safety stock, with an urgency score.

    Daily rate for cover = units of the last 31 days / 30 (as modelled);
    annual demand = total units / whole-span days * 365.  One aggregate over
    sales gives both; the store-level inventory is summed per SKU.
    """
    m = sales.select(F.max("date")).scalar()
    span = _sales_span_days(sales)
    rates = sales.groupBy("sku_id").agg(
        F.sum(F.when(F.col("date") >= F.date_sub(m, 30), F.col("quantity_sold"))).alias("_recent"),
        F.sum("quantity_sold").alias("_total"),
    ).select(
        "sku_id",
        (F.col("_recent") / F.lit(30.0)).alias("avg_daily_sales"),
        (F.col("_total") / span.cast("double") * F.lit(365.0)).alias("annual_demand"),
    )
    inv = inventory.groupBy("sku_id").agg(
        F.sum("quantity_on_hand").alias("quantity_on_hand"),
        F.sum("quantity_on_order").alias("quantity_on_order"),
        F.avg("days_of_supply").alias("days_of_supply"),
    )
    inv = (inv.join(rates, "sku_id", "left")
              .withColumn("avg_daily_sales", F.coalesce("avg_daily_sales", F.lit(0.1)))
              .withColumn("annual_demand", F.coalesce("annual_demand", F.lit(1.0))))
    ps = product_supplier.select("sku_id", "supplier_id").distinct()
    inv = inv.join(ps, "sku_id", "left")
    sup = (supplier_risk_scores(suppliers)
           .select("supplier_id", "lead_time_days", "risk_band", "capacity_utilization",
                   "avg_unit_cost_multiplier")
           .dropDuplicates(["supplier_id"]))
    inv = (inv.join(sup, "supplier_id", "left")
              .withColumn("lead_time_days", F.coalesce(F.col("lead_time_days").cast("double"), F.lit(60.0))))
    daily = F.col("avg_daily_sales")
    daily_nz = F.when(daily == 0, F.lit(0.1)).otherwise(daily)
    inv = inv.withColumn("days_until_stockout", clip(F.col("quantity_on_hand") / daily_nz, 0.0, 365.0))
    inv = inv.withColumn("trigger", F.col("days_until_stockout") < F.col("lead_time_days") + safety_stock_days)
    inv = inv.withColumn("unit_cost", F.lit(UNIT_COST_BASE) * F.coalesce("avg_unit_cost_multiplier", F.lit(1.0)))
    holding = F.lit(0.25) * F.col("unit_cost")
    holding_nz = F.when(holding == 0, F.lit(1.0)).otherwise(holding)
    eoq = round_half_even(clip(F.sqrt(F.lit(2.0) * F.col("annual_demand") * F.lit(ORDERING_COST) / holding_nz),
                               1.0), 0).cast("int")
    inv = inv.withColumn("eoq", eoq)
    if forecast is not None and "forecasted_demand" in forecast.columns:
        proj = forecast.groupBy("sku_id").agg(F.sum("forecasted_demand").alias("projected_demand_90d"))
        inv = (inv.join(proj, "sku_id", "left")
                  .withColumn("projected_demand_90d",
                              F.coalesce("projected_demand_90d", daily * F.lit(90.0))))
    else:
        inv = inv.withColumn("projected_demand_90d", daily * F.lit(90.0))
    need = F.col("projected_demand_90d") - F.col("quantity_on_hand") - F.col("quantity_on_order")
    inv = inv.withColumn("recommended_order_qty",
                         round_half_even(clip(F.greatest(need, F.col("eoq").cast("double")), 0.0), 0)
                         .cast("int"))
    # scalar max over the SKU rows, attached as one broadcast row
    mx = inv.agg(F.greatest(F.max("avg_daily_sales"), F.lit(0.001)).alias("_mx"))
    inv = inv.crossJoin(F.broadcast(mx))
    urgency = ((F.lit(1.0) - clip(F.col("days_until_stockout") / F.lit(90.0), 0.0, 1.0)) * F.lit(0.5)
               + (daily / F.col("_mx")) * F.lit(0.3)
               + F.col("trigger").cast("double") * F.lit(0.2))
    inv = (inv.withColumn("urgency_score", round_half_even(clip(urgency, 0.0, 1.0), 4))
              .withColumn("estimated_cost", F.col("recommended_order_qty") * F.col("unit_cost")))
    return (inv.where(F.col("trigger"))
               .select("sku_id", "days_until_stockout", "recommended_order_qty",
                       F.col("supplier_id").alias("preferred_supplier"),
                       F.col("risk_band").alias("supplier_risk_band"),
                       "lead_time_days", "estimated_cost", "urgency_score", "eoq"))


def cost_opportunity_alerts(suppliers: DataFrame) -> DataFrame:
    """0-2 alerts per supplier: spare capacity (< 50 %) -> bulk discount,
    saving (.50 - capacity) * 20 (1 dp); payment terms > 60 days -> early
    payment discount 2.5 %.  ``explode`` of a filtered struct array."""
    cap = F.col("capacity_utilization")
    terms = F.col("payment_terms_days")
    bulk = F.when(cap < 0.50, F.struct(
        F.lit("bulk_discount").alias("alert_type"),
        F.concat(F.lit("Capacity at "), F.rint(cap * F.lit(100.0)).cast("bigint").cast("string"),
                 F.lit("% — negotiate bulk pricing")).alias("detail"),
        round_half_even((F.lit(0.50) - cap) * F.lit(20.0), 1).alias("estimated_savings_pct")))
    early = F.when(F.coalesce(terms, F.lit(0)) > 60, F.struct(
        F.lit("early_payment_discount").alias("alert_type"),
        F.concat(F.lit("Payment terms at "), terms.cast("string"),
                 F.lit(" days — early payment likely yields 2-3%")).alias("detail"),
        F.lit(2.5).alias("estimated_savings_pct")))
    alerts = F.filter(F.array(bulk, early), lambda x: x.isNotNull())
    return (suppliers.select("supplier_id", F.coalesce(F.col("name"), F.lit("")).alias("name"),
                             F.explode(alerts).alias("a"))
                     .select("supplier_id", "name", "a.alert_type", "a.detail", "a.estimated_savings_pct"))


def material_rules_frame(spark: SparkSession,
                         rules: Sequence[tuple[str, str, str]] = DEFAULT_MATERIAL_RULES) -> DataFrame:
    """The rule table (a parameter, a handful of rows)."""
    return spark.createDataFrame(list(rules), "material string, country string, risk_level string")


def material_risk_alerts(suppliers: DataFrame, products: DataFrame,
                         rules: Sequence[tuple[str, str, str]] = DEFAULT_MATERIAL_RULES) -> DataFrame:
    """Count SKUs per (material, supplier country) rule; rules with no SKU
    are dropped.  The rule table is broadcast; products are joined to the
    supplier country first (suppliers broadcast when small)."""
    rule_df = material_rules_frame(products.sparkSession, rules)
    sup_country = suppliers.select("supplier_id", "country").distinct()
    merged = products.select("sku_id", "material", "supplier_id").join(sup_country, "supplier_id", "left")
    counted = (merged.join(F.broadcast(rule_df), ["material", "country"], "inner")
                     .groupBy("material", "country", "risk_level")
                     .agg(F.count(F.lit(1)).alias("sku_count")))
    return counted.select(
        "material", "country", "sku_count", "risk_level",
        F.concat(title_case("material"), F.lit(" sourced from "), F.col("country"),
                 F.lit(" — geopolitical concentration risk")).alias("reason"))


def material_risk_pivot(alerts: DataFrame, countries: Sequence[str]) -> DataFrame:
    """material x country matrix of SKU counts (0 fill).  ``countries`` are
    the rule countries, known on the driver, so the pivot needs no extra job."""
    return (alerts.groupBy("material").pivot("country", list(countries))
                  .agg(F.avg(F.col("sku_count").cast("double"))).fillna(0.0))


def capacity_slack_suppliers(suppliers: DataFrame) -> DataFrame:
    """Suppliers with capacity below 50 % (rows, not a collected list)."""
    return suppliers.where(F.col("capacity_utilization") < 0.50).select("supplier_id")


def supply_chain_health(suppliers: DataFrame, inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """One-row health summary.  The list of spare-capacity suppliers grows
    with the supplier table, so it is returned by
    :func:`capacity_slack_suppliers` and only counted here."""
    inv = inventory.groupBy("sku_id").agg(F.avg("days_of_supply").alias("dos"))
    inv_row = inv.agg(
        F.count_if(F.col("dos") < 30).alias("at_risk_sku_count"),
        F.count_if(F.col("dos") < 7).alias("critical_sku_count"),
        F.count_if(F.col("dos") > 180).alias("overstock_sku_count"),
    )
    scored = supplier_risk_scores(suppliers)
    sup_row = scored.agg(
        round_half_even(F.avg("lead_time_days"), 1).alias("avg_lead_time_days"),
        F.count_if(F.col("risk_band") == "high").alias("high_risk_supplier_count"),
        F.count_if(F.col("capacity_utilization") < 0.50).alias("capacity_slack_count"),
        round_half_even(F.avg("on_time_delivery_rate"), 3).alias("on_time_delivery_rate_avg"),
    )
    span = _sales_span_days(sales)
    per_sku = sales.groupBy("sku_id").agg(F.sum("quantity_sold").alias("q"))
    reorder_row = per_sku.agg(round_half_even(
        F.sum(clip(F.col("q") / span.cast("double") * F.lit(60.0), 0.0)) * F.lit(UNIT_COST_BASE), 2)
        .alias("total_reorder_value_usd"))
    return inv_row.crossJoin(sup_row).crossJoin(reorder_row).select(
        "at_risk_sku_count", "critical_sku_count", "avg_lead_time_days", "high_risk_supplier_count",
        "capacity_slack_count", "total_reorder_value_usd", "on_time_delivery_rate_avg",
        "overstock_sku_count")
