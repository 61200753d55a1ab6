"""Business KPIs: inventory turnover, stock-out rate, overstock cost, GMROI
(A59-A62)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.expr import clip


def inventory_turnover(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """COGS proxy (40 % of revenue) / mean on-hand units per store row, for
    SKUs present in both tables (inner join); a zero denominator gives 0.
    (``period_days`` of the modelled signature is accepted there but unused.)"""
    cogs = sales.groupBy("sku_id").agg(
        (F.sum(F.col("unit_price") * F.col("quantity_sold")) * F.lit(0.40)).alias("cogs"))
    avg_inv = inventory.groupBy("sku_id").agg(F.avg("quantity_on_hand").alias("avg_inventory"))
    j = cogs.join(avg_inv, "sku_id").where(F.col("cogs").isNotNull() & F.col("avg_inventory").isNotNull())
    return j.withColumn("inventory_turnover",
                        F.coalesce(F.try_divide(F.col("cogs"), F.when(F.col("avg_inventory") != 0,
                                                                      F.col("avg_inventory"))), F.lit(0.0)))


def stockout_rate(inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """One row: % of sales rows flagged ``stockout_risk``; without that column
    the % of inventory rows with nothing on hand."""
    if "stockout_risk" in sales.columns:
        return sales.agg(F.coalesce(F.try_divide(F.sum("stockout_risk").cast("double"),
                                                 F.count(F.lit(1)).cast("double")) * F.lit(100.0),
                                    F.lit(0.0)).alias("stockout_rate"))
    return inventory.agg(F.coalesce(F.try_divide(F.count_if(F.col("quantity_on_hand") == 0).cast("double"),
                                                 F.count(F.lit(1)).cast("double")) * F.lit(100.0),
                                    F.lit(0.0)).alias("stockout_rate"))


def overstock_cost(inventory: DataFrame, products: DataFrame, holding_cost_rate: float = 0.25) -> DataFrame:
    """One row: sum over store rows with more than 180 days of supply of
    half the on-hand units x cost (NULL -> 50) x holding rate."""
    j = (inventory.where(F.col("days_of_supply") > 180)
                  .join(products.select("sku_id", "cost_price"), "sku_id", "left"))
    term = (F.col("quantity_on_hand") * F.lit(0.5)) * F.coalesce("cost_price", F.lit(50.0)) \
        * F.lit(float(holding_cost_rate))
    return j.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("overstock_cost"))


def gmroi(sales: DataFrame, inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Gross margin / mean inventory cost per SKU, clipped to [0, 50];
    meets_target when >= 2.  Unit price falls back to retail, cost to 0 for
    the margin and to 50 for the inventory value."""
    meta = products.select("sku_id", "cost_price", "retail_price")
    # lines and store rows are summed per SKU first; prices are constants of a SKU
    # and distribute over the sums, so the joins are SKU-grain and no key is hot
    q, u = F.col("quantity_sold"), F.col("unit_price")
    sold = sales.groupBy("sku_id").agg(
        F.sum(q * u).alias("_priced"), F.sum(F.when(u.isNotNull(), q)).alias("_q_priced"),
        F.sum(F.when(u.isNull(), q)).alias("_q_unpriced"))
    cost0 = F.coalesce("cost_price", F.lit(0.0))
    priced = F.col("_priced") - F.col("_q_priced") * cost0
    unpriced = F.col("_q_unpriced") * (F.col("retail_price") - cost0)
    gm = sold.join(meta, "sku_id", "left").select("sku_id", F.when(
        priced.isNotNull() | unpriced.isNotNull(), F.coalesce(priced, F.lit(0.0)) + F.coalesce(unpriced, F.lit(0.0))).alias("gross_margin"))
    inv = (inventory.groupBy("sku_id").agg(F.avg("quantity_on_hand").alias("_oh")).join(meta.select("sku_id", "cost_price"), "sku_id", "left")
                    .select("sku_id", (F.col("_oh") * F.coalesce("cost_price", F.lit(50.0))).alias("avg_inv_cost")))
    j = gm.join(inv, "sku_id").where(F.col("gross_margin").isNotNull() & F.col("avg_inv_cost").isNotNull())
    g = F.coalesce(F.try_divide(F.col("gross_margin"), F.when(F.col("avg_inv_cost") != 0, F.col("avg_inv_cost"))),
                   F.lit(0.0))
    return (j.withColumn("gmroi", clip(g, 0.0, 50.0))
             .withColumn("meets_target", F.col("gmroi") >= 2.0))
