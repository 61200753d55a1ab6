"""Registered queries: KPI metrics."""

from __future__ import annotations

from framewise.operators import kpis as K
from framewise.plans.registry import register
from framewise.plans.sqlparts import clip


@register("inventory_turnover", floats=["cogs", "avg_inventory", "inventory_turnover"], sql="""
SELECT c.sku_id, c.cogs, i.avg_inventory,
       coalesce(c.cogs / NULLIF(i.avg_inventory, 0.0::DOUBLE), 0.0::DOUBLE) AS inventory_turnover
FROM (SELECT sku_id, sum(unit_price * quantity_sold) * 0.4::DOUBLE AS cogs FROM sales GROUP BY sku_id) c
JOIN (SELECT sku_id, avg(quantity_on_hand) AS avg_inventory FROM inventory GROUP BY sku_id) i
  ON c.sku_id = i.sku_id
WHERE c.cogs IS NOT NULL AND i.avg_inventory IS NOT NULL
""")
def _turnover(a):
    return K.inventory_turnover(a.sales_lines, a.inventory)


@register("stockout_rate", floats=["stockout_rate"], sql="""
SELECT coalesce(CAST(sum(stockout_risk) AS DOUBLE) / NULLIF(CAST(count(*) AS DOUBLE), 0.0::DOUBLE)
                * 100.0::DOUBLE, 0.0::DOUBLE) AS stockout_rate
FROM sales
""")
def _stockout(a):
    return K.stockout_rate(a.inventory, a.sales_risk)


@register("overstock_cost", floats=["overstock_cost"], sql="""
SELECT coalesce(sum((i.quantity_on_hand * 0.5::DOUBLE) * coalesce(p.cost_price, 50.0::DOUBLE) * 0.25::DOUBLE),
                0.0::DOUBLE) AS overstock_cost
FROM inventory i LEFT JOIN products p ON i.sku_id = p.sku_id
WHERE i.days_of_supply > 180
""")
def _overstock(a):
    return K.overstock_cost(a.inventory, a.products)


@register("gmroi", floats=["gross_margin", "avg_inv_cost", "gmroi"], sql=f"""
SELECT g.sku_id, g.gross_margin, v.avg_inv_cost,
       {clip("coalesce(g.gross_margin / NULLIF(v.avg_inv_cost, 0.0::DOUBLE), 0.0::DOUBLE)", 0.0, 50.0)} AS gmroi,
       {clip("coalesce(g.gross_margin / NULLIF(v.avg_inv_cost, 0.0::DOUBLE), 0.0::DOUBLE)", 0.0, 50.0)} >= 2.0
         AS meets_target
FROM (SELECT s.sku_id, sum(s.quantity_sold * (coalesce(s.unit_price, p.retail_price)
                                              - coalesce(p.cost_price, 0.0::DOUBLE))) AS gross_margin
      FROM sales s LEFT JOIN products p ON s.sku_id = p.sku_id GROUP BY s.sku_id) g
JOIN (SELECT i.sku_id, avg(i.quantity_on_hand * coalesce(p.cost_price, 50.0::DOUBLE)) AS avg_inv_cost
      FROM inventory i LEFT JOIN products p ON i.sku_id = p.sku_id GROUP BY i.sku_id) v
  ON g.sku_id = v.sku_id
WHERE g.gross_margin IS NOT NULL AND v.avg_inv_cost IS NOT NULL
""")
def _gmroi(a):
    return K.gmroi(a.sales_lines, a.inventory, a.products)
