"""Registered queries: supply chain."""

from __future__ import annotations

from framewise.operators import supply as SC
from framewise.plans.registry import register
from framewise.plans.sqlparts import clip, rhe

# Rule table for the driver data: four (material, supplier country) pairs
# present in it (the modelled defaults name materials the data lacks).
DRIVER_MATERIAL_RULES = [
    ("standard", "NATION_9", "high"),
    ("economy", "NATION_11", "medium"),
    ("promo", "NATION_6", "medium"),
    ("small", "NATION_19", "low"),
]

RISK_SQL = rhe(clip("(1.0::DOUBLE - reliability_score) * 0.4::DOUBLE + capacity_utilization * 0.35::DOUBLE"
                    " + (lead_time_days / 120.0::DOUBLE) * 0.25::DOUBLE", 0.0, 1.0), 4)

SCORED_CTE = ("scored", f"""
  SELECT *, CASE WHEN risk_score <= 0.35 THEN 'low' WHEN risk_score <= 0.6 THEN 'medium'
                 WHEN risk_score IS NOT NULL THEN 'high' END AS risk_band
  FROM (SELECT *, {RISK_SQL} AS risk_score FROM suppliers) s""")

FLAGS_SQL = ("concat_ws(',', CASE WHEN reliability_score < 0.5 THEN 'low_reliability' END, "
             "CASE WHEN capacity_utilization > 0.85 THEN 'high_capacity' END, "
             "CASE WHEN lead_time_days > 90 THEN 'long_lead_time' END, "
             "CASE WHEN on_time_delivery_rate < 0.7 THEN 'poor_on_time_delivery' END)")

SUPPLIER_FLOATS = ["reliability_score", "capacity_utilization", "avg_unit_cost_multiplier",
                   "on_time_delivery_rate", "risk_score"]


@register("supplier_risk_scores", floats=SUPPLIER_FLOATS, extra=[SCORED_CTE],
          sql=f"SELECT *, {FLAGS_SQL} AS risk_flags FROM scored")
def _risk(a):
    return SC.supplier_risk_scores(a.suppliers)


@register("supplier_risk_table", floats=["reliability_score", "capacity_utilization", "risk_score"],
          extra=[SCORED_CTE], sql="""
SELECT supplier_id, name, country, lead_time_days, reliability_score, capacity_utilization,
       risk_score, risk_band FROM scored""")
def _risk_table(a):
    return SC.supplier_risk_scores(a.suppliers).select(
        "supplier_id", "name", "country", "lead_time_days", "reliability_score",
        "capacity_utilization", "risk_score", "risk_band")


REORDER_CTES = [
    SCORED_CTE,
    ("rates", """
  SELECT sku_id,
         CAST(sum(CASE WHEN date >= (SELECT max(date) FROM sales) - 30 THEN quantity_sold END) AS DOUBLE)
           / 30.0::DOUBLE AS avg_daily_sales,
         CAST(sum(quantity_sold) AS DOUBLE)
           / CAST((SELECT greatest(1, date_diff('day', min(date), max(date))) FROM sales) AS DOUBLE)
           * 365.0::DOUBLE AS annual_demand
  FROM sales GROUP BY sku_id"""),
    ("inv", """SELECT sku_id, CAST(sum(quantity_on_hand) AS BIGINT) AS qoh,
                      CAST(sum(quantity_on_order) AS BIGINT) AS qoo, avg(days_of_supply) AS dos
               FROM inventory GROUP BY sku_id"""),
    ("j", """
  SELECT inv.sku_id, qoh, qoo, coalesce(r.avg_daily_sales, 0.1::DOUBLE) AS d,
         coalesce(r.annual_demand, 1.0::DOUBLE) AS ann, ps.supplier_id, sc.risk_band,
         coalesce(CAST(sc.lead_time_days AS DOUBLE), 60.0::DOUBLE) AS lead_time_days,
         80.0::DOUBLE * coalesce(sc.avg_unit_cost_multiplier, 1.0::DOUBLE) AS unit_cost
  FROM inv LEFT JOIN rates r ON inv.sku_id = r.sku_id
  LEFT JOIN (SELECT DISTINCT sku_id, supplier_id FROM products) ps ON inv.sku_id = ps.sku_id
  LEFT JOIN scored sc ON ps.supplier_id = sc.supplier_id"""),
    ("k", f"""
  SELECT *, {clip("qoh / (CASE WHEN d = 0 THEN 0.1::DOUBLE ELSE d END)", 0.0, 365.0)} AS days_until_stockout,
         CAST({rhe(clip("sqrt(2.0::DOUBLE * ann * 150.0::DOUBLE / (CASE WHEN 0.25::DOUBLE * unit_cost = 0 "
                        "THEN 1.0::DOUBLE ELSE 0.25::DOUBLE * unit_cost END))", 1.0), 0)} AS INTEGER) AS eoq,
         d * 90.0::DOUBLE AS projected,
         greatest(max(d) OVER (), 0.001::DOUBLE) AS mx
  FROM j"""),
    ("l", f"""
  SELECT *, days_until_stockout < lead_time_days + 30 AS trig,
         CAST({rhe(clip("greatest(projected - qoh - qoo, CAST(eoq AS DOUBLE))", 0.0), 0)} AS INTEGER) AS qty
  FROM k"""),
]


REORDER_FLOATS = ["days_until_stockout", "lead_time_days", "estimated_cost", "urgency_score"]
REORDER_SQL = f"""
SELECT sku_id, days_until_stockout, qty AS recommended_order_qty, supplier_id AS preferred_supplier,
       risk_band AS supplier_risk_band, lead_time_days, qty * unit_cost AS estimated_cost,
       {rhe(clip("(1.0::DOUBLE - " + clip("days_until_stockout / 90.0::DOUBLE", 0.0, 1.0) + ") * 0.5::DOUBLE"
                 " + (d / mx) * 0.3::DOUBLE + CAST(trig AS DOUBLE) * 0.2::DOUBLE", 0.0, 1.0), 4)} AS urgency_score,
       eoq
FROM l WHERE trig
"""


@register("reorder_recommendations", floats=REORDER_FLOATS, extra=REORDER_CTES, sql=REORDER_SQL)
def _reorder(a):
    return SC.reorder_recommendations(a.inventory, a.sales_lines, a.suppliers, a.product_supplier)


@register("cost_opportunity_alerts", floats=["estimated_savings_pct"], sql=f"""
SELECT supplier_id, coalesce(name, '') AS name, 'bulk_discount' AS alert_type,
       'Capacity at ' || CAST(CAST(round_even(capacity_utilization * 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR)
         || '% — negotiate bulk pricing' AS detail,
       {rhe("(0.5::DOUBLE - capacity_utilization) * 20.0::DOUBLE", 1)} AS estimated_savings_pct
FROM suppliers WHERE capacity_utilization < 0.5
UNION ALL
SELECT supplier_id, coalesce(name, '') AS name, 'early_payment_discount' AS alert_type,
       'Payment terms at ' || CAST(payment_terms_days AS VARCHAR)
         || ' days — early payment likely yields 2-3%' AS detail,
       2.5::DOUBLE AS estimated_savings_pct
FROM suppliers WHERE coalesce(payment_terms_days, 0) > 60
""")
def _cost_alerts(a):
    return SC.cost_opportunity_alerts(a.suppliers)


_RULES_SQL = "(VALUES " + ", ".join(f"('{m}', '{c}', '{lv}')" for m, c, lv in DRIVER_MATERIAL_RULES) + \
             ") AS rules(material, country, risk_level)"
MATERIAL_CTES = [("alerts", f"""
  SELECT material, country, count(*) AS sku_count, risk_level,
         upper(left(material, 1)) || lower(substr(material, 2)) || ' sourced from ' || country
           || ' — geopolitical concentration risk' AS reason
  FROM (SELECT p.sku_id, p.material, s.country
        FROM products p LEFT JOIN (SELECT DISTINCT supplier_id, country FROM suppliers) s
          ON p.supplier_id = s.supplier_id) m
  JOIN {_RULES_SQL} USING (material, country)
  GROUP BY material, country, risk_level""")]


@register("material_risk_alerts", extra=MATERIAL_CTES, sql="SELECT * FROM alerts")
def _material(a):
    return SC.material_risk_alerts(a.suppliers, a.products, DRIVER_MATERIAL_RULES)


_COUNTRIES = list(dict.fromkeys(c for _, c, _ in DRIVER_MATERIAL_RULES))


@register("material_risk_pivot", floats=_COUNTRIES, extra=MATERIAL_CTES, sql=(
    "SELECT material, " + ", ".join(
        f"coalesce(avg(CASE WHEN country = '{c}' THEN CAST(sku_count AS DOUBLE) END), 0.0::DOUBLE) AS \"{c}\""
        for c in _COUNTRIES) + " FROM alerts GROUP BY material"))
def _material_pivot(a):
    return SC.material_risk_pivot(SC.material_risk_alerts(a.suppliers, a.products, DRIVER_MATERIAL_RULES),
                                  _COUNTRIES)


@register("capacity_slack_suppliers", sql="SELECT supplier_id FROM suppliers WHERE capacity_utilization < 0.5")
def _slack(a):
    return SC.capacity_slack_suppliers(a.suppliers)


@register("supply_chain_health", floats=["avg_lead_time_days", "total_reorder_value_usd",
                                         "on_time_delivery_rate_avg"], extra=[SCORED_CTE], sql=f"""
SELECT i.at_risk_sku_count, i.critical_sku_count, s.avg_lead_time_days, s.high_risk_supplier_count,
       s.capacity_slack_count, r.total_reorder_value_usd, s.on_time_delivery_rate_avg, i.overstock_sku_count
FROM (SELECT count_if(dos < 30) AS at_risk_sku_count, count_if(dos < 7) AS critical_sku_count,
             count_if(dos > 180) AS overstock_sku_count
      FROM (SELECT sku_id, avg(days_of_supply) AS dos FROM inventory GROUP BY sku_id) x) i,
     (SELECT {rhe("avg(lead_time_days)", 1)} AS avg_lead_time_days,
             count_if(risk_band = 'high') AS high_risk_supplier_count,
             count_if(capacity_utilization < 0.5) AS capacity_slack_count,
             {rhe("avg(on_time_delivery_rate)", 3)} AS on_time_delivery_rate_avg FROM scored) s,
     (SELECT {rhe(f"sum({clip('CAST(q AS DOUBLE) / span * 60.0::DOUBLE', 0.0)}) * 80.0::DOUBLE", 2)}
               AS total_reorder_value_usd
      FROM (SELECT sku_id, sum(quantity_sold) AS q FROM sales GROUP BY sku_id) x,
           (SELECT CAST(greatest(1, date_diff('day', min(date), max(date))) AS DOUBLE) AS span FROM sales) y) r
""")
def _health(a):
    return SC.supply_chain_health(a.suppliers, a.inventory, a.sales_lines)
