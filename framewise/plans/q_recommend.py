"""Registered queries: recommendations (A45-A50) and report queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from framewise.operators import features as FT
from framewise.operators import model as M
from framewise.operators import recommend as R
from framewise.operators import reports as RP
from framewise.operators import signals as S
from framewise.operators import similarity as SIM
from framewise.operators import supply as SC
from framewise.plans.q_features import FEATURE_CTES
from framewise.plans import q_signals as _signals  # noqa: F401  (registers trending_skus)
from framewise.plans.q_similarity import TOP_CTES
from framewise.plans.q_supply import REORDER_CTES, REORDER_FLOATS, REORDER_SQL, SCORED_CTE
from framewise.plans.registry import REGISTRY, register
from framewise.plans.sqlparts import clip, pct_rank_sql, rhe, velocity_full_sql


def buy(a, similar=None, forecast=None):
    a = a.staged()
    return R.buy_recommendations(a.inventory, a.suppliers, a.product_supplier, a.products,
                                 a.sales_lines, forecast, similar)


def prior_forecast(a):
    """A forecast without a model: each SKU's mean weekly demand of the same
    ISO week, for the 13 weeks after the last one."""
    series = FT.DemandSeries.of(a.sales_lines)
    return M.week_prior_forecast(FT.weekly_demand(series), 90, last=series.last)


def clearance(a, window=30):
    return R.clearance_alerts(a.inventory, a.products, S.sales_velocity(a.sales_lines, window))


def portfolio(a, recs=None):
    a = a.staged()
    return R.portfolio_summary(buy(a) if recs is None else recs, clearance(a), a.inventory, a.products)


_URG = clip("0.4::DOUBLE * (1.0::DOUBLE - " + clip("days_of_supply / 90.0::DOUBLE", 0.0, 1.0) + ")"
            " + 0.3::DOUBLE * velocity_score"
            " + 0.2::DOUBLE * " + clip("gap / greatest(projected_demand_90d, 0.001::DOUBLE)", 0.0, 1.0)
            + " + 0.1::DOUBLE * (1.0::DOUBLE - reliability_score)", 0.0, 1.0)
_CONF = clip("0.5::DOUBLE + 0.3::DOUBLE * velocity_score + 0.2::DOUBLE * (1.0::DOUBLE - "
             + clip("days_of_supply / 180.0::DOUBLE", 0.0, 1.0) + ")", 0.0, 1.0)
_DRIVERS = ("coalesce(nullif(array_to_string(list_filter(["
            "CASE WHEN velocity_score > 0.7 THEN 'high_velocity' END, "
            "CASE WHEN days_of_supply < 14 THEN 'critical_stock' END, "
            "CASE WHEN gap > 50 THEN 'demand_gap' END, "
            "CASE WHEN reliability_score < 0.6 THEN 'supplier_risk' END], lambda x: x IS NOT NULL)[1:3], ','), ''),"
            " 'standard_replenishment')")

BUY_CTES = [
    SCORED_CTE,
    ("inv_b", """SELECT sku_id, CAST(sum(quantity_on_hand) AS BIGINT) AS qoh,
                        CAST(sum(quantity_on_order) AS BIGINT) AS qoo, avg(days_of_supply) AS days_of_supply
                 FROM inventory GROUP BY sku_id"""),
    ("rates_b", """
  SELECT sku_id,
         CAST(sum(quantity_sold) AS DOUBLE)
           / CAST((SELECT greatest(1, date_diff('day', min(date), max(date))) FROM sales) AS DOUBLE) AS daily,
         CAST(sum(CASE WHEN date >= (SELECT max(date) FROM sales) - 30 THEN quantity_sold END) AS BIGINT) AS v30
  FROM sales GROUP BY sku_id"""),
    ("b1", """SELECT i.sku_id, i.qoh + i.qoo AS current_stock, i.days_of_supply,
                     coalesce(r.daily, 0.1::DOUBLE) AS d, CAST(coalesce(r.v30, 0) AS BIGINT) AS vel30d
              FROM inv_b i LEFT JOIN rates_b r ON i.sku_id = r.sku_id"""),
    ("b2", f"""SELECT *, d * 90.0::DOUBLE AS projected_demand_90d,
                      {clip("d * 90.0::DOUBLE - current_stock", 0.0)} AS gap,
                      CAST({rhe(clip("sqrt(2.0::DOUBLE * (d * 365.0::DOUBLE) * 150.0::DOUBLE / 20.0::DOUBLE)", 1.0), 0)}
                           AS INTEGER) AS eoq
               FROM b1"""),
    ("b3", f"""SELECT *, CAST({rhe("greatest(gap, CAST(eoq AS DOUBLE))", 0)} AS INTEGER) AS recommended_qty,
                      {clip("vel30d / greatest(CAST(max(vel30d) OVER () AS DOUBLE), 0.001::DOUBLE)", 0.0, 1.0)}
                        AS velocity_score
               FROM b2"""),
    ("b4", f"""
  SELECT b3.*, ps.supplier_id AS preferred_supplier,
         coalesce(sc.reliability_score, 0.75::DOUBLE) AS reliability_score,
         coalesce(CAST(sc.lead_time_days AS DOUBLE), 60.0::DOUBLE) AS lead_time_days,
         coalesce(sc.risk_band, 'unknown') AS supplier_risk_band
  FROM b3
  LEFT JOIN (SELECT sku_id, min(supplier_id) AS supplier_id FROM products
             WHERE sku_id IS NOT NULL GROUP BY sku_id) ps ON b3.sku_id = ps.sku_id
  LEFT JOIN scored sc ON ps.supplier_id = sc.supplier_id"""),
    ("b5", f"""
  SELECT b4.*, {rhe(_URG, 4)} AS urgency_score, p.name, p.frame_shape, p.material, p.color, p.price_point,
         coalesce(p.cost_price, 50.0::DOUBLE) AS cost_price, coalesce(p.retail_price, 150.0::DOUBLE) AS retail_price,
         {pct_rank_sql("velocity_score")} AS vel_pct
  FROM b4 LEFT JOIN products p ON b4.sku_id = p.sku_id"""),
    ("buy", f"""
  SELECT sku_id, name, frame_shape, material, color, price_point, current_stock, projected_demand_90d, gap,
         recommended_qty, urgency_score,
         CASE WHEN urgency_score <= 0.25 THEN 'low' WHEN urgency_score <= 0.5 THEN 'medium'
              WHEN urgency_score <= 0.75 THEN 'high' WHEN urgency_score IS NOT NULL THEN 'critical' END
           AS urgency_band,
         {rhe("recommended_qty * cost_price", 2)} AS estimated_cost_usd,
         {rhe("recommended_qty * (retail_price - cost_price) * " + clip("0.5::DOUBLE + 0.4::DOUBLE * vel_pct", 0.3, 0.95), 2)}
           AS estimated_margin_usd,
         coalesce({rhe("(retail_price - cost_price) / NULLIF(retail_price, 0.0::DOUBLE) * 100.0::DOUBLE", 1)},
                  0.0::DOUBLE) AS margin_pct,
         preferred_supplier, supplier_risk_band, lead_time_days,
         {_DRIVERS} AS demand_signal_drivers,
         '' AS similar_alternatives,
         {rhe(_CONF, 4)} AS confidence_score
  FROM b5"""),
]

# The same buy list with the forecast of week priors and with alternatives.
_WEEKLY_CTES = FEATURE_CTES[:[n for n, _ in FEATURE_CTES].index("weekly") + 1]
PRIOR_CTES = _WEEKLY_CTES + [("pf", f"""
  SELECT sku_id, strftime(date, '%Y-%m-%d') AS date, {rhe("x", 2)} AS forecasted_demand,
         {rhe("greatest(x - 0.0::DOUBLE, 0.0::DOUBLE)", 2)} AS lower_bound, {rhe("x + 0.0::DOUBLE", 2)} AS upper_bound
  FROM (SELECT s.sku_id, f.date, coalesce(w.p, s.m) AS x
        FROM (SELECT sku_id, avg(demand) AS m FROM weekly GROUP BY 1) s
        CROSS JOIN (SELECT CAST(unnest(generate_series(max(date) + 7, max(date) + 91, INTERVAL 7 DAY)) AS DATE) AS date FROM weekly) f
        LEFT JOIN (SELECT sku_id, weekofyear(date) AS wk, avg(demand) AS p FROM weekly GROUP BY 1, 2) w
          ON w.sku_id = s.sku_id AND w.wk = weekofyear(f.date)) y""")]


def _with(ctes, **changed):
    return [(n, changed.get(n, body)) for n, body in ctes]


_BUY = dict(BUY_CTES)
_ALTERNATIVES = _BUY["buy"].replace("'' AS similar_alternatives", "coalesce(alts, '') AS similar_alternatives").replace(
    "FROM b5", """FROM b5 LEFT JOIN (SELECT sku_id AS alt_id, string_agg(similar_sku_id, ',' ORDER BY rank) AS alts
                                    FROM top WHERE rank <= 3 GROUP BY sku_id) al ON al.alt_id = b5.sku_id""")
_FORECAST_B2 = (_BUY["b2"].replace("d * 90.0::DOUBLE", "coalesce(proj, d * 90.0::DOUBLE)")
                .replace("FROM b1", """FROM b1 LEFT JOIN (SELECT sku_id AS f_id, sum(forecasted_demand) AS proj FROM pf GROUP BY 1) fs
                                       ON fs.f_id = b1.sku_id"""))
BUY_FLOATS = ["projected_demand_90d", "gap", "urgency_score", "estimated_cost_usd", "estimated_margin_usd",
              "margin_pct", "lead_time_days", "confidence_score"]


@register("buy_recommendations", floats=BUY_FLOATS, extra=BUY_CTES, sql="SELECT * FROM buy")
def _buy(a):
    return buy(a)


def _clearance_ctes(window: int):
    return [("vel_c", velocity_full_sql(window)), ("clear", f"""
  SELECT i.sku_id, p.name AS sku_name, i.days_of_supply, i.quantity_on_hand,
         {rhe("0.25::DOUBLE * coalesce(p.cost_price, 50.0::DOUBLE) * i.quantity_on_hand"
              " * (i.days_of_supply / 365.0::DOUBLE)", 2)} AS carrying_cost_usd,
         md AS recommended_markdown_pct,
         {rhe("i.quantity_on_hand * coalesce(p.retail_price, 150.0::DOUBLE) * (1.0::DOUBLE - md / 100.0::DOUBLE)"
              " * 0.7::DOUBLE", 2)} AS estimated_recovery_usd,
         CASE WHEN i.days_of_supply < 270 THEN 'markdown' ELSE 'liquidate' END AS action
  FROM (SELECT sku_id, avg(days_of_supply) AS days_of_supply, CAST(sum(quantity_on_hand) AS BIGINT) AS quantity_on_hand,
               CASE WHEN avg(days_of_supply) < 180 THEN 15.0::DOUBLE WHEN avg(days_of_supply) < 270 THEN 25.0::DOUBLE
                    ELSE 40.0::DOUBLE END AS md
        FROM inventory GROUP BY sku_id HAVING avg(days_of_supply) > 120) i
  LEFT JOIN products p ON i.sku_id = p.sku_id
  WHERE i.sku_id IN (SELECT sku_id FROM vel_c WHERE momentum = 'decelerating')""")]


CLEAR_FLOATS = ["days_of_supply", "carrying_cost_usd", "recommended_markdown_pct", "estimated_recovery_usd"]
for _w in (30, 365):
    register("clearance_alerts" if _w == 30 else f"clearance_alerts_{_w}", floats=CLEAR_FLOATS,
             extra=_clearance_ctes(_w), sql="SELECT * FROM clear")(lambda a, _w=_w: clearance(a, _w))


@register("allocation_optimizer", extra=[
    ("agg", """SELECT sku_id, sum(quantity_on_hand) AS total_qty, avg(reorder_point) AS rp, count(*) AS n_rows,
                      max(quantity_on_hand) AS max_qty FROM inventory GROUP BY sku_id"""),
    ("fr", """SELECT sku_id, store_id AS from_store_id FROM (
                SELECT sku_id, store_id, row_number() OVER (PARTITION BY sku_id ORDER BY quantity_on_hand DESC,
                                                            store_id) AS rn FROM inventory) x WHERE rn = 1"""),
    ("tt", """SELECT sku_id, store_id AS to_store_id FROM (
                SELECT sku_id, store_id, row_number() OVER (PARTITION BY sku_id ORDER BY quantity_on_hand ASC,
                                                            store_id) AS rn FROM inventory) x WHERE rn = 1"""),
], sql="""
SELECT agg.sku_id, from_store_id, to_store_id,
       greatest(1, CAST(floor(max_qty * 0.25::DOUBLE) AS BIGINT)) AS transfer_qty,
       'Rebalance stock: ' || from_store_id || ' has surplus, ' || to_store_id || ' is below reorder point'
         AS rationale
FROM agg JOIN fr ON agg.sku_id = fr.sku_id JOIN tt ON agg.sku_id = tt.sku_id
WHERE total_qty < rp AND n_rows >= 2
""")
def _alloc(a):
    return R.allocation_optimizer(a.inventory)


PORTFOLIO_CTES = BUY_CTES + _clearance_ctes(30) + [("port", f"""
  SELECT r.*, {rhe("CAST(n_crit AS DOUBLE) * avg_price * 30.0::DOUBLE", 2)} AS projected_revenue_at_risk_usd,
         c.*, o.top_5_opportunities, k.top_5_risks
  FROM (SELECT {rhe("coalesce(sum(estimated_cost_usd), 0.0::DOUBLE)", 2)} AS total_buy_budget_usd,
               count(*) AS total_skus_to_buy, count_if(urgency_band = 'critical') AS critical_skus,
               count_if(urgency_band = 'high') AS high_priority_skus,
               {rhe("coalesce(sum(estimated_margin_usd), 0.0::DOUBLE)", 2)} AS estimated_margin_improvement_usd
        FROM buy) r,
       (SELECT count_if(dos < 7) AS n_crit FROM (SELECT sku_id, avg(days_of_supply) AS dos FROM inventory
                                                 GROUP BY sku_id) x) n,
       (SELECT coalesce(avg(retail_price), 100.0::DOUBLE) AS avg_price FROM products) pr,
       (SELECT {rhe("coalesce(sum(carrying_cost_usd), 0.0::DOUBLE)", 2)} AS overstock_cost_usd,
               count(*) AS overstock_sku_count,
               {rhe("coalesce(sum(estimated_recovery_usd), 0.0::DOUBLE)", 2)} AS capital_freed_if_clearance_usd
        FROM clear) c,
       (SELECT coalesce(string_agg(sku_id, ',' ORDER BY s DESC, sku_id), '') AS top_5_opportunities
        FROM (SELECT sku_id, coalesce(urgency_score, 0.0::DOUBLE) AS s FROM buy
              ORDER BY s DESC, sku_id LIMIT 5) t) o,
       (SELECT coalesce(string_agg(sku_id, ',' ORDER BY s DESC, sku_id), '') AS top_5_risks
        FROM (SELECT sku_id, coalesce(days_of_supply, 0.0::DOUBLE) AS s FROM clear
              ORDER BY s DESC, sku_id LIMIT 5) t) k""")]
PORT_COLS = ("total_buy_budget_usd, total_skus_to_buy, critical_skus, high_priority_skus, "
             "projected_revenue_at_risk_usd, overstock_cost_usd, overstock_sku_count, "
             "estimated_margin_improvement_usd, capital_freed_if_clearance_usd, top_5_opportunities, top_5_risks")
PORT_FLOATS = ["total_buy_budget_usd", "projected_revenue_at_risk_usd", "overstock_cost_usd",
               "estimated_margin_improvement_usd", "capital_freed_if_clearance_usd"]


@register("portfolio_summary", floats=PORT_FLOATS, extra=PORTFOLIO_CTES, sql=f"SELECT {PORT_COLS} FROM port")
def _portfolio(a):
    return portfolio(a)


# ---- report queries ---------------------------------------------------------

@register("overview_kpis", floats=["revenue_at_risk_usd", "overstock_cost_usd"], extra=PORTFOLIO_CTES, sql="""
SELECT i.critical_skus, i.at_risk_skus, port.projected_revenue_at_risk_usd AS revenue_at_risk_usd,
       port.overstock_cost_usd, act.active_skus
FROM (SELECT count_if(dos < 7) AS critical_skus, count_if(dos < 14) AS at_risk_skus
      FROM (SELECT sku_id, avg(days_of_supply) AS dos FROM inventory GROUP BY sku_id) x) i,
     port, (SELECT count_if(is_active) AS active_skus FROM products) act
""")
def _overview(a):
    a = a.staged()
    return RP.overview_kpis(a.inventory, a.products, portfolio(a))


@register("top_recommendations", floats=BUY_FLOATS, extra=BUY_CTES,
          sql="SELECT * FROM buy ORDER BY urgency_score DESC, sku_id LIMIT 15")
def _top15(a):
    return RP.top_recommendations(buy(a), 15)


@register("frame_mix", extra=BUY_CTES,
          sql="SELECT frame_shape, count(*) AS count FROM buy WHERE frame_shape IS NOT NULL GROUP BY frame_shape")
def _frame_mix(a):
    return RP.frame_mix(buy(a))


TREE_CTES = BUY_CTES + [("tree", """
  SELECT b.sku_id, p.category, b.frame_shape, b.estimated_cost_usd, b.urgency_score
  FROM buy b LEFT JOIN products p ON b.sku_id = p.sku_id
  WHERE b.frame_shape IS NOT NULL AND p.category IS NOT NULL
  ORDER BY b.urgency_score DESC, b.sku_id LIMIT 50""")]


@register("treemap", floats=["estimated_cost_usd", "urgency_score"], extra=TREE_CTES, sql="SELECT * FROM tree")
def _treemap(a):
    return RP.treemap(buy(a), a.staged().products, 50)


@register("treemap_rollup", floats=["estimated_cost_usd"], extra=TREE_CTES, sql="""
SELECT category, frame_shape, sku_id, sum(estimated_cost_usd) AS estimated_cost_usd,
       CAST(GROUPING(category, frame_shape, sku_id) AS BIGINT) AS level
FROM tree GROUP BY ROLLUP (category, frame_shape, sku_id)""")
def _treemap_rollup(a):
    return RP.treemap_rollup(RP.treemap(buy(a), a.staged().products, 50))


@register("product_catalogue", floats=["cost_price", "retail_price"],
          sql="SELECT * FROM products WHERE is_active")
def _catalogue(a):
    return RP.product_catalogue(a.products, True)


@register("sales_history", sql="""
SELECT sku_id, date, CAST(sum(quantity_sold) AS BIGINT) AS quantity_sold FROM sales
WHERE date >= DATE '1999-01-01' AND date <= DATE '2001-12-31' GROUP BY sku_id, date""")
def _history(a):
    return RP.sales_history(a.sales_lines, None, "1999-01-01", "2001-12-31")


@register("critical_stock_skus", sql="""
SELECT sku_id FROM inventory GROUP BY sku_id HAVING avg(days_of_supply) < 7""")
def _critical(a):
    return RP.critical_stock_skus(a.inventory)


@register("filter_recommendations", floats=["estimated_cost_usd", "estimated_margin_usd", "margin_pct",
                                            "confidence_score"], extra=BUY_CTES, sql="""
SELECT sku_id, name, frame_shape, urgency_band, recommended_qty, estimated_cost_usd, estimated_margin_usd,
       margin_pct, preferred_supplier, supplier_risk_band, confidence_score, price_point, t.total_count
FROM (SELECT * FROM buy WHERE urgency_band IN ('critical', 'high') AND price_point IN ('premium', 'luxury')
      ORDER BY urgency_score DESC, sku_id LIMIT 100) f,
     (SELECT count(*) AS total_count FROM buy
      WHERE urgency_band IN ('critical', 'high') AND price_point IN ('premium', 'luxury')) t
""")
def _filter(a):
    return RP.filter_recommendations(buy(a), ["critical", "high"], ["premium", "luxury"], 100)


@register("recommendation_detail", floats=BUY_FLOATS, extra=BUY_CTES, sql="""
SELECT * FROM buy WHERE sku_id = (SELECT sku_id FROM buy ORDER BY urgency_score DESC, sku_id LIMIT 1)""")
def _detail(a):
    recs = buy(a)
    top_sku = recs.orderBy(F.col("urgency_score").desc(), "sku_id").limit(1).select("sku_id").scalar()
    return RP.recommendation_detail(recs, top_sku)


@register("assistant_context", note="JSON documents; rows-only check")
def _assistant(a):
    return _context(a)


def _context(a):
    a = a.staged()
    recs = buy(a)
    return RP.assistant_context(portfolio(a, recs), recs, S.trending_skus(a.social_signals, a.sales_lines, 15))


_TREND = REGISTRY["trending_skus"]


def _own(sql: str) -> str:
    """The trend query's names, told apart from those of the buy list."""
    return re.sub(r"\b(" + "|".join(n for n, _ in _TREND.extra) + r")\b", r"trend_\1", sql)


@register("assistant_context_values", floats=["value"], extra=PORTFOLIO_CTES
          + [(_own(n), _own(x)) for n, x in _TREND.extra] + [("trend_q", _own(_TREND.sql))], sql="""
SELECT 'portfolio' AS doc, 1 AS rank, CAST(NULL AS VARCHAR) AS sku_id, total_buy_budget_usd AS value FROM port
UNION ALL SELECT 'recommendation', CAST(row_number() OVER (ORDER BY urgency_score DESC, sku_id) AS INTEGER), sku_id, urgency_score
  FROM (SELECT * FROM buy ORDER BY urgency_score DESC, sku_id LIMIT 10) b
UNION ALL SELECT 'trending', CAST(row_number() OVER (ORDER BY trend_score DESC, sku_id) AS INTEGER), sku_id, trend_score
  FROM (SELECT * FROM trend_q ORDER BY trend_score DESC, sku_id LIMIT 5) t""")
def _context_values(a):
    """The three JSON documents read back, in their order."""
    c = _context(a)
    one = c.select(F.lit("portfolio").alias("doc"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("sku_id"),
                   F.from_json("portfolio_summary", "total_buy_budget_usd double")["total_buy_budget_usd"].alias("value"))
    parts = [c.select(F.posexplode(F.from_json(col, f"array<struct<sku_id:string,{key}:double>>")).alias("i", "r"))
              .select(F.lit(doc).alias("doc"), (F.col("i") + 1).alias("rank"), "r.sku_id", F.col(f"r.{key}").alias("value"))
             for doc, col, key in (("recommendation", "top_recommendations", "urgency_score"), ("trending", "trending_skus", "trend_score"))]
    return one.unionByName(parts[0]).unionByName(parts[1])


@register("similar_alternatives_in_buy", floats=BUY_FLOATS, extra=TOP_CTES + _with(BUY_CTES, buy=_ALTERNATIVES),
          sql="SELECT * FROM buy")
def _buy_alt(a):
    return buy(a, SIM.similar_skus_all(a.products, 3))


@register("prior_forecast", floats=["forecasted_demand", "lower_bound", "upper_bound"], extra=PRIOR_CTES, sql="SELECT * FROM pf")
def _prior(a):
    return prior_forecast(a)


@register("buy_with_forecast", floats=BUY_FLOATS,
          extra=PRIOR_CTES + TOP_CTES + _with(BUY_CTES, b2=_FORECAST_B2, buy=_ALTERNATIVES),
          sql="SELECT * FROM buy")
def _buy_forecast(a):
    return buy(a, SIM.similar_skus_all(a.products, 3), prior_forecast(a))


@register("reorder_with_forecast", floats=REORDER_FLOATS, extra=PRIOR_CTES + _with(REORDER_CTES, k=dict(REORDER_CTES)["k"].replace(
    "d * 90.0::DOUBLE AS projected", "coalesce(proj, d * 90.0::DOUBLE) AS projected").replace(
    "FROM j", "FROM j LEFT JOIN (SELECT sku_id AS f_id, sum(forecasted_demand) AS proj FROM pf GROUP BY 1) fs ON fs.f_id = j.sku_id")),
    sql=REORDER_SQL)
def _reorder_forecast(a):
    return SC.reorder_recommendations(a.inventory, a.sales_lines, a.suppliers, a.product_supplier, prior_forecast(a))
