"""Registered queries: customer signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.operators import signals as S
from framewise.plans.registry import register
from framewise.plans.sqlparts import clip, momentum_sql, pct_rank_sql, rhe, velocity_full_sql, velocity_sql


def _velocity(window: int):
    def build(a):
        return S.sales_velocity(a.sales_lines, window)
    return build


for _w in (30, 365):
    register(
        "sales_velocity" if _w == 30 else f"sales_velocity_{_w}",
        sql=f"SELECT * FROM ({velocity_full_sql(_w)}) q",
        floats=["velocity_change_pct"],
    )(_velocity(_w))


RR_CTES = [
    ("sold", "SELECT sku_id, CAST(sum(quantity_sold) AS BIGINT) AS total_sold FROM sales GROUP BY sku_id"),
    ("ret", """SELECT sku_id, count(*) AS total_returned,
                      avg(CASE WHEN return_reason = 'quality_issue' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                        AS quality_issue_pct
               FROM returns GROUP BY sku_id"""),
    ("top_reason", """SELECT sku_id, return_reason AS top_return_reason FROM (
                        SELECT sku_id, return_reason,
                               row_number() OVER (PARTITION BY sku_id ORDER BY count(*) DESC, return_reason) rn
                        FROM returns GROUP BY sku_id, return_reason) t WHERE rn = 1"""),
    ("rr", f"""SELECT coalesce(sold.sku_id, ret.sku_id) AS sku_id,
                      CAST(coalesce(total_sold, 0) AS BIGINT) AS total_sold,
                      CAST(coalesce(total_returned, 0) AS BIGINT) AS total_returned,
                      quality_issue_pct,
                      {rhe("coalesce(CAST(coalesce(total_returned, 0) AS DOUBLE) / "
                           "NULLIF(CAST(coalesce(total_sold, 0) AS DOUBLE), 0.0) * 100.0::DOUBLE, 0.0::DOUBLE)", 2)}
                        AS return_rate_pct
               FROM sold FULL OUTER JOIN ret ON sold.sku_id = ret.sku_id"""),
]
RR_SQL = """
SELECT rr.sku_id, total_sold, total_returned, top_return_reason, quality_issue_pct, return_rate_pct,
       return_rate_pct > 15 AS is_problematic,
       coalesce(quality_issue_pct > 0.40::DOUBLE, false) AS quality_flag,
       p.supplier_id
FROM rr LEFT JOIN top_reason t ON rr.sku_id = t.sku_id
LEFT JOIN products p ON rr.sku_id = p.sku_id
"""
RR_FLOATS = ["quality_issue_pct", "return_rate_pct"]


@register("return_rate_analysis", floats=RR_FLOATS, extra=RR_CTES, sql=RR_SQL)
def _return_rate(a):
    return S.return_rate_analysis(a.sales_lines, a.returns, a.products)


TRENDING_CTES = [
    ("recent", "SELECT * FROM social_signals "
               "WHERE week_start >= (SELECT max(week_start) FROM social_signals) - 28"),
    ("sagg", """SELECT sku_id, avg(mention_count) AS mention_count_4wk_avg,
                       avg(sentiment_score) AS sentiment_score,
                       CAST(sum(influencer_mentions) AS BIGINT) AS influencer_mentions
                FROM recent GROUP BY sku_id"""),
    ("vel30", velocity_sql(30)),
    ("merged", """SELECT sagg.*, coalesce(vel30.velocity_change_pct, 0.0::DOUBLE) AS velocity_change_pct
                  FROM sagg LEFT JOIN vel30 ON sagg.sku_id = vel30.sku_id"""),
    ("bounds", """SELECT min(mention_count_4wk_avg) a0, max(mention_count_4wk_avg) a1,
                         min(sentiment_score) b0, max(sentiment_score) b1,
                         min(velocity_change_pct) c0, max(velocity_change_pct) c1,
                         min(influencer_mentions) d0, max(influencer_mentions) d1 FROM merged"""),
    ("scored", f"""SELECT merged.*, {rhe(
        "0.4::DOUBLE * (CASE WHEN a1 = a0 THEN 0.0::DOUBLE ELSE CAST(mention_count_4wk_avg - a0 AS DOUBLE) / (a1 - a0) END)"
        " + 0.3::DOUBLE * (CASE WHEN b1 = b0 THEN 0.0::DOUBLE ELSE CAST(sentiment_score - b0 AS DOUBLE) / (b1 - b0) END)"
        " + 0.2::DOUBLE * (CASE WHEN c1 = c0 THEN 0.0::DOUBLE ELSE CAST(velocity_change_pct - c0 AS DOUBLE) / (c1 - c0) END)"
        " + 0.1::DOUBLE * (CASE WHEN d1 = d0 THEN 0.0::DOUBLE ELSE CAST(influencer_mentions - d0 AS DOUBLE) / (d1 - d0) END)",
        4)} AS trend_score FROM merged, bounds"""),
    ("pgrid", """SELECT g.sku_id, g.platform, CAST(coalesce(sum(r.mention_count), 0) AS BIGINT) AS m
                 FROM (SELECT DISTINCT s.sku_id, p.platform FROM recent s, (SELECT DISTINCT platform FROM recent) p) g
                 LEFT JOIN recent r ON r.sku_id = g.sku_id AND r.platform = g.platform
                 GROUP BY g.sku_id, g.platform"""),
    ("pmap", """SELECT sku_id, string_agg(platform || '=' || CAST(m AS VARCHAR), ',' ORDER BY platform)
                  AS platform_breakdown FROM pgrid GROUP BY sku_id"""),
]


@register("trending_skus", floats=["mention_count_4wk_avg", "sentiment_score", "velocity_change_pct",
                                   "trend_score"], extra=TRENDING_CTES, sql="""
SELECT t.*, pmap.platform_breakdown
FROM (SELECT * FROM scored ORDER BY trend_score DESC, sku_id LIMIT 15) t
LEFT JOIN pmap ON t.sku_id = pmap.sku_id
""")
def _trending(a):
    return S.trending_skus(a.social_signals, a.sales_lines, 15)


@register("platform_breakdown", extra=TRENDING_CTES, sql="SELECT sku_id, platform_breakdown FROM pmap")
def _platform(a):
    return S.platform_breakdown(a.social_signals)


@register("demand_seasonality", floats=["seasonality_index"], sql=f"""
SELECT month, avg(ix) AS seasonality_index FROM (
  SELECT month, {rhe("CAST(q AS DOUBLE) / mean_q", 4)} AS ix FROM (
    SELECT month, q, avg(q) OVER (PARTITION BY sku_id) AS mean_q FROM (
      SELECT sku_id, year(date) AS year, month(date) AS month, CAST(sum(quantity_sold) AS BIGINT) AS q
      FROM sales GROUP BY 1, 2, 3) m) x
  WHERE mean_q > 0) y
GROUP BY month
""")
def _seasonality(a):
    return S.demand_seasonality(a.sales_lines)


def _pref(name: str, row_col: str, col_col: str):
    register(f"pref_{name}", floats=["share"], sql=f"""
SELECT row_value, col_value, quantity, {rhe("CAST(quantity AS DOUBLE) / CAST(rt AS DOUBLE)", 4)} AS share
FROM (SELECT s.{row_col} AS row_value, p.{col_col} AS col_value,
             CAST(sum(s.quantity_sold) AS BIGINT) AS quantity,
             sum(sum(s.quantity_sold)) OVER (PARTITION BY s.{row_col}) AS rt
      FROM sales s LEFT JOIN products p ON s.sku_id = p.sku_id
      WHERE s.{row_col} IS NOT NULL AND p.{col_col} IS NOT NULL
      GROUP BY 1, 2) c
""")(lambda a: S.segment_preference(a.sales, a.products, row_col, col_col))


_pref("age_x_frame", "customer_age_group", "frame_shape")
_pref("gender_x_price", "customer_gender", "price_point")
_pref("channel_x_category", "channel", "category")
_pref("region_x_frame", "region", "frame_shape")


@register("wishlist_demand_proxy", floats=["velocity_change_pct", "velocity_rank", "dos_norm",
                                           "latent_demand_score"], extra=[
    ("vel", velocity_sql(30)),
    ("ranked", f"SELECT vel.*, {momentum_sql()} AS momentum, {pct_rank_sql('current_velocity')} AS velocity_rank FROM vel"),
    ("inv", "SELECT sku_id, avg(days_of_supply) AS dos FROM inventory GROUP BY sku_id"),
    ("invn", f"""SELECT sku_id, {clip("dos / (SELECT greatest(max(dos), 1.0::DOUBLE) FROM inv)", 0.01, 1.0)}
                   AS dos_norm FROM inv"""),
], sql="""
SELECT r.*, coalesce(i.dos_norm, 0.5::DOUBLE) AS dos_norm,
       velocity_rank * (1.0::DOUBLE / coalesce(i.dos_norm, 0.5::DOUBLE)) AS latent_demand_score
FROM ranked r LEFT JOIN invn i ON r.sku_id = i.sku_id
""")
def _wishlist(a):
    return S.wishlist_demand_proxy(a.sales_lines, a.inventory)


__all__ = ["F"]


@register("top_return_rates", floats=RR_FLOATS, extra=RR_CTES + [("rr_full", RR_SQL)],
          sql="SELECT * FROM rr_full ORDER BY return_rate_pct DESC, sku_id LIMIT 20")
def _top_returns(a):
    from framewise.operators import reports as RP
    return RP.top_return_rates(S.return_rate_analysis(a.sales_lines, a.returns, a.products), 20)


@register("social_bubble", floats=["mention_count_4wk_avg", "sentiment_score", "velocity_change_pct",
                                   "trend_score"],
          extra=TRENDING_CTES + [("vel_b", velocity_full_sql(30))], sql="""
SELECT t.*, pmap.platform_breakdown, v.current_velocity, v.momentum
FROM (SELECT * FROM scored ORDER BY trend_score DESC, sku_id LIMIT 15) t
LEFT JOIN pmap ON t.sku_id = pmap.sku_id
LEFT JOIN vel_b v ON t.sku_id = v.sku_id
""")
def _bubble(a):
    from framewise.operators import reports as RP
    return RP.social_bubble(S.trending_skus(a.social_signals, a.sales_lines, 15), S.sales_velocity(a.sales_lines))


@register("signal_counts", floats=["top_trend_score"],
          extra=TRENDING_CTES + RR_CTES + [("rr_full", RR_SQL), ("vel_b", velocity_full_sql(30))], sql="""
SELECT v.accelerating_skus, v.decelerating_skus, t.sku_id AS top_trending_sku, t.trend_score AS top_trend_score,
       p.problematic_skus
FROM (SELECT count_if(momentum = 'accelerating') AS accelerating_skus,
             count_if(momentum = 'decelerating') AS decelerating_skus FROM vel_b) v,
     (SELECT sku_id, trend_score FROM scored ORDER BY trend_score DESC, sku_id LIMIT 1) t,
     (SELECT count_if(is_problematic) AS problematic_skus FROM rr_full) p
""")
def _signal_counts(a):
    from framewise.operators import reports as RP
    return RP.signal_counts(a.sales_lines, S.trending_skus(a.social_signals, a.sales_lines, 15),
                            S.return_rate_analysis(a.sales_lines, a.returns, a.products))
