"""Registered queries: demand diagnostics.

The oracle builds the dense SKU x day grid explicitly and uses window lags
and ``corr``, an independent formulation of the closed forms on the Spark
side."""

from __future__ import annotations

from framewise.operators import diagnostics as D
from framewise.plans.registry import register

GRID_CTES = [
    ("cells", "SELECT sku_id, date, sum(quantity_sold) AS q FROM sales GROUP BY 1, 2"),
    ("bnd", "SELECT min(date) AS d_lo, max(date) AS d_hi, date_diff('day', min(date), max(date)) + 1 AS n_days "
            "FROM cells"),
    ("days", "SELECT CAST(unnest(generate_series(d_lo, d_hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bnd"),
    ("grid", """SELECT s.sku_id, d.date, coalesce(c.q, 0) AS q
                FROM (SELECT DISTINCT sku_id FROM cells) s CROSS JOIN days d
                LEFT JOIN cells c ON c.sku_id = s.sku_id AND c.date = d.date"""),
]


@register("describe_quantity", floats=["mean", "std", "min", "p25", "p50", "p75", "max"], sql="""
SELECT count(quantity_sold) AS count, avg(quantity_sold) AS mean, stddev_samp(quantity_sold) AS std,
       CAST(min(quantity_sold) AS DOUBLE) AS min,
       quantile_cont(quantity_sold, 0.25) AS p25, quantile_cont(quantity_sold, 0.5) AS p50,
       quantile_cont(quantity_sold, 0.75) AS p75, CAST(max(quantity_sold) AS DOUBLE) AS max
FROM sales""")
def _describe(a):
    return D.describe_quantity(a.sales_lines)


@register("demand_sparsity", floats=["fill_pct"], extra=GRID_CTES[:2], sql="""
SELECT (SELECT count(DISTINCT sku_id) FROM cells) AS active_skus, d_lo AS start_date, d_hi AS end_date,
       CAST(n_days AS BIGINT) AS n_days,
       CAST((SELECT count(DISTINCT sku_id) FROM cells) * n_days AS BIGINT) AS total_cells,
       (SELECT count(*) FROM cells) AS nonzero_cells,
       (SELECT count(*) FROM cells) * 100.0::DOUBLE / ((SELECT count(DISTINCT sku_id) FROM cells) * n_days)
         AS fill_pct
FROM bnd""")
def _sparsity(a):
    return D.demand_sparsity(a.sales_lines)


SKU_STATS_SQL = """SELECT sku_id, avg(q) AS mean, stddev_samp(q) AS std, CAST(max(q) AS BIGINT) AS max,
       CAST(sum(q) AS BIGINT) AS sum FROM grid GROUP BY sku_id"""


@register("sku_daily_stats", floats=["mean", "std"], extra=GRID_CTES, sql=SKU_STATS_SQL)
def _sku_stats(a):
    return D.sku_daily_stats(a.sales_lines)


@register("sku_daily_stats_summary", floats=["mean", "std", "min", "p25", "p50", "p75", "max"],
          extra=GRID_CTES + [("st", SKU_STATS_SQL)], sql=" UNION ALL ".join(f"""
SELECT '{c}' AS stat, count({c}) AS count, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std,
       min({c}::DOUBLE) AS min, quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50,
       quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c}::DOUBLE) AS max FROM st""" for c in ["mean", "std", "max", "sum"]))
def _sku_stats_summary(a):
    return D.sku_daily_stats_summary(a.sales_lines)


@register("demand_acf", floats=["acf"], extra=GRID_CTES[:3] + [
    ("tot", """SELECT d.date, CAST(coalesce(sum(c.q), 0) AS DOUBLE) AS x
               FROM days d LEFT JOIN cells c ON c.date = d.date GROUP BY d.date"""),
], sql=" UNION ALL ".join(
    f"SELECT {k} AS lag, corr(x, px) AS acf FROM (SELECT x, lag(x, {k}) OVER (ORDER BY date) AS px FROM tot) t"
    for k in D.ACF_LAGS))
def _acf(a):
    return D.demand_acf(a.sales_lines)


@register("sku_acf7", floats=["acf7_mean", "acf7_std"], extra=GRID_CTES + [
    ("lagged", f"""SELECT sku_id, q::DOUBLE AS q,
                          lag(q, {D.SKU_ACF_LAG}) OVER (PARTITION BY sku_id ORDER BY date)::DOUBLE AS pq FROM grid"""),
    ("per", """SELECT sku_id, corr(q, pq) AS r FROM lagged GROUP BY sku_id HAVING stddev_samp(q) > 0"""),
], sql="""SELECT count(r) AS n_skus, avg(r) AS acf7_mean, stddev_pop(r) AS acf7_std FROM per WHERE NOT isnan(r)""")
def _sku_acf(a):
    return D.sku_acf7(a.sales_lines)


@register("month_index", floats=["index"], sql="""
SELECT month, units, units / avg(units) OVER () AS index
FROM (SELECT CAST(month(date) AS INTEGER) AS month, sum(quantity_sold) AS units FROM sales GROUP BY 1) t""")
def _month(a):
    return D.month_index(a.sales_lines)


@register("dow_index", floats=["index"], sql="""
SELECT dow, units, units / avg(units) OVER () AS index
FROM (SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, sum(quantity_sold) AS units FROM sales GROUP BY 1) t""")
def _dow(a):
    return D.dow_index(a.sales_lines)


def _conc_sql() -> str:
    cols = []
    for p in D.CONCENTRATION_PCTS:
        tag = int(round(p * 100))
        k = f"greatest(1, floor(n * {p!r}::DOUBLE))"
        cols.append(f"CAST(max({k}) AS BIGINT) AS top{tag}_k")
        cols.append(f"sum(CASE WHEN rn <= {k} THEN units ELSE 0 END) * 100.0::DOUBLE / max(all_units) "
                    f"AS top{tag}_share_pct")
    cols += [f"sum(CASE WHEN rn > n - {D.BOTTOM_N} THEN units ELSE 0 END) AS bottom{D.BOTTOM_N}_units",
             "max(CASE WHEN rn = 1 THEN sku_id END) AS top_sku", "max(CASE WHEN rn = 1 THEN units END) AS top_units",
             "max(CASE WHEN rn = n THEN sku_id END) AS bottom_sku",
             "max(CASE WHEN rn = n THEN units END) AS bottom_units"]
    return ("SELECT max(n) AS n_skus, " + ", ".join(cols) + """
FROM (SELECT sku_id, units, row_number() OVER (ORDER BY units DESC, sku_id) AS rn,
             count(*) OVER () AS n, sum(units) OVER () AS all_units
      FROM (SELECT sku_id, sum(quantity_sold) AS units FROM sales GROUP BY 1) t) r""")


@register("demand_concentration", floats=[f"top{int(round(p * 100))}_share_pct" for p in D.CONCENTRATION_PCTS],
          sql=_conc_sql())
def _conc(a):
    return D.demand_concentration(a.sales_lines)


def _corr_sql() -> str:
    v = D.SOCIAL_CORR_VARS
    rows = [f"SELECT '{x}' AS var_a, '{x}' AS var_b, 1.0::DOUBLE AS r" for x in v]
    for i, x in enumerate(v):
        for y in v[i + 1:]:
            rows.append(f"SELECT '{x}', '{y}', corr({x}, {y}) FROM m")
            rows.append(f"SELECT '{y}', '{x}', corr({x}, {y}) FROM m")
    return " UNION ALL ".join(rows)


@register("social_sales_corr", floats=["r"], extra=[
    ("sw", """SELECT sku_id, CAST(date_trunc('week', date) AS DATE) AS week,
                     CAST(sum(quantity_sold) AS DOUBLE) AS quantity_sold FROM sales GROUP BY 1, 2"""),
    ("so", """SELECT sku_id, CAST(date_trunc('week', week_start) AS DATE) AS week, avg(trend_index) AS trend_index,
                     avg(mention_count) AS mention_count, avg(sentiment_score) AS sentiment_score
              FROM social_signals GROUP BY 1, 2"""),
    ("m", "SELECT * FROM sw JOIN so USING (sku_id, week)"),
], sql=_corr_sql())
def _social_corr(a):
    return D.social_sales_corr(a.sales_lines, a.social_signals)


@register("feature_demand_corr", floats=["r"], extra=GRID_CTES + [
    ("sm", "SELECT sku_id, avg(q) AS sku_mean FROM grid GROUP BY 1"),
    ("t", """SELECT q::DOUBLE AS q, month(date)::DOUBLE AS month, (isodow(date) - 1)::DOUBLE AS dow,
                    year(date)::DOUBLE AS year, CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS weekend,
                    quarter(date)::DOUBLE AS quarter, sku_mean
             FROM grid JOIN sm USING (sku_id) WHERE q > 0"""),
], sql=" UNION ALL ".join(f"SELECT '{f}' AS feature, corr(q, {f}) AS r FROM t"
                          for f in ["month", "dow", "year", "weekend", "quarter", "sku_mean"]))
def _feat_corr(a):
    return D.feature_demand_corr(a.sales_lines)


@register("zero_day_analysis", floats=["zero_pct", "nonzero_pct", "zero_lag7_zero_pct"], extra=GRID_CTES + [
    ("g7", f"""SELECT q, coalesce(lag(q, {D.SKU_ACF_LAG}) OVER (PARTITION BY sku_id ORDER BY date), 0) AS lag7
               FROM grid"""),
], sql=f"""
SELECT CAST(count(*) FILTER (WHERE q = 0) AS BIGINT) AS zero_days,
       CAST(count(*) FILTER (WHERE q > 0) AS BIGINT) AS nonzero_days,
       count(*) FILTER (WHERE q = 0) * 100.0::DOUBLE / count(*) AS zero_pct,
       count(*) FILTER (WHERE q > 0) * 100.0::DOUBLE / count(*) AS nonzero_pct,
       avg(CASE WHEN lag7 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (WHERE q = 0) * 100.0::DOUBLE
         AS zero_lag7_zero_pct,
       coalesce(avg(CASE WHEN lag7 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (WHERE q = 0), 0)
         > {D.ZERO_PREDICTABLE_SHARE!r} AS predictable
FROM g7""")
def _zero(a):
    return D.zero_day_analysis(a.sales_lines)
