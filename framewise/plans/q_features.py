"""Registered queries: weekly demand features.

The oracle writes the EWM from its definition, as the weighted sum over all
earlier weeks; the recursion is also checked against a loop in the unit
tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.operators import features as FT
from framewise.plans.registry import register

_HOL = ", ".join(f"'{m:02d}-{d:02d}'" for m, d in FT.HOLIDAYS)
_HOLIDAY = " OR ".join(f"strftime(date + {i}, '%m-%d') IN ({_HOL})" for i in range(7))
_LAGS = ", ".join(f"lag(demand, {n}, 0) OVER w AS lag_{n}w" for n in FT.LAGS)
_ROLL = ", ".join(f"avg(sh) OVER (w ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) AS rolling_mean_{m}w"
                  for m in FT.ROLL_MEANS)


def _a(span: int) -> str:
    return f"{2.0 / (span + 1.0)!r}::DOUBLE"


FEATURE_CTES = [
    ("wk_raw", """SELECT sku_id, CAST(date_trunc('week', date) AS DATE) AS date,
                         CAST(sum(quantity_sold) AS BIGINT) AS demand FROM sales GROUP BY 1, 2"""),
    ("grid", """SELECT sku_id, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date
                FROM (SELECT DISTINCT sku_id FROM wk_raw) s,
                     (SELECT min(date) AS lo, max(date) AS hi FROM wk_raw) b"""),
    ("weekly", """SELECT g.sku_id, g.date, CAST(coalesce(r.demand, 0) AS BIGINT) AS demand,
                         CAST(date_diff('day', (SELECT min(date) FROM wk_raw), g.date) / 7 AS INTEGER) AS idx
                  FROM grid g LEFT JOIN wk_raw r ON g.sku_id = r.sku_id AND g.date = r.date"""),
    ("f1", f"""SELECT *, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
                      CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(year(date) AS INTEGER) AS year,
                      CAST(CASE WHEN {_HOLIDAY} THEN 1 ELSE 0 END AS INTEGER) AS has_holiday_week,
                      {_LAGS}, CAST(lag(demand, 1, 0) OVER w AS DOUBLE) AS sh
               FROM weekly WINDOW w AS (PARTITION BY sku_id ORDER BY date)"""),
    ("f2", f"""SELECT *, sin(2.0::DOUBLE * pi() * month / 12.0::DOUBLE) AS month_sin,
                      cos(2.0::DOUBLE * pi() * month / 12.0::DOUBLE) AS month_cos,
                      sin(2.0::DOUBLE * pi() * week_of_year / 52.0::DOUBLE) AS woy_sin,
                      cos(2.0::DOUBLE * pi() * week_of_year / 52.0::DOUBLE) AS woy_cos,
                      sin(2.0::DOUBLE * pi() * quarter / 4.0::DOUBLE) AS q_sin,
                      cos(2.0::DOUBLE * pi() * quarter / 4.0::DOUBLE) AS q_cos,
                      {_ROLL},
                      coalesce(stddev_samp(sh) OVER (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0.0::DOUBLE)
                        AS rolling_std_13w,
                      max(sh) OVER (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS rolling_max_13w,
                      median(sh) OVER (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS rolling_median_13w,
                      avg(demand) OVER (PARTITION BY sku_id) AS sku_mean_demand,
                      median(demand) OVER (PARTITION BY sku_id) AS sku_median,
                      avg(demand) OVER (PARTITION BY sku_id, month) AS sku_month_mean,
                      avg(demand) OVER (PARTITION BY sku_id, week_of_year) AS sku_woy_mean
               FROM f1 WINDOW w AS (PARTITION BY sku_id ORDER BY date)"""),
    ("ewm_x", """SELECT sku_id, date, idx, CAST(lag(demand, 1, 0) OVER (PARTITION BY sku_id ORDER BY date) AS DOUBLE) AS x FROM weekly"""),
    # the definition: y_t = sum over i <= t of a (1 - a)^(t - i) x_i, term by term
    ("ewm", "SELECT t.sku_id, t.date, " + ", ".join(
        f"coalesce(sum({_a(s)} * pow(1.0::DOUBLE - {_a(s)}, t.idx - i.idx) * i.x), 0.0::DOUBLE) AS ewm_{s}w" for s in FT.EWM_SPANS)
        + " FROM ewm_x t LEFT JOIN (SELECT * FROM ewm_x WHERE x <> 0) i ON i.sku_id = t.sku_id AND i.idx <= t.idx GROUP BY t.sku_id, t.date"),
    ("launch", "SELECT sku_id, launch_date FROM products"),
    ("soc", """SELECT sku_id, CAST(date_trunc('week', week_start) AS DATE) + 7 AS date,
                      avg(trend_index) AS trend_index_lag1w, avg(sentiment_score) AS sentiment_lag1w,
                      CAST(sum(mention_count) AS DOUBLE) AS mention_lag1w
               FROM social_signals GROUP BY 1, 2"""),
    ("fitted", "SELECT s.sku_id, " + ", ".join(f"coalesce(p.{c}, 'unknown') AS {c}" for c in FT.CAT_COLS)
               + " FROM (SELECT DISTINCT sku_id FROM weekly) s LEFT JOIN products p ON s.sku_id = p.sku_id"),
    ("codes_all", "SELECT f.sku_id, " + ", ".join(f"{c}_codes.{c}_enc" for c in FT.CAT_COLS) + " FROM fitted f "
                  + " ".join(f"JOIN {c}_codes ON f.{c} = {c}_codes.{c}" for c in FT.CAT_COLS)),
    ("invf", """SELECT sku_id, avg(days_of_supply) AS days_of_supply,
                       max(CAST(days_of_supply < 7 AS INTEGER)) AS stockout_risk_flag
                FROM inventory GROUP BY sku_id"""),
    ("fm", """
  SELECT f2.*, e.ewm_4w, e.ewm_13w,
         greatest(coalesce(date_diff('day', l.launch_date, f2.date) / 7.0::DOUBLE, 52.0::DOUBLE), 0.0::DOUBLE)
           AS weeks_since_launch,
         ln(1.0::DOUBLE + sku_mean_demand) AS sku_log_mean,
         coalesce(sku_mean_demand / (sku_median + 1e-6::DOUBLE), 1.0::DOUBLE) AS sku_cv,
         coalesce(s.trend_index_lag1w, 50.0::DOUBLE) AS trend_index_lag1w,
         coalesce(s.sentiment_lag1w, 0.6::DOUBLE) AS sentiment_lag1w,
         coalesce(s.mention_lag1w, 100.0::DOUBLE) AS mention_lag1w,
         c.price_point_enc, c.frame_shape_enc, c.material_enc, c.category_enc, c.gender_enc,
         coalesce(i.days_of_supply, 60.0::DOUBLE) AS days_of_supply,
         CAST(coalesce(i.stockout_risk_flag, 0) AS INTEGER) AS stockout_risk_flag
  FROM f2 JOIN ewm e ON f2.sku_id = e.sku_id AND f2.date = e.date
  LEFT JOIN launch l ON f2.sku_id = l.sku_id
  LEFT JOIN soc s ON f2.sku_id = s.sku_id AND f2.date = s.date
  LEFT JOIN codes_all c ON f2.sku_id = c.sku_id
  LEFT JOIN invf i ON f2.sku_id = i.sku_id"""),
    ("fmx", """SELECT *, sku_mean_demand * month_sin AS sku_mean_x_month_sin,
                      sku_mean_demand * woy_sin AS sku_mean_x_woy_sin,
                      sku_log_mean * lag_4w AS sku_log_x_lag4w,
                      sku_month_mean * ewm_4w AS prior_x_ewm4,
                      sku_woy_mean * ewm_13w AS prior_x_ewm13 FROM fm"""),
]
# the per-column code tables are separate CTEs
_FIT = [n for n, _ in FEATURE_CTES].index("fitted") + 1
FEATURE_CTES = FEATURE_CTES[:_FIT] + [(f"{c}_codes", f"SELECT v AS {c}, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER)"
                                    f" AS {c}_enc FROM (SELECT DISTINCT {c} AS v FROM fitted) d")
                                   for c in FT.CAT_COLS] + FEATURE_CTES[_FIT:]

_INT_COLS = {"month", "quarter", "week_of_year", "year", "has_holiday_week", "stockout_risk_flag",
             *[f"{c}_enc" for c in FT.CAT_COLS]}
_BIGINT_COLS = {*[f"lag_{n}w" for n in FT.LAGS]}

STAGES = {
    "weekly_demand": [],
    "calendar_features": ["month", "quarter", "week_of_year", "year", "month_sin", "month_cos", "woy_sin",
                          "woy_cos", "q_sin", "q_cos"],
    "holiday_week_flag": ["has_holiday_week"],
    "weeks_since_launch": ["weeks_since_launch"],
    "lag_features": [f"lag_{n}w" for n in FT.LAGS],
    "rolling_stats": [f"rolling_mean_{w}w" for w in FT.ROLL_MEANS] + ["rolling_std_13w", "rolling_max_13w",
                                                                       "rolling_median_13w"],
    "ewm_features": ["ewm_4w", "ewm_13w"],
    "sku_demand_encoding": ["sku_mean_demand", "sku_log_mean", "sku_cv"],
    "sku_month_prior": ["sku_month_mean"],
    "sku_woy_prior": ["sku_woy_mean"],
    "interaction_features": ["sku_mean_x_month_sin", "sku_mean_x_woy_sin", "sku_log_x_lag4w", "prior_x_ewm4",
                             "prior_x_ewm13"],
    "social_weekly_lag": ["trend_index_lag1w", "sentiment_lag1w", "mention_lag1w"],
    "category_encoding": [f"{c}_enc" for c in FT.CAT_COLS],
    "inventory_features": ["days_of_supply", "stockout_risk_flag"],
    "feature_matrix": FT.FEATURE_COLUMNS,
}


def _stage_builder(name: str, cols: list[str]):
    def build(a):
        sales, products = a.sales_lines, a.products
        if name in ("rolling_stats", "ewm_features"):      # on the SKU's whole array
            series = FT.DemandSeries.of(sales)
            w = FT.rolling_stats(series) if name == "rolling_stats" else FT.ewm_features(series)
            return w.select("sku_id", "date", "demand", *cols)
        if name in ("interaction_features", "feature_matrix"):
            return FT.feature_matrix(sales, products, a.social_signals, a.inventory, columns=cols)
        w = FT.weekly_demand(sales)
        if name == "weekly_demand":
            return w
        if name == "calendar_features":
            w = FT.calendar_features(w)
        elif name == "holiday_week_flag":
            w = FT.holiday_week_flag(w)
        elif name == "weeks_since_launch":
            w = FT.weeks_since_launch(w, products)
        elif name == "lag_features":
            w = FT.lag_features(w)
        elif name == "sku_demand_encoding":
            w = FT.sku_demand_encoding(w)
        elif name == "sku_month_prior":
            w = FT.sku_month_prior(FT.calendar_features(w))
        elif name == "sku_woy_prior":
            w = FT.sku_woy_prior(FT.calendar_features(w))
        elif name == "social_weekly_lag":
            w = FT.social_weekly_lag(w, a.social_signals)
        elif name == "category_encoding":
            w = FT.category_codes(w, products)
        else:  # inventory_features
            w = FT.inventory_features(w, a.inventory)
        return w.select("sku_id", "date", "demand", *cols)
    return build


def _floats(cols: list[str]) -> list[str]:
    return [c for c in cols if c not in _INT_COLS and c not in _BIGINT_COLS]


# The EWM is a sum of exp terms: the two engines' exp/log differ in the last
# ulp, so EWM-derived columns are compared at 8 significant digits.
_EWM_STAGES = {"ewm_features", "interaction_features", "feature_matrix"}

for _name, _cols in STAGES.items():
    register(_name, floats=_floats(_cols), extra=FEATURE_CTES, digits=8 if _name in _EWM_STAGES else 10,
             sql=f"SELECT {', '.join(['sku_id', 'date', 'demand', *_cols])} FROM fmx")(_stage_builder(_name, _cols))


# The codes of one catalogue (all but luxury) applied to another (all): labels not met become -1.
@register("category_encoding_reuse", extra=[
    ("first", "SELECT * FROM products WHERE price_point <> 'luxury' AND frame_shape <> (SELECT max(frame_shape) FROM products)"),
    *[(f"{c}_first", f"SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT coalesce({c}, 'unknown') AS v FROM first)")
      for c in FT.CAT_COLS],
], sql="SELECT p.sku_id, " + ", ".join(f"coalesce({c}_first.code, -1) AS {c}_enc" for c in FT.CAT_COLS) + " FROM products p "
    + " ".join(f"LEFT JOIN {c}_first ON coalesce(p.{c}, 'unknown') = {c}_first.v" for c in FT.CAT_COLS))
def _reuse(a):
    last_shape = a.products.select(F.max("frame_shape")).scalar()
    encoder = FT.CategoryEncoder.fit(a.products.where((F.col("price_point") != "luxury") & (F.col("frame_shape") != last_shape)))
    return encoder.transform(a.products.select("sku_id", *FT.CAT_COLS))
