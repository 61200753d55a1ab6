"""Registered queries: loading and data quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewise.plans.registry import REGISTRY, register
from framewise.session import checkpoint_dir
from framewise.sources.io import (
    DATASETS, data_quality_nulls, data_quality_profile, data_quality_summary, json_records, load_dataset, load_named, load_report, write_outputs,
)

# first date-typed column whose name contains "date" or "week" (None: no range)
DATE_COLUMNS = {"products": "launch_date", "sales": "date", "inventory": "last_restocked_date",
                "suppliers": None, "returns": "return_date", "social_signals": "week_start"}
SALES_RANGE = ("1995-01-01", "1996-06-30")
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity"]


def _views(a):
    return {n: getattr(a.staged(), n) for n in DATASETS}


@register("load_sales_range", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{SALES_RANGE[0]}' AND DATE '{SALES_RANGE[1]}'""")
def _load(a):
    df = load_dataset(a.t.spark, f"{a.t.sf_dir}/lineitem.parquet", "lineitem", required=LINE_COLUMNS,
                      date_col="l_shipdate", start=SALES_RANGE[0], end=SALES_RANGE[1])
    return df.select(*LINE_COLUMNS)


def _summary_sql() -> str:
    parts = []
    for n in DATASETS:
        d = DATE_COLUMNS[n]
        rng = (f"min(CAST({d} AS DATE)) AS date_min, max(CAST({d} AS DATE)) AS date_max" if d
               else "CAST(NULL AS DATE) AS date_min, CAST(NULL AS DATE) AS date_max")
        dc = f"'{d}'" if d else "CAST(NULL AS VARCHAR)"
        parts.append(f"""SELECT '{n}' AS dataset, count(*) AS row_count,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {n}) x) AS duplicate_count,
       {dc} AS date_column, {rng} FROM {n}""")
    return "\nUNION ALL\n".join(parts)


@register("data_quality_report", sql=_summary_sql())
def _dq(a):
    return data_quality_summary(_views(a))


@register("data_quality_nulls", floats=["null_pct"], sql="\nUNION ALL\n".join(
    f"""SELECT '{n}' AS dataset, "column", null_pct FROM (UNPIVOT (
          SELECT round_even(100.0::DOUBLE * (count(*) - count(COLUMNS(*))) / count(*), 2) FROM {n})
        ON COLUMNS(*) INTO NAME "column" VALUE null_pct) u""" for n in DATASETS))
def _dq_nulls(a):
    return data_quality_nulls(_views(a))


_NULLS_SQL = REGISTRY["data_quality_nulls"].sql


@register("data_quality_profile", floats=["null_pct"], sql=f"""
SELECT s.*, n."column", n.null_pct FROM ({_summary_sql()}) s JOIN ({_NULLS_SQL}) n ON n.dataset = s.dataset""")
def _dq_profile(a):
    return data_quality_profile(_views(a))


_PRODUCT_JSON = [("sku_id", "t"), ("name", "t"), ("frame_shape", "t"), ("material", "t"), ("color", "t"), ("price_point", "t"), ("gender", "t"),
                 ("season_launched", "t"), ("is_active", "b"), ("supplier_id", "t"), ("category", "t"), ("launch_date", "d")]


@register("json_records", sql="SELECT '{' || " + " || ',' || ".join(
    f"""'"{c}":' || """ + {"t": f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')", "b": f"coalesce(CAST({c} AS VARCHAR), 'null')",
                           "d": f"coalesce('\"' || strftime({c}, '%Y-%m-%d') || '\"', 'null')"}[k] for c, k in _PRODUCT_JSON)
          + " || '}' AS record FROM products")
def _json(a):
    return json_records(a.products.select(*[c for c, _ in _PRODUCT_JSON]))


@register("json_records_prices", floats=["cost_price", "retail_price", "half"], sql="""
SELECT sku_id, cost_price, retail_price, retail_price / 2.0::DOUBLE AS half FROM products""")
def _json_prices(a):
    """Doubles, with NaN and infinities, through the JSON text and back."""
    odd = a.products.select("sku_id", "cost_price", "retail_price", (F.col("retail_price") / 2.0).alias("half"),
                            F.lit(float("nan")).alias("nan"), F.lit(float("inf")).alias("inf"))
    back = F.from_json("record", "sku_id string, cost_price double, retail_price double, half double, nan double, inf double")
    return json_records(odd).select(back.alias("r")).where("r.nan is null and r.inf is null") \
        .select("r.sku_id", "r.cost_price", "r.retail_price", "r.half")


_DOUBLES = {"products": ["cost_price", "retail_price"], "sales": ["unit_price"], "inventory": ["days_of_supply"],
            "suppliers": ["reliability_score", "capacity_utilization", "avg_unit_cost_multiplier", "on_time_delivery_rate"],
            "returns": ["refund_amount"], "social_signals": ["sentiment_score"]}


def _written(a, name: str) -> str:
    """The view written through the output writer; suppliers as CSV."""
    fmt = "csv" if name == "suppliers" else "parquet"
    path = f"{checkpoint_dir(a.t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.{fmt}"
    write_outputs(getattr(a, name), path, fmt)
    return path


for _name in DATASETS:
    register(f"load_{_name}", floats=_DOUBLES[_name], sql=f"SELECT * FROM {_name}")(
        lambda a, _name=_name: load_named(a.t.spark, _name, _written(a, _name)))


@register("data_quality_load_report", sql="SELECT *, CAST(NULL AS VARCHAR) AS error FROM (" + "\nUNION ALL\n".join(
    x for x in _summary_sql().split("\nUNION ALL\n") if "'suppliers' AS" in x or "'products' AS" in x) + """) q
UNION ALL SELECT 'returns', NULL, NULL, NULL, NULL, NULL,
  'dataset returns: no column return_date, return_id, return_reason among name, sku_id'""")
def _load_report(a):
    """Two good inputs and one without its required columns."""
    broken = f"{checkpoint_dir(a.t.spark).rstrip('/')}/broken-{uuid.uuid4().hex}.parquet"
    write_outputs(a.products.select("sku_id", "name"), broken)
    return load_report(a.t.spark, {"products": _written(a, "products"), "suppliers": _written(a, "suppliers"), "returns": broken})
