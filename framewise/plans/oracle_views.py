"""The adapter views of ``framewise.sources.adapters`` as DuckDB SQL CTEs.

Used only by the correctness oracle (``__spark_entry__.oracle_sql``): each
oracle query is ``WITH <views> <query>``.  Literals with a fraction are cast to
DOUBLE because DuckDB (like Spark SQL) reads ``0.25`` as a DECIMAL.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["sale_bounds"] = """
  SELECT max(CAST(l_shipdate AS DATE)) AS max_d, min(CAST(l_shipdate AS DATE)) AS min_d
  FROM lineitem
"""

VIEWS["sales"] = """
  SELECT 'TXN' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
         'SKU' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS sku_id,
         CAST(l_shipdate AS DATE) AS date,
         'STORE' || lpad(CAST(c_nationkey % 15 AS VARCHAR), 2, '0') AS store_id,
         CAST(trunc(l_quantity) AS BIGINT) AS quantity_sold,
         l_extendedprice / NULLIF(l_quantity, 0) AS unit_price,
         o_orderpriority AS channel,
         c_mktsegment AS customer_age_group,
         CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'other' END
           AS customer_gender,
         r_name AS region,
         CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS INTEGER) AS stockout_risk
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
"""

VIEWS["returns"] = """
  SELECT 'RET' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS return_id,
         'SKU' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS sku_id,
         'TXN' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
         CAST(l_shipdate AS DATE) + CAST(1 + l_orderkey % 29 AS INTEGER) AS return_date,
         CASE l_linenumber % 5 WHEN 0 THEN 'wrong_size' WHEN 1 THEN 'quality_issue'
              WHEN 2 THEN 'style_preference' WHEN 3 THEN 'defective' WHEN 4 THEN 'wrong_item' END
           AS return_reason,
         0.9::DOUBLE * (l_extendedprice / NULLIF(l_quantity, 0)) AS refund_amount,
         (l_linenumber % 2 = 0) AS restocked
  FROM lineitem
  WHERE l_returnflag = 'R'
"""

VIEWS["part_supplier_stats"] = """
  SELECT l_partkey, top_supp, launch_date FROM (
    SELECT l_partkey, l_suppkey AS top_supp,
           min(first_ship) OVER (PARTITION BY l_partkey) AS launch_date,
           row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey ASC) AS rn
    FROM (SELECT l_partkey, l_suppkey, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS q,
                 min(CAST(l_shipdate AS DATE)) AS first_ship
          FROM lineitem GROUP BY l_partkey, l_suppkey) pairs
  ) ranked WHERE rn = 1
"""

VIEWS["products"] = """
  SELECT 'SKU' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS sku_id,
         p_name AS name,
         split_part(p_name, ' ', 2) AS frame_shape,
         lower(p_type) AS material,
         split_part(p_name, ' ', 1) AS color,
         CASE WHEN p_size <= 12 THEN 'budget' WHEN p_size <= 25 THEN 'mid'
              WHEN p_size <= 37 THEN 'premium' WHEN p_size IS NOT NULL THEN 'luxury' END AS price_point,
         CASE p_partkey % 3 WHEN 0 THEN 'men' WHEN 1 THEN 'women' WHEN 2 THEN 'unisex' END AS gender,
         (CASE WHEN month(launch_date) BETWEEN 3 AND 8 THEN 'SS' ELSE 'AW' END)
           || lpad(CAST(year(launch_date) % 100 AS VARCHAR), 2, '0') AS season_launched,
         (p_partkey % 10 < 7) AS is_active,
         CASE WHEN top_supp IS NOT NULL THEN 'SUP' || lpad(CAST(top_supp AS VARCHAR), 12, '0') END
           AS supplier_id,
         p_retailprice * (0.25::DOUBLE + CAST(p_partkey % 21 AS DOUBLE) / 100.0::DOUBLE) AS cost_price,
         p_retailprice AS retail_price,
         CASE p_partkey % 2 WHEN 0 THEN 'sunglasses' WHEN 1 THEN 'optical' END AS category,
         launch_date
  FROM part LEFT JOIN part_supplier_stats ON p_partkey = l_partkey
"""

VIEWS["suppliers"] = """
  SELECT 'SUP' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS supplier_id,
         s_name AS name,
         n_name AS country,
         CAST(30 + (s_suppkey * 37) % 91 AS INTEGER) AS lead_time_days,
         least(greatest((s_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)
           AS reliability_score,
         0.40::DOUBLE + 0.55::DOUBLE * (CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100.0::DOUBLE)
           AS capacity_utilization,
         0.85::DOUBLE + 0.35::DOUBLE * (CAST((s_suppkey * 29) % 100 AS DOUBLE) / 100.0::DOUBLE)
           AS avg_unit_cost_multiplier,
         on_time AS on_time_delivery_rate,
         CAST(50 * (1 + s_suppkey % 6) AS INTEGER) AS min_order_qty,
         CAST(CASE s_suppkey % 5 WHEN 0 THEN 30 WHEN 1 THEN 45 WHEN 2 THEN 60 WHEN 3 THEN 90
                   WHEN 4 THEN 120 END AS INTEGER) AS payment_terms_days
  FROM supplier
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT l_suppkey,
                    avg(CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS on_time
             FROM lineitem GROUP BY l_suppkey) ot ON s_suppkey = ot.l_suppkey
"""

VIEWS["inventory"] = """
  SELECT 'SKU' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS sku_id,
         'STORE' || lpad(CAST(s AS VARCHAR), 2, '0') AS store_id,
         CAST(floor(daily * dos) AS BIGINT) AS quantity_on_hand,
         CAST(greatest(1, floor(daily * 45.0::DOUBLE)) AS BIGINT) AS reorder_point,
         CAST(CASE WHEN dos < 21 THEN floor(daily * 30.0::DOUBLE) ELSE 0 END AS BIGINT) AS quantity_on_order,
         dos AS days_of_supply,
         (SELECT max_d FROM sale_bounds) - CAST((p_partkey + s) % 30 AS INTEGER) AS last_restocked_date,
         'WH-A' || lpad(CAST((p_partkey + s) % 9 + 1 AS VARCHAR), 2, '0') AS warehouse_location
  FROM (
    SELECT p_partkey, s, daily,
           CAST(greatest(1, (p_partkey * 37) % 300 + s - 7) AS DOUBLE) AS dos
    FROM (
      SELECT p_partkey,
             CAST(coalesce(tq, 0) AS DOUBLE)
               / CAST((SELECT greatest(1, date_diff('day', min_d, max_d)) FROM sale_bounds) AS DOUBLE)
               AS daily
      FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(trunc(l_quantity) AS BIGINT)) AS tq
                           FROM lineitem GROUP BY l_partkey) q ON p_partkey = l_partkey
    ) b, range(0, 15) st(s)
  ) g
"""

VIEWS["social_signals"] = """
  SELECT sku_id, week_start, platform,
         mention_count,
         avg_value / 500.0::DOUBLE AS sentiment_score,
         CAST(least(100, mention_count * 10) AS INTEGER) AS trend_index,
         CAST(floor(sum_value) AS BIGINT) AS hashtag_reach,
         CAST(infl AS INTEGER) AS influencer_mentions
  FROM (
    SELECT 'SKU' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS sku_id,
           CAST(date_trunc('week', CAST(ts AS DATE)
                + CAST(date_diff('day', (SELECT max(CAST(ts AS DATE)) FROM events),
                                         (SELECT max_d FROM sale_bounds)) AS INTEGER)) AS DATE)
             AS week_start,
           event_type AS platform,
           count(*) AS mention_count,
           avg(value) AS avg_value,
           sum(value) AS sum_value,
           count_if(value > 400) AS infl
    FROM events
    GROUP BY 1, 2, 3
  ) e
"""

VIEW_ORDER = ["sale_bounds", "sales", "returns", "part_supplier_stats", "products",
              "suppliers", "inventory", "social_signals"]


def with_views(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <all views>, <extra CTEs> <body>``."""
    ctes = [f"{name} AS ({VIEWS[name]})" for name in VIEW_ORDER]
    for name, sql in extra or []:
        ctes.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(ctes) + "\n" + body
