"""Small SQL text helpers for the DuckDB oracle queries."""

from __future__ import annotations


def rhe(expr: str, digits: int) -> str:
    """numpy-style half-even rounding in DuckDB SQL."""
    if digits == 0:
        return f"round_even(({expr}), 0)"
    s = f"{10 ** digits}.0::DOUBLE"
    return f"(round_even(({expr}) * {s}, 0) / {s})"


def clip(expr: str, lo: float | None = None, hi: float | None = None) -> str:
    out = expr
    if lo is not None:
        out = f"greatest({out}, {float(lo)!r}::DOUBLE)"
    if hi is not None:
        out = f"least({out}, {float(hi)!r}::DOUBLE)"
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE {out} END)"


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def velocity_sql(window_days: int = 30, source: str = "sales") -> str:
    w = window_days
    return f"""
  SELECT sku_id, cur AS current_velocity, prior AS prior_velocity,
         CASE WHEN prior > 0 THEN CAST(cur - prior AS DOUBLE) / prior * 100.0::DOUBLE
              ELSE 0.0::DOUBLE END AS velocity_change_pct
  FROM (SELECT sku_id,
               CAST(coalesce(sum(CASE WHEN date_diff('day', date, mm.m) <= {w} THEN quantity_sold END), 0)
                    AS BIGINT) AS cur,
               CAST(coalesce(sum(CASE WHEN date_diff('day', date, mm.m) > {w} THEN quantity_sold END), 0)
                    AS BIGINT) AS prior
        FROM {source}, (SELECT max(date) AS m FROM {source}) mm
        WHERE date >= mm.m - {2 * w}
        GROUP BY sku_id) v
"""


def momentum_sql(col: str = "velocity_change_pct") -> str:
    return (f"CASE WHEN {col} <= -20.0 THEN 'decelerating' WHEN {col} <= 20.0 THEN 'stable' "
            f"WHEN {col} IS NOT NULL THEN 'accelerating' END")


def velocity_full_sql(window_days: int = 30) -> str:
    return f"SELECT *, {momentum_sql()} AS momentum FROM ({velocity_sql(window_days)}) vv"


def pct_rank_sql(col: str) -> str:
    return (f"((CAST(rank() OVER (ORDER BY {col}) - 1 AS DOUBLE) "
            f"+ CAST(count(*) OVER (PARTITION BY {col}) + 1 AS DOUBLE) / 2.0::DOUBLE) "
            f"/ count(*) OVER ())")
