"""Shared column expressions.

All helpers return ``Column`` expressions built from Spark built-ins, so they
stay inside whole-stage code generation.  Each one exists because the obvious
Spark function gives a different answer from the modelled pandas/numpy code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: ColumnOrName, digits: int = 0) -> Column:
    """numpy / pandas ``round``: half-to-even on ``x * 10**digits``.

    Spark's ``round`` is half-up (``round(2.5) = 3``); ``rint`` is half-even.
    """
    scale = float(10 ** digits)
    if digits == 0:
        return F.rint(_c(c))
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: NULL stays NULL (``greatest``/``least`` skip NULLs)."""
    col = _c(c)
    out = col
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(col.isNull(), F.lit(None)).otherwise(out)


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Division that yields NULL instead of raising (ANSI) when ``b`` is 0."""
    return F.try_divide(_c(a), _c(b))


def right_closed_band(c: ColumnOrName, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut`` with right-closed bins: ``x <= edges[0] -> labels[0]`` ...

    ``edges`` are the inner edges; the last label takes everything above.
    NULL input gives NULL.  (``ml.Bucketizer`` is left-closed: not usable.)
    """
    assert len(labels) == len(edges) + 1
    col = _c(c)
    expr = F.when(col <= F.lit(float(edges[0])), F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:-1]):
        expr = expr.when(col <= F.lit(float(edge)), F.lit(label))
    expr = expr.when(col.isNotNull(), F.lit(labels[-1]))
    return expr


def week_monday(d: ColumnOrName) -> Column:
    """Monday of the ISO week of a date (``date - weekday``, Monday = 0)."""
    col = _c(d)
    return F.date_sub(col, F.weekday(col))


def title_case(c: ColumnOrName) -> Column:
    """Python ``str.title`` for snake-case words: ``stainless_steel`` ->
    ``Stainless_Steel``.  ``initcap`` alone gives ``Stainless_steel``."""
    return F.array_join(F.transform(F.split(_c(c), "_"), lambda w: F.initcap(w)), "_")


def conditional_list(conds: Sequence[tuple[Column, str]]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    arr = F.array(*[F.when(cond, F.lit(label)) for cond, label in conds])
    return F.filter(arr, lambda x: x.isNotNull())


def sig_round(c: ColumnOrName, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (half-even) using only exactly
    rounded IEEE operations, so that two engines that differ in summation
    order produce the same value.  Used by the registered queries' final
    projection, never inside an operator."""
    col = _c(c).cast("double")
    e = F.floor(F.log10(F.abs(col)))
    m = F.lit(digits - 1) - e
    pos = F.rint(col * F.pow(F.lit(10.0), m)) / F.pow(F.lit(10.0), m)
    neg = F.rint(col / F.pow(F.lit(10.0), -m)) * F.pow(F.lit(10.0), -m)
    return (F.when(col.isNull(), F.lit(None).cast("double"))
             .when(col == 0, F.lit(0.0))
             .when(m >= 0, pos)
             .otherwise(neg))
