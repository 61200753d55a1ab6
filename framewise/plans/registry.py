"""Query registry: one entry per operator of the build list.

Each :class:`QuerySpec` pairs a Spark builder ``Adapters -> DataFrame`` with
the equivalent DuckDB SQL (over the same views, ``oracle_views``).  Both sides
get the same final projection for comparison:

* double columns rounded to 10 significant digits (half-even) so that a
  different summation order in the two engines does not change the value;
* array columns joined to text (``a,b,c``), map columns to ``k=v`` text with
  keys sorted.

The library functions themselves return full precision and native types;
this projection is applied only here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.expr import sig_round
from framewise.plans.oracle_views import with_views
from framewise.sources.adapters import Adapters


@dataclass
class QuerySpec:
    name: str
    build: Callable[[Adapters], DataFrame]
    sql: str | None = None                   # oracle body, views available as CTEs
    floats: list[str] = field(default_factory=list)   # double columns (for the SQL wrap)
    extra: list[tuple[str, str]] = field(default_factory=list)
    note: str = ""
    digits: int = 10                         # significant digits kept by the comparison projection


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None, floats: list[str] | None = None,
             extra: list[tuple[str, str]] | None = None, note: str = "", digits: int = 10):
    def deco(fn: Callable[[Adapters], DataFrame]):
        REGISTRY[name] = QuerySpec(name, fn, sql, list(floats or []), list(extra or []), note, digits)
        return fn
    return deco


def finalize(df: DataFrame, digits: int = 10) -> DataFrame:
    """Comparison projection (see module docstring)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = sig_round(c, digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, T.MapType):
            c = F.array_join(F.transform(F.array_sort(F.map_entries(c)),
                                         lambda e: F.concat(e["key"].cast("string"), F.lit("="),
                                                            e["value"].cast("string"))), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql_sig_round(col: str, digits: int = 10) -> str:
    q = f'"{col}"'
    e = f"floor(log10(abs({q})))"
    m = f"({digits - 1} - {e})"
    return (f"CASE WHEN {q} IS NULL THEN NULL WHEN {q} = 0 THEN 0.0::DOUBLE "
            f"WHEN {m} >= 0 THEN round_even({q} * pow(10.0, {m}), 0) / pow(10.0, {m}) "
            f"ELSE round_even({q} / pow(10.0, -{m}), 0) * pow(10.0, -{m}) END")


def oracle_text(spec: QuerySpec) -> str:
    body = with_views(spec.sql, spec.extra)
    if not spec.floats:
        return body
    repl = ", ".join(f'{sql_sig_round(c, spec.digits)} AS "{c}"' for c in spec.floats)
    return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) oracle_q"
