"""Run registered queries in Spark and their SQL in DuckDB, compare results.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 12)
    if hasattr(v, "isoformat"):
        return str(v)[:10] if len(str(v)) >= 10 else str(v)
    if isinstance(v, (bool,)):
        return bool(v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item())
    except Exception:
        pass
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(name: str, spark, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    res = {"name": name}
    t = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    spd = sdf.toPandas()
    res["spark_sec"] = round(time.time() - t, 2)
    res["rows"] = len(spd)
    sql = E.oracle_sql().get(name)
    if sql is None:
        res["status"] = "no-oracle"
        return res
    t = time.time()
    opd = con.sql(sql).df()
    res["duck_sec"] = round(time.time() - t, 2)
    if sorted(spd.columns) != sorted(opd.columns):
        res["status"] = f"COLUMNS spark={sorted(spd.columns)} duck={sorted(opd.columns)}"
        return res
    if len(spd) != len(opd):
        res["status"] = f"ROWCOUNT spark={len(spd)} duck={len(opd)}"
        return res
    a, b = rows_of(spd), rows_of(opd)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES cols={sorted(spd.columns)} first diffs={diffs}"
        return res
    res["status"] = "ok"
    return res


def main(argv):
    from framewise.session import get_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_session(shuffle_partitions=8)
    import __spark_entry__ as E
    con = duck(sf_dir)
    names = names or list(E.queries())
    bad = 0
    for n in names:
        try:
            r = compare(n, spark, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print("FAILED", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv)
