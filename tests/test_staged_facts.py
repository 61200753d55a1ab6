"""Facts summed once, and the one-pass quality profile."""

import os

from pyspark.sql import functions as F

from framewise.plans.q_recommend import buy, portfolio
from framewise.sources.adapters import StagedAdapters, adapters, stage_facts
from framewise.sources.io import data_quality_nulls, data_quality_profile, data_quality_summary


def scans(df, table="lineitem.parquet"):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    files = [f for f in df.inputFiles() if table in f]
    return plan.count("l_orderkey#"), len(files)


def rows(df):
    return sorted(map(str, df.collect()))


def test_buy_list_reads_lines_once(spark, small_dir):
    for build in (buy, portfolio):
        a = adapters(spark, small_dir)
        df = build(a)
        assert scans(df) == (0, 0)              # all that is left reads the cells
        assert a.staged() is a.staged() and a.staged().staged() is a.staged()


def test_staged_views_equal_plain_views(spark, small_dir):
    a = adapters(spark, small_dir)
    s = a.staged()
    for name in ("products", "suppliers", "inventory", "social_signals"):
        assert rows(getattr(a, name)) == rows(getattr(s, name)), name
    total = lambda x: rows(x.sales_lines.groupBy("sku_id", "date").agg(F.sum("quantity_sold").alias("q")))
    assert total(a) == total(s)


def test_cells_with_nulls_repeats_and_hot_part(spark):
    columns = "part bigint, supp bigint, date date, units bigint, lines bigint, returned bigint"
    day = [(1, 1, None, 5, 1, 0), (1, 1, None, None, 1, 1), (None, None, None, None, 1, 0)] + [(7, 2, None, 1, 1, 1)] * 500
    got = {(r.part, r.supp): (r.units, r.lines, r.returned) for r in stage_facts(spark.createDataFrame(day, columns)).collect()}
    assert got == {(1, 1): (5, 2, 1), (None, None): (None, 1, 0), (7, 2): (500, 500, 500)}
    assert stage_facts(spark.createDataFrame([], columns)).count() == 0


def test_profile_against_rows(spark):
    wide = [f"c{i}" for i in range(70)]
    data = [tuple(None if (i * 7 + j) % 5 == 0 else j for j in range(70)) for i in range(5)] * 3 + [(None,) * 70]
    frames = {"wide": spark.createDataFrame(data, ", ".join(f"{c} int" for c in wide)),
              "empty": spark.createDataFrame([], "a int, week_start date"),
              "odd": spark.createDataFrame([(1, None), (None, 1), (None, 1), (None, None)], "`a.b` int, `c d` int")}
    got = data_quality_profile(frames).collect()
    assert len(got) == 70 + 2 + 2
    for name, column, expect in [("odd", "a.b", (4, 1, 75.0)), ("odd", "c d", (4, 1, 50.0)), ("empty", "a", (0, 0, None))]:
        r, = [r for r in got if (r.dataset, r.column) == (name, column)]
        assert (r.row_count, r.duplicate_count, r.null_pct) == expect
    for j in range(70):
        r, = [r for r in got if (r.dataset, r.column) == ("wide", f"c{j}")]
        assert (r.row_count, r.duplicate_count) == (16, 10)
        assert r.null_pct == round(100.0 * sum(x[j] is None for x in data) / 16, 2)
    alone = {(r.dataset, r.column): r.null_pct for r in data_quality_nulls({"wide": frames["wide"], "odd": frames["odd"]}).collect()}
    assert alone == {(r.dataset, r.column): r.null_pct for r in got if r.dataset != "empty"}


def test_profile_reads_each_dataset_once(spark, small_dir):
    df = data_quality_summary({"lines": spark.read.parquet(os.path.join(small_dir, "lineitem.parquet"))})
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1


def test_staged_sales_have_the_columns_of_sums(spark, small_dir):
    s = adapters(spark, small_dir).staged()
    assert isinstance(s, StagedAdapters) and s.sales_lines.columns == ["sku_id", "date", "quantity_sold"]
