"""Every registered query with an oracle: Spark result == DuckDB SQL result
on the small tables (same comparison as the driver's correctness gate)."""

import pytest

import __spark_entry__ as E
from oracle_compare import duck, rows_of

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(name, spark, small_dir, con):
    spd = E.queries()[name](spark, small_dir).toPandas()
    opd = con.sql(E.oracle_sql()[name]).df()
    assert sorted(spd.columns) == sorted(opd.columns)
    assert len(spd) == len(opd)
    assert rows_of(spd) == rows_of(opd)


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 89


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "sku_id" in df.columns
    assert df.count() >= 0
