"""Every registered query with a DuckDB twin agrees with it (sf0.001)."""

import pytest

from conftest import SF001
from oracle_harness import compare, duck

import __spark_entry__ as E

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    r = compare(spark, con, SF001, name, E.queries()[name], SQL[name])
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 10 and df.columns == ["nama", "avg_per_m2", "total_data", "trend", "segmen_dom", "catatan"]


@pytest.mark.parametrize("name", sorted(n for n in set(E.queries()) - set(SQL) if not n.startswith(("op", "pipeline"))))
def test_query_without_twin_gives_rows(spark, name):
    # no twin: still over whole tables, with rows and names of their own
    df = E.queries()[name](spark, SF001)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
