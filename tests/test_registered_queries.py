"""Every registered query against its SQL, whole results, exact values."""

import check
import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return check.oracle(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    problem = check.compare(QUERIES[name](spark, sf), duck, SQL[name])
    assert problem == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize(
    "name, key",
    [
        ("sort_asc", lambda r: r.c_nationkey),
        ("sort_desc", lambda r: (-r.revenue, r.l_suppkey)),
        ("sort_multi", lambda r: (r.s_nationkey, -r.s_acctbal, r.s_suppkey)),
    ],
)
def test_sorted_rows_come_in_order(spark, sf, name, key):
    rows = QUERIES[name](spark, sf).collect()
    assert rows == sorted(rows, key=key) and len(rows) > 5


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).columns[0] == "snapshot_date"
