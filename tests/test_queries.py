"""Every query with a SQL twin gives the twin's rows."""

import glob
import os

import pytest

import __spark_entry__ as entry
from loxo import queries as own

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
if not os.path.isdir(SF):
    pytest.skip("no test tables here", allow_module_level=True)
SQL = own.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is None, isinstance(x, str), 0 if x is None else x) for x in row))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = own.queries()[name](spark, SF)
    r = con.execute(SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = ordered(tuple(row[c] for c in order) for row in df.collect())
    want = ordered(tuple(row[cols.index(c)] for c in order) for row in r.fetchall())
    assert got == want


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reports_scan_few_columns_and_stay_in_the_jvm(spark):
    plan = own.queries()["route_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_repeated_names_can_be_stored(spark, con, tmp_path):
    # The SQL names the class ferry and the mode ferry alike; either engine stores both columns.
    entry.queries()["shape_surface"](spark, SF).write.parquet(f"{tmp_path}/spark")
    con.execute(f"copy ({SQL['shape_surface']}) to '{tmp_path}/duck.parquet'")
    got = con.execute(f"select * from '{tmp_path}/spark/*.parquet' order by all")
    cols, rows = [d[0] for d in got.description], got.fetchall()
    want = con.execute(f"select * from '{tmp_path}/duck.parquet' order by all")
    assert cols == [d[0] for d in want.description] and cols[-2:] == ["ferry_km", "ferry_km_1"]
    assert rows == want.fetchall() and any(r[-1] != r[-2] for r in rows)
