"""Every registered query against its SQL on the smallest tables, if they are there."""

from __future__ import annotations

import glob
import numbers
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def canon(df):
    def cell(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>"):
            return "null"
        if isinstance(v, numbers.Number) and not isinstance(v, bool) and type(v).__name__ != "bool":
            return round(float(v), 9)
        return str(v)

    return sorted((tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    ours = entry.queries()[name](spark, SF)
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours.toPandas()) == canon(theirs)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_flagship(spark):
    assert "impact_score" in entry.entry(spark).columns
