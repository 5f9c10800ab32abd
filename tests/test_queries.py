"""Every registered query runs; those with SQL give the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return ""
        try:
            return f"{float(x) + 0.0:.5g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, folder, con, name):
    got, want = entry.queries()[name](spark, folder).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, folder, name):
    entry.queries()[name](spark, folder).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "barloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "barloom.llm" in p.read_text()]
