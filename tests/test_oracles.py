"""Every registered query of the listing engine against its DuckDB SQL, at the smallest scale."""
import glob
import os

import duckdb
import pytest

from adlens.plans import registry

SF = "/root/testdata/sf0.001"


def norm(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    rows = [tuple(None if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_duckdb(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"boosted_trees", "mixture_flags"}))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
