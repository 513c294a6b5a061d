"""Every registered query of the library against its SQL, on the smallest tables, and the shape of the plans."""

import os

import duckdb
import pytest

from sigspark.plans.all import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    def text(v):
        if v is None or v != v:
            return "NULL"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_its_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    """Every query that SQL cannot say starts, gives rows, and the same names as its schema."""
    frame = QUERIES[name](spark, SF)
    rows = frame.collect()
    assert rows and len(set(frame.columns)) == len(frame.columns)


@pytest.mark.parametrize("name", ["cpl_xcorr_window", "cpl_corr_lagged", "ent_sample", "cpl_cross_sample_entropy", "sig_asof_nearest", "sig_segments", "vid_glcm", "surr_shift", "cpl_dcca"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_column_pruning_and_pushdown(spark):
    plan = QUERIES["sig_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type" in plan.split("PushedFilters: ")[1] and "props" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
