"""Every registered query with an SQL twin equals DuckDB on sf0.001."""

import datetime as dt
import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQLS = oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return (4, v.isoformat())
    return (2, str(v))


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "spa" in df.columns


def test_every_query_has_sql_or_is_a_fitted_model():
    rows_only = set(queries()) - set(SQLS)
    rows_only = {n for n in rows_only if n != "pipeline" and not n.startswith("op")}
    assert rows_only <= {"ridge_predictions", "prediction_pairs",
                         "ridge_metrics", "ridge_coefficients", "kmeans_cells", "silhouette", "silhouette_sweep",
                         "cluster_centers", "cluster_summary"}


@pytest.mark.parametrize("name", sorted(n for n in SQLS if n != "pipeline" and not n.startswith("op")))
def test_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    cols = df.columns
    rows = df.collect()
    rel = con.execute(SQLS[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(cols) == sorted(dcols)
    ia = sorted(range(len(cols)), key=lambda i: cols[i])
    ib = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted(tuple(_norm(r[i]) for i in ia) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in ib) for r in drows)
    assert a == b


@pytest.mark.parametrize("name", sorted(n for n in set(queries()) - set(SQLS) if n != "pipeline" and not n.startswith("op")))
def test_model_queries_run(spark, name):
    assert queries()[name](spark, SF).count() >= 0
