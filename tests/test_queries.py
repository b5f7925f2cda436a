"""Registered queries: the driver contract, and Spark vs DuckDB on sf0.001."""

import math
import os

import pytest

from conftest import SF001

ORACLE_SAMPLE = [
    "q5_early_warning", "j3_nway_outer", "a8_attempt_summary", "a2_describe", "f7_missing_policy",
    "p10_extract_gradebook", "t1_pearson_tests", "t4_two_sample_t", "m5_cv_folds", "m17_checkpoints",
    "e2_ridge_permutation", "m10_auc_feature", "w3_contiguous_folds", "a17_kde", "q6_gradebook_extraction",
]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert "risk_score" in df.columns and "entity_id" in df.columns


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_query_matches_oracle(spark, name):
    import duckdb

    import __spark_entry__ as e
    con = duckdb.connect()
    for t in ["customer", "orders", "events", "documents", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    sdf = e.queries()[name](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(e.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, srows) == _rows(dcols, drows)
