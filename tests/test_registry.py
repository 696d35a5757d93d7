"""Registered queries against their DuckDB oracles on the smallest fixture scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["tl_basel", "tl_decile_statistical", "tl_range_midpoint", "auc_roc", "auc_pr", "psi_pooled", "psi_fixed",
        "population_stability", "missing_profile", "impute", "label_encode", "stratified_split",
        "time_series_splits", "ks_compare", "evaluate_quality", "metric_correlations", "scan_catalog",
        "psi_monitor_stream", "binomial_test_table", "classification_metrics", "iqr_outliers", "knn_minority",
        "cardinality_profile", "correlation_summary", "corr_structure", "psi_pooled"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return _norm(v.item())
    try:
        import pandas as pd
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_contract_shapes():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 80


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", ["tl_basel", "rank_models", "tl_probability_bins", "psi_monitor_stream",
                                  "time_series_splits", "missing_profile"])
def test_types_match_oracle(spark, con, name):
    sp = {f.name: f.dataType.simpleString() for f in entry.queries()[name](spark, SF).schema.fields}
    dd = {r[0]: r[1] for r in con.execute(f"DESCRIBE {entry.oracle_sql()[name]}").fetchall()}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in sp.items()} == dd
