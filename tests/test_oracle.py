"""Each query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from quillon import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = ["profile_numeric", "profile_text", "column_stats", "missing_values", "top_values", "patterns", "outliers_zscore", "corr_pearson", "drift_categorical", "key_composite", "val_email", "val_ssn", "val_luhn", "std_date", "case_change", "currency", "fill_mode", "fill_ffill", "fill_bfill", "onehot", "label_encode", "dedup_last", "load_upsert_changed", "load_scd2", "load_cdc_soft", "load_incr_ts_lookback"]


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return str(v)[:19] if hasattr(v, "isoformat") else float(v) if hasattr(v, "as_tuple") else v


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in data], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()) if not os.environ.get("TEST_QUICK") else QUICK)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    r = duck.sql(registry.oracle_sql()[name])
    assert rows([tuple(x) for x in df.collect()], df.columns) == rows(r.fetchall(), r.columns)
