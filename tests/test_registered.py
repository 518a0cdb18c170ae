"""Registered queries against their SQL on the smallest tables, where those are at hand."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not at hand")
NAMES = [
    "feature_state", "feature_center", "feature_domain", "dataset_summary", "evaluation_report", "outliers_modified_z",
    "outliers_binary_guard", "outliers_grubbs", "impute_mean_mode", "impute_random", "cell_status", "clean_table",
    "corr_pearson", "csv_read", "dedup_headers", "outlier_cells", "bracketed_values", "features_json_read", "curate_events_table", "number_render", "curate_events",
    "csv_files", "jsonl_files", "json_files", "similarity_by_numbers", "impute_by_numbers", "written_report", "similar_lines", "corr_kendall_all", "domain_of_texts",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_names_are_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).count() == len(registry.FEATURES)
