"""Registered queries against DuckDB. All of them with TOPICLENS_ALL_QUERIES=1, else a selection."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
CORE = [
    "vocabulary", "index_documents", "collapsed_documents", "corpus_totals", "vectors_text", "code_map_text", "assign_clusters",
    "update_centers", "label_pixels", "detection_false_alarm", "beta_statistics", "normalize_beta", "truncate_beta", "pixel_gradients",
    "gaussian_blur_mirror", "upsample2", "match_features", "fit_rigid", "error_statistics", "error_slope", "merge_parts",
]
NAMES = list(entry.queries()) if os.environ.get("TOPICLENS_ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
