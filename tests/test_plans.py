"""What reaches the scan, and how rows are moved."""

import pytest
from pyspark.sql import functions as F

from topiclens.catalog import QUERIES
from topiclens.catalog.standins import bag
from topiclens.operators.corpus import check_band, filter_document_frequency

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scan_reads_needed_columns_and_filters(spark):
    plan = plan_of(QUERIES["table_scan"](spark, SF_DIR))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


def test_bag_is_aggregated_before_the_shuffle(spark):
    plan = plan_of(bag(spark, SF_DIR))
    assert "partial_count" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_fit_is_one_shuffle(spark):
    assert plan_of(QUERIES["fit_rigid"](spark, SF_DIR)).split("(1)")[0].count("Exchange") == 1


def test_no_cross_joins_in_neighbour_queries(spark):
    for name in ("truth_labels", "assign_clusters"):
        assert "Cartesian" not in plan_of(QUERIES[name](spark, SF_DIR))


def test_band_is_exclusive_and_checked(spark):
    stats = spark.createDataFrame([("a", 1), ("b", 5), ("c", 10)], "term STRING, df LONG")
    keep = lambda **k: [r["term"] for r in filter_document_frequency(stats, 10, **k).orderBy("term").collect()]
    assert keep() == ["a", "b"] and keep(hi=None) == ["a", "b", "c"] and keep(lo=0.1, hi=1.0) == ["b"]
    with pytest.raises(ValueError):
        check_band(0.5, 0.5)
    assert stats.filter(F.col("df") > 0).count() == 3
