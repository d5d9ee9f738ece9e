"""Typed tables: Parquet is the format between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """Scan of a table.

    ``spread_by`` names a key over which rows are spread when the table has fewer splits
    than the cluster has cores, as with one small file; a large table is read in place.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by is not None and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, spread_by)
    return df


def read_record_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Import of key/value record files written by Hadoop jobs with plain writable types."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)
