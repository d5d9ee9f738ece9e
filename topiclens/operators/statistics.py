"""Summary statistics of errors, matches and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclens.spread import group_median, lookup_join


def error_statistics(errors: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, variance, deviation, variance about zero, extremes and exact median per group."""
    v = F.col(value)
    moments = errors.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"),
        F.stddev_pop(v).alias("deviation"), F.avg(v * v).alias("variance0"),
        F.min(v).alias("lowest"), F.max(v).alias("highest"),
    )
    return moments.join(group_median(errors.select(*keys, value), keys, value), keys, "left")


def match_distance(matches: DataFrame) -> DataFrame:
    """Mean and largest distance between the two points of a match, per pair."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    measured = matches.select("pair_id", F.sqrt(dx * dx + dy * dy).alias("d"))
    return measured.groupBy("pair_id").agg(F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"))


def error_slope(errors: DataFrame, keys: list[str], step: str, value: str, width: int) -> DataFrame:
    """Change per step (0 at first) and change over ``width`` steps divided by ``width``.

    ``step`` numbers the errors of a series without gaps, so the earlier value is found by
    an equi-join on the step and no series has to be ordered in one task.
    """
    earlier = lambda n, name: errors.select(
        *keys, (F.col(step) + n).alias(step), F.col(value).alias(name)
    )
    joined = errors.join(earlier(1, "_one"), [*keys, step], "left").join(
        earlier(width, "_wide"), [*keys, step], "left"
    )
    return joined.select(
        *keys, step, value,
        F.coalesce(F.col(value) - F.col("_one"), F.lit(0.0)).alias("slope"),
        ((F.col(value) - F.col("_wide")) / width).alias("wide_slope"),
    )


def feature_size_histogram(features: DataFrame, bins: int) -> DataFrame:
    """Share of features per bin of 28 log2(scale), every bin listed."""
    spark = features.sparkSession
    place = (F.log2("scale") * 28.0).cast("int")
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).alias("bin")
    counts = features.select(at).groupBy("bin").agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("n"))
    filled = counts.unionByName(every).groupBy("bin").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per bin
    return filled.select("bin", "n", (F.col("n") / total).alias("share"))
