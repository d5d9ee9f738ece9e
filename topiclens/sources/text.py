"""Text formats: lines, vectors, code-map dumps and colour maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclens.session import cut_lineage
from topiclens.spread import running_total

CODE_ENTRY = r"\((\d+), (\d+)\)=(\d+)"  # fixed value: one ``(x, y)=code`` entry of a dump
COLOR_ENTRY = r"^\(([^,()]+),([^,()]+)\)$"  # fixed value: one ``(key,value)`` line


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of a text column, other columns kept."""
    return df.withColumn("line", F.explode(F.split(F.col(text), "\n"))).drop(text)


def read_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated doubles, one vector per line; ``vec_id`` is the line number from 1.

    Lines are numbered by file, split and position in the split, which is reading order.
    The scan hands large splits out first, so partition number alone is not that order.
    """
    at = F.monotonically_increasing_id()
    lines = cut_lineage(
        spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            at.alias("at"),
        )
    )
    order = [F.col("file"), F.col("block"), F.col("at")]
    numbered = running_total(lines, order, F.lit(1), "before")
    return numbered.select((F.col("before") + 1).alias("vec_id"), parse_vector("value").alias("vec"))


def parse_vector(text: str) -> F.Column:
    parts = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast("double"))


def parse_code_map(df: DataFrame, line: str = "line") -> DataFrame:
    """Rows ``image_id, x, y, code`` from ``id \\t {(x, y)=code, ...}`` lines."""
    found = lambda group: F.regexp_extract_all(
        F.col(line), F.lit(CODE_ENTRY), F.lit(group)
    )
    entries = F.arrays_zip(found(1).alias("x"), found(2).alias("y"), found(3).alias("code"))
    keyed = df.filter(F.col(line).contains("\t")).select(
        F.split(F.col(line), "\t")[0].cast("int").alias("image_id"),
        F.explode(entries).alias("e"),
    )
    return keyed.select("image_id", *(F.col(f"e.{c}").cast("int").alias(c) for c in ("x", "y", "code")))


def read_code_map_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_code_map(spark.read.text(path), "value")


def parse_color_map(df: DataFrame, line: str = "line") -> DataFrame:
    """``(rgb, label)`` rows from ``(k,v)`` lines; other lines are skipped."""
    part = lambda i: F.trim(F.regexp_extract(F.col(line), COLOR_ENTRY, i))
    pairs = df.select(part(1).alias("k"), part(2).alias("v")).filter("k <> '' and v <> ''")
    return pairs.select(F.col("k").cast("int").alias("rgb"), F.col("v").cast("int").alias("label"))


def read_color_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_color_map(spark.read.text(path), "value")
