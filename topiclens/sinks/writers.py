"""Writers: packed files, tables, several tables from one pass, and text dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclens.session import cut_lineage
from topiclens.sources.files import read_whole_files
from topiclens.spread import content_salt

MAX_RECORDS = 5_000_000


def pack_files(spark: SparkSession, src: str, dst: str, parts: int = 1, glob: str | None = None) -> None:
    """Many small files into ``parts`` compressed Parquet files."""
    files = read_whole_files(spark, src, glob)
    files.repartition(parts, "path").write.mode("overwrite").option("compression", "gzip").parquet(dst)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_many(df: DataFrame, outputs: dict[str, DataFrame | list[str]], root: str) -> None:
    """Write several projections of one computed table.

    ``outputs`` maps a name to the columns to keep, or to a function of the table. The
    table is computed once and read back for every output.
    """
    base = cut_lineage(df)
    for name, pick in outputs.items():
        chosen = pick(base) if callable(pick) else base.select(*pick)
        write_table(chosen, f"{root}/{name}")


def merge_parts(spark: SparkSession, paths: list[str], dst: str, parts: int) -> None:
    """Merge the part files matching ``paths`` into a table of ``parts`` files."""
    spark.read.parquet(*paths).coalesce(parts).write.mode("overwrite").parquet(dst)


def dump_lines(df: DataFrame, key: str, value: Column | str) -> DataFrame:
    """``key \\t value`` lines and one closing line with the number of entries."""
    shown = F.col(value) if isinstance(value, str) else value
    lines = df.select(
        F.concat_ws("\t", F.col(key).cast("string"), shown.cast("string")).alias("value")
    )
    total = df.agg(
        F.concat(F.lit("Total number of Entries: "), F.count("*").cast("string")).alias("value")
    )
    return lines.unionByName(total)


def dump_text(df: DataFrame, key: str, value: Column | str, path: str) -> None:
    dump_lines(df, key, value).write.mode("overwrite").text(path)


def show_patches(patches: Column) -> Column:
    """A code map as ``{(x, y)=code, ...}``; entries are ordered by x, then y."""
    shown = F.transform(
        F.array_sort(patches),
        lambda e: F.format_string("(%d, %d)=%d", e["x"], e["y"], e["code"]),
    )
    return F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))


def color_map_lines(df: DataFrame) -> DataFrame:
    return df.select(F.format_string("(%d,%d)", "rgb", "label").alias("value"))


def write_color_map(df: DataFrame, path: str) -> None:
    color_map_lines(df).write.mode("overwrite").text(path)


def split_by_image(codes: DataFrame, path: str, files_per_image: int = 1) -> None:
    """One folder of ``x \\t y \\t code`` rows per image.

    ``files_per_image`` salts the rows of an image, so that one large image is written
    by several tasks; ``MAX_RECORDS`` bounds a single file.
    """
    spread = codes.withColumn("_salt", content_salt(["x", "y"], files_per_image))
    (
        spread.repartition("image_id", "_salt")
        .select("image_id", "x", "y", "code")
        .write.mode("overwrite")
        .partitionBy("image_id")
        .option("maxRecordsPerFile", MAX_RECORDS)
        .csv(path, sep="\t")
    )
