"""Whole files, manifests and images."""

from __future__ import annotations

import itertools
import os
import re
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclens.sources.side import file_system
from topiclens.spread import lookup_join, number_rows

MANIFEST = "image_id INT, path STRING"
SIZED_MANIFEST = "image_id INT, file STRING, width INT, height INT"
READ_BYTES = 32 << 20  # of files that a task hands on together


def full_path(path) -> F.Column:
    """The whole path in one spelling: listings differ in the slashes after ``file:``."""
    return F.regexp_replace(path, "^file:/+", "/")


def base_name(path) -> F.Column:
    """The last part of a path; a key only where no two folders hold equal names."""
    return F.element_at(F.split(path, "/"), -1)


def read_whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file that is not empty, in the folder or below: ``path``, ``content``.

    Tasks list the folders and read the files, as the driver could not hold millions of names; one task streams
    the names in ``path`` itself, those in its folders are listed apart. Hidden files are left out as Spark's
    readers do. A store that ``pyarrow.fs`` does not know is listed by Spark's reader, in the driver.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    asked = hadoop.Path(path)
    found = asked.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(asked)
    roots = [(status.getPath().toString(), status.isDirectory()) for status in found or []]
    try:
        for root, _ in roots:
            _store(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        roots = []
    if not roots:  # also to fail as Spark does where there is no such folder
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        return reader.load(path).select("path", "content")
    pattern = hadoop.GlobPattern(glob).compiled().pattern() if glob else ".*"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def list_folders(deep: bool):
        def run(batches):
            for batch in batches:
                names = zip(*(column.to_pylist() for column in batch.columns))
                yield from _in_batches(_below(names, pattern, deep))

        return run

    def read(batches):
        for batch in batches:
            paths, contents, held = [], [], 0
            for name in batch.column(0).to_pylist():
                store, base = _store(name)
                with store.open_input_stream(base, compression=None) as source:
                    content = source.read()
                if len(content):
                    paths, contents, held = [*paths, name], [*contents, content], held + len(content)
                if held > READ_BYTES or len(paths) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    fields = "path STRING, folder BOOLEAN"
    listed = spark.createDataFrame(roots, fields).coalesce(1).mapInArrow(list_folders(False), fields)
    files = listed.repartition(parts, "path").mapInArrow(list_folders(True), fields).select("path")
    return files.repartition(parts, "path").mapInArrow(read, "path STRING, content BINARY")


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """``file_system`` of a path as listings spell it, in which nothing is encoded."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return file_system(quote(path, safe=":/@"))


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _below(paths, pattern: str, deep: bool):
    """In a task: files as they are, and what folders hold, with ``deep`` down to the last file."""
    wanted = re.compile(pattern, re.DOTALL)
    open_ = [iter(paths)]
    while open_:
        path, folder = next(open_[-1], (None, None))
        if path is None:
            open_.pop()
        elif not folder:
            if wanted.fullmatch(path.rpartition("/")[2]):
                yield path, False
        elif deep:
            open_.append(_entries(path))
        else:
            yield from (entry for entry in _entries(path) if entry[1] or wanted.fullmatch(entry[0].rpartition("/")[2]))


def _entries(folder: str):
    """Files that hold something and folders in a folder; those of a local one are never held together."""
    store, base = _store(folder)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        with os.scandir(base) as entries:
            for entry in entries:
                if not _hidden(entry.name) and (entry.is_dir() or entry.stat().st_size):
                    yield f"{folder.rstrip('/')}/{entry.name}", entry.is_dir()
        return
    for info in store.get_file_info(pyarrow.fs.FileSelector(base)):
        is_folder = info.type == pyarrow.fs.FileType.Directory
        if not _hidden(info.base_name) and (is_folder or info.size):
            yield f"{folder.rstrip('/')}/{info.base_name}", is_folder


def _in_batches(rows, size: int = 10_000):
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([f for _, f in part], pa.bool_())], ["path", "folder"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``image_id \\t path`` lines; an id that is not a number fails the read."""
    return spark.read.csv(path, sep="\t", schema=MANIFEST, mode="FAILFAST")


def read_sized_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SIZED_MANIFEST, mode="FAILFAST")


def build_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Number the files matching ``glob`` from 1 in path order; no content is read."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path")
    )
    numbered = number_rows(listed, [F.col("path")], "image_id")
    return numbered.select(F.col("image_id").cast("int").alias("image_id"), "path")


def decode_images(spark: SparkSession, path: str, drop_invalid: bool = True, glob: str = "*") -> DataFrame:
    """Decoded images: ``path, width, height, channels, data`` (bytes, BGR rows).

    The JVM decoder of the image source does the work; files it cannot read give no row
    when ``drop_invalid`` is set, else one of negative size (see ``operators.images.account_files``).
    """
    images = spark.read.format("image").option("dropInvalid", drop_invalid).option("pathGlobFilter", glob).load(path)
    return images.select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def bad_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths of files the decoder rejected (the side table of skipped images).

    The decoder keeps an unreadable file as a row of negative size, so one scan is enough.
    """
    images = spark.read.format("image").option("pathGlobFilter", glob).load(path)
    return images.filter("image.width < 0").select(F.col("image.origin").alias("path"))


def image_sizes(manifest: DataFrame, images: DataFrame, name=full_path) -> DataFrame:
    """``(image_id, file, width, height)``: manifest joined to decoded sizes on the path.

    ``name`` turns a path column into the name both sides share.
    """
    files = manifest.select("image_id", name(F.col("path")).alias("file"))
    sizes = images.select(name(F.col("path")).alias("file"), "width", "height")
    return lookup_join(files, sizes, ["file"]).select("image_id", "file", "width", "height")
