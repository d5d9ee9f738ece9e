"""Small tables beside the data that tasks read for themselves, block by block.

Spark writes the table to the shared folder; a task opens its files through ``pyarrow.fs``. Nothing
passes through the driver, and a task holds no more of the table than it asks for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from topiclens.session import ensure_checkpoint_dir, write_round


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it; listings write ``file:`` with one slash."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


def write_side(df: DataFrame) -> str:
    """Write a table for ``read_side``; delete it with ``session.remove_round``."""
    return write_round(df)[1]


def read_side(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """In a task: the table in blocks of at most ``rows`` rows, in any order."""
    store, base = file_system(path)
    for info in store.get_file_info(pyarrow.fs.FileSelector(base)):
        if info.is_file and info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(batch_size=rows)


def write_arrow(df: DataFrame) -> tuple[str, list[str]]:
    """Write a table as Arrow files, which tasks read again and again without decoding: the folder (delete
    it with ``session.remove_round``) and the files of the tasks that ended, an attempt each its own."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (batch for batch in batches if batch.num_rows)
        first = next(batches, None)
        if first is None:
            return
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        with store.open_output_stream(f"{base}/{name}") as sink, pa.ipc.new_file(sink, first.schema) as writer:
            writer.write_batch(first)
            for batch in batches:
                writer.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return folder, [f"{folder}/{row['name']}" for row in df.mapInArrow(write, "name STRING").collect()]


def read_arrow(files: list[str]) -> Iterator[pa.RecordBatch]:
    """In a task: the batches of files of ``write_arrow``."""
    for path in files:
        store, base = file_system(path)
        with store.open_input_file(base) as source:
            reader = pa.ipc.open_file(source)
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)
