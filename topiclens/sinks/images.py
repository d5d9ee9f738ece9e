"""Writing image rows as uncompressed 24-bit bitmap files, one file per image."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap_bytes(rgb: np.ndarray) -> bytes:
    """A 2-D array of packed colours as a bitmap: header, then bottom-up padded BGR rows."""
    h, w = rgb.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    bgr = np.stack([rgb & 255, (rgb >> 8) & 255, (rgb >> 16) & 255], 2).astype(np.uint8)
    rows[:, : w * 3] = bgr[::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + info + rows.tobytes()


def encode_bitmaps(images: DataFrame) -> DataFrame:
    """``(image_id, content)`` from packed-colour image rows."""

    def run(frames):
        for pdf in frames:
            files = [
                bitmap_bytes(np.asarray(d, dtype=np.int32).reshape(h, w))
                for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"])
            ]
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": files})

    id_type = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "width", "height", "data").mapInPandas(run, f"image_id {id_type}, content BINARY")


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


def write_files(files: DataFrame, path: str, key: str = "image_id") -> int:
    """One file per row, ``part-<key>=<value>`` in one folder, with exactly the bytes of
    ``content`` (a null: none); returns how many.

    The tasks write, each file under a name of the attempt first, so a task that is lost
    or run twice leaves no half file behind its name. Keys are text without a slash and unique.
    """

    def run(batches):
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                draft = f"{base}/_{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                store.move(draft, f"{base}/part-{key}={name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    named = files.select(F.col(key).cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    return named.mapInArrow(run, "n BIGINT").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
