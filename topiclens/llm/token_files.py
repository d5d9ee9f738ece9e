"""Token ids in seekable zstandard files.

A file holds the ids of consecutive documents as one stream of little-endian unsigned 32-bit
integers, cut into independent zstandard frames of a fixed number of ids. After the frames come
two skippable frames: a document index (ids and lengths) and the seek table of the public
seekable format: per frame its compressed and decompressed size and a checksum, then the
number of frames and a magic number. A reader opens the end of the file and decompresses the
frames of the documents it wants.

Files are written by the tasks to the shared folder under a name of their own attempt; only
the names that the finished tasks report are in the manifest, so a task lost half-way leaves a
file that nobody reads.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclens.llm.common import whole
from topiclens.session import cut_lineage, ensure_checkpoint_dir

FRAME_IDS = 1 << 18
SLICE_BYTES = 1 << 18
CACHED_WORDS = 500_000
SKIPPABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
# Of Latin texts (below U+0180, without blanks beyond ASCII and the letter whose lower case is
# two characters) the tokenizer's own pieces are cut here: normalising only changes their case.
LATIN = [c for c in map(chr, range(0x180)) if c.isprintable() and c not in " \u00a0\u00ad\u0130"]
LETTERS = re.escape("".join(c for c in LATIN if unicodedata.category(c)[0] == "L"))
NUMBERS = re.escape("".join(c for c in LATIN if unicodedata.category(c)[0] == "N"))
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^ \t\n\r{LETTERS}{NUMBERS}]+")
NOT_LATIN = re.compile(rf"[^ \t\n\r{re.escape(''.join(LATIN))}]|<\|")
#: What ``WordEncoder`` stands for; fixed values, as the tokenizer's file writes them.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Bytes as the byte-level vocabulary writes them: printable ones as they are, others from U+0100 on.
_SHOWN = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordEncoder:
    """Encodes texts by their words, for a tokenizer that drops blanks and never joins across
    them: a text's ids are its words' ids in order. Keeps the ids of the last ``CACHED_WORDS``
    or so distinct words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.starts, self.lengths, self.ids = array("q"), array("q"), array("I")
        self.add("", [])

    def add(self, word: str, ids: Iterable[int]) -> None:
        self.words[word] = len(self.starts)
        self.starts.append(len(self.ids))
        self.ids.extend(ids)
        self.lengths.append(len(self.ids) - self.starts[-1])

    def learn_pieces(self, missing: Iterable[str]) -> None:
        """Of lower-case Latin texts: each is one piece of the tokenizer."""
        words, starts, lengths, tokenize = self.words, self.starts, self.lengths, self.model.tokenize
        n, end, gathered = len(starts), len(self.ids), []
        for piece in missing:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)
            ids = [token.id for token in tokenize(shown)]
            words[piece] = n
            starts.append(end)
            lengths.append(len(ids))
            gathered += ids
            n, end = n + 1, end + len(ids)
        self.ids.extend(gathered)

    def learn_words(self, missing: Iterable[str]) -> None:
        for word in missing:
            self.add(word, self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > CACHED_WORDS:
            self.clear()
        latin, parts, sizes = set(), [], []
        others = set()
        for text in texts:
            if NOT_LATIN.search(text):
                own = text.replace("\n", " ").replace("\t", " ").split(" ")
                others.update(own)
            else:
                own = PIECE.findall(text.lower())
                latin.update(own)
            parts.append(own)
            sizes.append(len(own))
        self.learn_pieces(latin.difference(self.words))
        self.learn_words(others.difference(self.words))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        starts, lengths, ids = (np.frombuffer(a, a.typecode) if len(a) else np.zeros(0, a.typecode) for a in (self.starts, self.lengths, self.ids))
        own = lengths[at]
        ends = np.cumsum(own)
        found = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - own), own)]
        return np.split(found, np.concatenate([[0], ends])[np.cumsum(sizes)][:-1]) if texts else []


class PlainEncoder:
    """Any tokenizer of the library, text by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def encodes_by_words(path: str) -> bool:
    """Does the tokenizer take the very steps that ``WordEncoder`` takes?"""
    with open(path, encoding="utf-8") as source:
        steps = json.load(source)
    return steps["model"]["type"] == "BPE" and all(steps[k] == v for k, v in WORD_STEPS.items()) and all(t["content"].startswith("<|") for t in steps["added_tokens"])


@cache
def encoder(path: str) -> WordEncoder | PlainEncoder:
    """One for each Python worker; words are kept only where a text's ids are its words' ids."""
    return WordEncoder(path) if encodes_by_words(path) else PlainEncoder(path)


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


class TokenFileWriter:
    """Takes the id arrays of documents in order; ``close`` writes index and seek table."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS):
        self.sink, self.frame_ids = sink, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=1)
        self.waiting, self.n_waiting, self.frames = [], 0, []
        self.doc_ids, self.nulls, self.lengths = array("q"), bytearray(), array("Q")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids.astype("<u4"))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.frame_ids:
            stream = np.concatenate(self.waiting)
            full = len(stream) // self.frame_ids * self.frame_ids
            for at in range(0, full, self.frame_ids):
                self._frame(stream[at : at + self.frame_ids])
            self.waiting, self.n_waiting = [stream[full:]], len(stream) - full

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.tobytes()
        packed = self.compressor.compress(raw)
        self.sink.write(packed)
        self.frames.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.n_waiting:
            self._frame(np.concatenate(self.waiting))
        index = b"".join((np.array(self.doc_ids, "<i8").tobytes(), np.array(self.lengths, "<u8").tobytes(), bytes(self.nulls)))
        index = self.compressor.compress(index)
        self.sink.write(struct.pack("<II", SKIPPABLE + 1, len(index) + 8) + index + struct.pack("<Q", len(index)))
        table = b"".join(self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class TokenFileReader:
    """Random access: ``doc_ids``, ``starts`` and ``lengths`` of the file, and ids by position."""

    def __init__(self, source, size: int):
        self.source = source
        n_frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a token file: no seek table at its end")
        table = size - 9 - 12 * n_frames
        entries = np.frombuffer(self._at(table, 12 * n_frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.raw, self.sums = entries.T
        self.offsets, self.ends = np.cumsum(self.packed) - self.packed, np.cumsum(self.raw // 4)
        end = table - 8
        (length,) = struct.unpack("<Q", self._at(end - 8, 8))
        index = zstandard.ZstdDecompressor().decompress(self._at(end - 8 - length, length))
        n = len(index) // 17
        self.nulls = np.frombuffer(index, np.uint8, n, 16 * n)
        ids = np.frombuffer(index, "<i8", n)
        self.doc_ids = [None if null else i for i, null in zip(ids.tolist(), self.nulls.tolist())]
        self.lengths = np.frombuffer(index, "<u8", n, 8 * n).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._last = (-1, b"")

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _frame(self, number: int) -> np.ndarray:
        if self._last[0] != number:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[number]), int(self.packed[number])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[number]:
                raise ValueError(f"frame {number}: checksum differs")
            self._last = (number, np.frombuffer(raw, "<u4"))
        return self._last[1]

    def ids(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length`` of the file's stream; opens only their frames."""
        parts = []
        number = int(np.searchsorted(self.ends, start, "right"))
        while length:
            first = int(self.ends[number] - self.raw[number] // 4)
            part = self._frame(number)[start - first : start - first + length]
            parts.append(part)
            start, length, number = start + len(part), length - len(part), number + 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, doc_id: int | None) -> np.ndarray:
        at = self.doc_ids.index(doc_id)
        return self.ids(int(self.starts[at]), int(self.lengths[at]))


def _encoded(batch: pa.RecordBatch, tokenizer: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Ids and encoded texts of a batch, some texts at a time."""
    row, sizes = 0, pc.binary_length(batch.column(1)).to_pylist()
    while row < batch.num_rows:
        begin, held = row, 0
        while row < batch.num_rows and held < SLICE_BYTES:
            held += sizes[row]
            row += 1
        some = batch.slice(begin, row - begin)
        yield from zip(some.column(0).to_pylist(), encoder(tokenizer).encode(some.column(1).to_pylist()))


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    folder: str | None = None, frame_ids: int = FRAME_IDS,
) -> DataFrame:
    """Write all documents in ascending id (null first; equal ids by their text's hash).

    ``tokenizer`` is the path, on every executor, of any file of the tokenizers library. Null texts
    count as empty; ``end_id`` ends every document; ids must be whole numbers. Returns the manifest
    ``part, path, n_docs, n_ids, before``: files in order, ``before`` counting the ids of all
    earlier files. An empty table gives no file.
    """
    folder = folder or f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = writer = sink = None
        for part in parts:
            for doc_id, ids in _encoded(part, tokenizer):
                if writer is None:
                    store, base = file_system(folder)
                    store.create_dir(base, recursive=True)
                    number = TaskContext.get().partitionId()
                    name = f"{number:06d}-{uuid.uuid4().hex}.ids.zst"
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    writer, n_ids = TokenFileWriter(sink, frame_ids), 0
                ids = np.append(ids, end_id)
                writer.add(doc_id, ids)
                n_ids += len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            row = {"part": [number], "path": [f"{folder}/{name}"], "n_docs": [len(writer.doc_ids)], "n_ids": [n_ids]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("_text")]
    placed = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    files = cut_lineage(placed.mapInArrow(write, "part int, path string, n_docs bigint, n_ids bigint"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return cut_lineage(files.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, before in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                store, name = file_system(path)
                with store.open_input_file(name) as source:
                    reader = TokenFileReader(source, store.get_file_info(name).size)
                    for at in range(0, len(reader.doc_ids), 1 << 14):
                        some = slice(at, at + (1 << 14))
                        places = list(zip(reader.starts[some].tolist(), reader.lengths[some].tolist()))
                        crcs = [zlib.crc32(reader.ids(*place).tobytes()) for place in places]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.doc_ids[some], pa.int64()), pa.array(reader.starts[some] + before), pa.array(reader.lengths[some]), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    files = max(1, manifest.count())
    paths = manifest.select("path", "before").repartition(files)
    return paths.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
