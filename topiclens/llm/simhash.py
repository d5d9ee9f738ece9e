"""SimHash near-dedup with pivot distance tables.

A document's fingerprint is the majority of its shingles' hashes. Every distinct fingerprint
has its Hamming distances to reference fingerprints (pivots). Two fingerprints within
``radius`` differ by at most that much in every distance, so

* distances to pivots that differ from the first pivot in one bit tell that bit: cut into
  ``radius + 2`` blocks of such pivots, two blocks at least have all distances equal beside
  the first pivot's, and fingerprints meet by the distances of every two blocks;
* pairs that meet are discarded by the largest difference over all other pivots;
* survivors are verified on the fingerprints.

Meeting places with many fingerprints are cut into tiles, and a tile returns the forest of
its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.llm.components import connected_components
from topiclens.session import cut_lineage

TILE = 2048
FAR_PIVOTS = 32
BLOCK_SHINGLES = 1 << 16


def pivots() -> np.ndarray:
    """The first pivot, its 64 one-bit neighbours, and far ones drawn by a fixed rule."""
    drawn = [xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(FAR_PIVOTS + 1)]
    near = [drawn[0] ^ (1 << bit) for bit in range(64)]
    return np.array([drawn[0], *near, *drawn[1:]], dtype=np.uint64)


def distance_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles, repeats included; of a shorter text, of all its words; none without a word."""
    parts = (text or "").encode().lower().split()  # of bytes: only A-Z change, only ASCII blanks part
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    shingles = zip(*(parts[i:] for i in range(k))) if len(parts) >= k else [parts]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half the hashes; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK_SHINGLES):
        block = hashes[at : at + BLOCK_SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprint(text: str | None, k: int) -> int:
    """Bits set in more than half the shingle hashes; zero without a word."""
    return majority(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print``: the 64-bit SimHash of every text as a signed number."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = np.array([text_fingerprint(t.as_py(), k) for t in part.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.view(np.int64))], ["doc_id", "print"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(batches, f"doc_id {kind}, print bigint")


def meeting_places(prints: DataFrame, radius: int) -> DataFrame:
    """``place, print``: one row for every two blocks of a fingerprint's pivot distances."""
    blocks = [b.tolist() for b in np.array_split(np.arange(64), radius + 2)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = pivots()[:65]
        for part in parts:
            own = part.column(0).to_numpy()
            table = distance_table(own.view(np.uint64), near)
            nearer = table[:, 1:] < table[:, :1]
            values = [(nearer[:, b] * (1 << np.arange(len(b)))).sum(axis=1) for b in blocks]
            for number, (x, y) in enumerate(combinations(range(len(blocks)), 2)):
                place = (number << 48) | (values[x] << 24) | values[y]
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(own)], ["place", "print"])

    return prints.mapInArrow(batches, "place bigint, print bigint")


def _pairs_within(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each run of ``sizes`` rows, in portions of bounded length."""
    starts = np.cumsum(sizes) - sizes
    last = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= 64, sizes)
    rows = np.arange(len(last))
    for lag in range(1, int(min(64, sizes.max(initial=0)))):
        left = rows[small & (rows + lag < last)]
        yield left, left + lag
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        step = max(1, (1 << 22) // int(size))
        for at in range(0, int(size), step):
            i, j = np.meshgrid(np.arange(at, min(at + step, size)), np.arange(size), indexing="ij")
            ahead = i < j
            yield start + i[ahead], start + j[ahead]


def _links(prints: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius``: pivots discard, the fingerprints themselves verify."""
    table = distance_table(prints, pivots())
    table = np.ascontiguousarray(np.concatenate([table[:, :1], table[:, 65:]], axis=1).T)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in _pairs_within(sizes):
        for distances in table:
            near = np.abs(distances[i] - distances[j]) <= radius
            i, j = i[near], j[near]
            if not len(i):
                break
        near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        found.append((i[near], j[near]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of ``n`` rows."""
    root = np.arange(n)
    while len(i):
        one, two = root[i], root[j]  # roots, as every tree is flat here: no row loses its parent
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root != root[root]).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def near_links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """``a, b``: links that connect all fingerprints (``print``, distinct) within ``radius``."""
    places = cut_lineage(meeting_places(prints, radius))
    crowds = places.groupBy("place").count().filter("count > 1")
    crowds = crowds.select("place", F.ceil(F.col("count") / tile).cast("int").alias("_parts"))
    tiles = (
        places.join(crowds, "place")
        .withColumn("_own", F.pmod(F.xxhash64("print"), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .groupBy("place", F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"))
        .agg(F.collect_list("print").alias("prints"))
        .select("prints")
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(0)
            own = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            order = np.lexsort((own, np.repeat(np.arange(len(sizes)), sizes)))  # smallest first in its tile
            own = own[order]
            root = _roots(len(own), *_links(own.view(np.uint64), sizes, radius))
            hung = np.flatnonzero(root != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[hung]), pa.array(own[root[hung]])], ["a", "b"])

    return tiles.mapInArrow(batches, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints of ``k``-word shingles link at ``radius`` or fewer differing bits;
    ``component_id`` is the smallest id reachable (null only if all ids there are null). Null
    and empty texts have fingerprint zero and link like any other. Repeated rows each get a
    row. Other columns are ignored; an empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, k, id_col, text_col))
    classes = cut_lineage(prints.groupBy("print").agg(F.min("doc_id").alias("_least")))
    joined = cut_lineage(connected_components(near_links(classes.select("print"), radius)))
    members = classes.join(joined, F.col("print") == F.col("node"), "left")
    members = cut_lineage(members.select("print", "_least", F.coalesce("component", "print").alias("_component")))
    least = members.groupBy("_component").agg(F.min("_least").alias("component_id"))
    named = members.join(least, "_component").select("print", "component_id")
    return prints.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
