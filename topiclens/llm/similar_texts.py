"""SimHash near-dedup with exact similarity of word shingles, for the pipeline.

Texts are sets of hashed five-word shingles; texts with equal sets are one node. Candidates
link only by the exact similarity of their sets. They meet in three rounds, and a round only
opens meeting places that still hold nodes of different components:

* SimHash: nodes of one fingerprint, and fingerprints that the pivot distance tables of
  ``simhash`` link at ``radius`` or fewer differing bits;
* at similarity 0.8 about ten bits differ, more than pivot tables can carry, so the other pairs
  meet by bands of smallest hashes: a few first, which settle most groups;
* then the rest (a pair at 0.8 shares none of the ``BANDS`` bands three times in a million).

Crowded places are cut into tiles, and a tile returns a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.llm.common import whole
from topiclens.llm.components import connected_components
from topiclens.llm.simhash import majority, near_links, shingle_hashes
from topiclens.session import cut_lineage

BANDS, BAND_ROWS, FIRST_BANDS = 24, 4, 4
SIMHASH_BAND = -1  # number of the meeting places that fingerprints give
TILE_NODES, TILE_SHINGLES = 512, 1 << 20
SPREAD = 1 << 14
SENT_ROWS = 250_000
SEEDS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(BANDS * BAND_ROWS)], dtype=np.uint64)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct ``shingle_hashes``; texts without a word share one of their own."""
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", 42)], dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for every band of the smallest hashes."""
    low = np.full(len(SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), SPREAD):
        block = shingles[at : at + SPREAD]
        for n, seed in enumerate(SEEDS):
            mixed = (block ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            low[n] = min(low[n], ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).min())
    rows = low.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], dtype=np.uint64).view(np.int64)


def _nodes(texts: DataFrame, k: int) -> DataFrame:
    """``_id, _of, node, n, print, bands``: node, fingerprint and band keys of every row of ``_id, _of, _text``."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes, sizes, prints, keys = [], [], [], []
            for text in part.column(2):
                hashes = shingle_hashes(text.as_py(), k)
                prints.append(majority(hashes))
                found = shingle_set(hashes)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                keys.append(band_keys(found))
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(values))
            node, made = (pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (nodes, prints))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), node, pa.array(sizes, pa.int64()), made, lists], ["_id", "_of", "node", "n", "print", "bands"]
            )

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(batches, f"_id {kind}, _of bigint, node bigint, n bigint, print bigint, bands array<bigint>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """``node, shingles`` of ``node, _text``; a few texts leave at a time."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for node, text in zip(part.column(0), part.column(1)):
                found = pa.array([shingle_set(shingle_hashes(text.as_py(), k)).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), found], ["node", "shingles"])

    return texts.mapInArrow(batches, "node bigint, shingles array<bigint>")


def forest(labels: np.ndarray, starts: np.ndarray, shingles: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Index pairs at ``threshold`` or more that join all rows of one tile; rows of equal label are joined already."""
    sizes = np.diff(starts)
    ids = np.unique(shingles, return_inverse=True)[1]
    marked = np.zeros(ids.max(initial=0) + 1, dtype=np.int64)
    group, links = np.unique(labels, return_inverse=True)[1], []
    for i in range(len(sizes)):
        if (group == group[i]).all():
            break
        own = ids[starts[i] : starts[i + 1]]
        marked[own] = 1
        both = np.add.reduceat(marked[ids], starts[:-1])
        marked[own] = 0
        near = (both >= threshold * (sizes + sizes[i] - both) - 1e-9) & (group != group[i])
        for j in np.flatnonzero(near).tolist():
            if group[j] != group[i]:
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def _round(places: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links of ``place, node, n, label`` rows between nodes of different labels."""
    crowds = places.groupBy("place").agg(F.count("*").alias("_c"), F.sum("n").alias("_s"), F.min("label").alias("_l"), F.max("label").alias("_h"))
    parts = F.greatest(F.ceil(F.col("_c") / TILE_NODES), F.ceil(F.col("_s") / TILE_SHINGLES)).cast("int")
    crowds = crowds.filter("_l <> _h").select("place", parts.alias("_parts"))
    tiles = (
        places.join(crowds, "place")
        .withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .groupBy("place", F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"))
        .agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("_rows"))
        .filter("size(_rows) > 1").select("_rows").distinct()  # near copies meet in many bands in the same company
    )
    opened = cut_lineage(tiles.select(F.xxhash64("_rows").alias("tile"), F.inline("_rows")))
    full = opened.join(sets, "node").groupBy("tile").agg(F.collect_list(F.struct("node", "label", "shingles")).alias("rows"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                rows = part.column(0).slice(at, 1).flatten()
                node, label, lists = (rows.field(f) for f in ("node", "label", "shingles"))
                starts = lists.offsets.to_numpy().astype(np.int64)
                found = forest(label.to_numpy(), starts - starts[0], lists.flatten().to_numpy(), threshold)
                own, pairs = node.to_numpy(), np.array(found, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(own[pairs[:, 0]]), pa.array(own[pairs[:, 1]])], ["a", "b"])

    return full.select("rows").mapInArrow(batches, "a bigint, b bigint")


def _simhash_places(nodes: DataFrame, radius: int) -> DataFrame:
    """``place, _band, node, n``: nodes of one fingerprint, and the least nodes of two that are linked."""
    prints = cut_lineage(nodes.groupBy("print").agg(F.min(F.struct("node", "n")).alias("_first")))
    links = cut_lineage(near_links(prints.select("print"), radius))
    ends = links.select(F.xxhash64("a", "b").alias("place"), F.explode(F.array("a", "b")).alias("print"))
    linked = ends.join(prints, "print").select("place", F.col("_first.node").alias("node"), F.col("_first.n").alias("n"))
    own = nodes.select(F.xxhash64("print").alias("place"), "node", "n")
    return own.union(linked).select("place", F.lit(SIMHASH_BAND).alias("_band"), "node", "n")


def similar_groups(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """``_id, _of, component``: for every row, its id, the hash of its text and its component.

    Rows link when the sets of their ``k``-word shingles have a similarity of ``threshold`` or
    more. A text of fewer words is one shingle; null, empty and blank texts are equal.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(whole(text_col)).alias("_of"), F.col(text_col).alias("_text"))
    rows = cut_lineage(_nodes(source, k))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min(F.struct("_of", "n", "print", "bands")).alias("r")).select("node", "r.*"))
    banded = nodes.select("node", "n", F.posexplode("bands").alias("_band", "_key"))
    banded = banded.select(F.xxhash64("_band", "_key").alias("place"), "_band", "node", "n")
    places = cut_lineage(_simhash_places(nodes, radius).union(banded))
    crowded = places.groupBy("place").count().filter("count > 1").select("place")
    places = cut_lineage(places.join(crowded, "place"))
    wanted = places.select("node").distinct().join(nodes, "node").select("node", F.col("_of").alias("_wanted"))
    texts = source.join(wanted, F.col("_of") == F.col("_wanted")).groupBy("node").agg(F.first("_text").alias("_text"))
    sets = cut_lineage(_sets(texts, k))

    band, links, joined = F.col("_band"), None, None
    for some in (band == SIMHASH_BAND, (band >= 0) & (band < FIRST_BANDS), band >= FIRST_BANDS):
        open_ = places.filter(some)
        if joined is None:
            open_ = open_.withColumn("label", F.col("node"))
        else:
            open_ = open_.join(joined, F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("component", "node"))
        more = cut_lineage(_round(open_.select("place", "node", "n", "label"), sets, threshold))
        links = more if links is None else links.union(more)
        joined = cut_lineage(connected_components(links)).withColumnRenamed("node", "_node")
    found = rows.join(joined, F.col("node") == F.col("_node"), "left")
    return found.select("_id", "_of", F.coalesce("component", "node").alias("component"))


def drop_similar(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row of ``docs``, all columns, of each group: of the smallest id (a null id comes last),
    of equal ids of the smallest text hash, and of rows that repeat both any one.

    Up to ``SENT_ROWS`` ids of rows that go (or are repeated) are sent to the texts, which then stay where they are.
    """
    groups = similar_groups(docs, k, threshold, id_col, text_col, radius).groupBy("_id", "_of", "component").agg(F.count("*").alias("_times"))
    groups = cut_lineage(groups)
    key = F.struct(F.col("_id").isNull().alias("_none"), F.col("_id").alias("_id"), F.col("_of").alias("_of"))
    least = groups.groupBy("component").agg(F.min(key).alias("_least"))
    marked = cut_lineage(groups.join(least, "component").select("_id", "_of", "_times", (key == F.col("_least")).alias("_stays")))
    own = F.col(f"r.{id_col}"), F.xxhash64(whole(f"r.{text_col}"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"))
    at = lambda some: own[0].eqNullSafe(some["_id"]) & (own[1] == some["_of"])
    n = marked.agg(F.count_if(F.expr("not _stays or _times > 1")).alias("apart"), F.count_if(F.expr("_stays and _times > 1")).alias("again")).first()
    sent = F.broadcast if n["apart"] <= SENT_ROWS else lambda some: some  # counted
    apart, again = sent(marked.filter("not _stays or _times > 1")), sent(marked.filter("_stays and _times > 1"))
    once = rows.join(apart, at(apart), "left_anti").select("r.*")
    if not n["again"]:
        return once
    return once.union(rows.join(again, at(again), "left_semi").groupBy(*own).agg(F.first("r").alias("r")).select("r.*"))
