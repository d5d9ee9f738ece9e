"""Benchmark decontamination by SimHash of item-sized windows.

Windows of a document are as long as the benchmark item they are compared with. Two texts
share most of their shingles at the asked similarity, so windows are only placed where enough
shingles of some item of that length stand close together; this loses no similar window. The
windows' fingerprints meet the items' in a multi-index: of eight 8-bit blocks, one at least
differs in ``radius // 8`` bits or fewer, and every such neighbour of an item's block is in the
index, so no fingerprint within the radius is missed. Candidates are verified by the exact
similarity of their weighted shingles (sum of smaller counts over sum of larger counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclens.llm.common import ascii_lower, whole, words
from topiclens.session import cut_lineage

BLOCKS, BLOCK_BITS = 8, 8
LANES, LANE_BITS = 2, 32  # a text of fewer than 2**31 shingles
#: Benchmarks with more (shingle, item) pairs than this are joined by a shuffle, not a broadcast.
BROADCAST_PAIRS = 1_000_000


def weighted_simhash(rows: DataFrame, keys: list[str], shingle: str, weight: str) -> DataFrame:
    """``keys, _print64, _weight``: bits set in over half the hashes of a group's shingles.

    Each time a shingle stands is a hash of its own (shingle and number), so that weighted
    similarity is plain similarity of sets and one shingle more or less turns few bits, however
    few different ones there are. Two bit counters of 32 bits share one sum.
    """
    mask = sum(1 << (LANE_BITS * lane) for lane in range(LANES))
    each = rows.select(*keys, shingle, F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))).alias("_time"))
    hashed = each.withColumn("_h", F.xxhash64(shingle, "_time"))
    sums = [F.sum(F.shiftrightunsigned("_h", bit).bitwiseAND(F.lit(mask))).alias(f"_s{bit}") for bit in range(LANE_BITS)]
    summed = hashed.groupBy(*keys).agg(F.count("*").alias("_weight"), *sums)
    fingerprint = F.lit(0).cast("long")
    for bit in range(64):
        ones = F.shiftrightunsigned(f"_s{bit % LANE_BITS}", LANE_BITS * (bit // LANE_BITS)).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
        fingerprint = fingerprint.bitwiseOR(F.shiftleft((ones * 2 > F.col("_weight")).cast("long"), bit))
    return summed.select(*keys, fingerprint.alias("_print64"), "_weight")


def _block(fingerprint: Column, number: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * number).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def block_rows(prints: DataFrame, flips: int) -> DataFrame:
    """One row ``_at, _value`` for every block and every value ``flips`` bits or fewer away."""
    masks = [v for v in range(1 << BLOCK_BITS) if v.bit_count() <= flips]
    blocks = F.array(*(F.struct(F.lit(b).alias("_at"), _block(F.col("_print64"), b).alias("_own")) for b in range(BLOCKS)))
    found = prints.withColumn("_b", F.explode(blocks)).withColumn("_flip", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    return found.withColumn("_at", F.col("_b._at")).withColumn("_value", F.col("_b._own").bitwiseXOR(F.col("_flip"))).drop("_b", "_flip")


def _hash_shingles(word_hashes: str, n: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, from the words' hashes; only used to place windows."""
    return F.when(
        n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(word_hashes, i + j) for j in range(k))))
    )


def _items(benchmark: DataFrame, k: int, item_col: str, text_col: str) -> DataFrame:
    """Items with words: ``item_id, _m, _k, _hashes, _shingles``."""
    cut = benchmark.select(F.col(item_col).alias("item_id"), words(ascii_lower(whole(text_col))).alias("_w"))
    sized = cut.select("item_id", "_w", F.size("_w").alias("_m"), F.least(F.size("_w"), F.lit(k)).alias("_k")).filter("_m > 0")
    places = F.sequence(F.lit(0), F.col("_m") - F.col("_k"))
    return sized.select(
        "item_id", "_m", "_k", F.transform("_w", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.transform(places, lambda i: F.array_join(F.slice("_w", i + 1, F.col("_k")), " ")).alias("_shingles"),
    )


def _windows(docs: DataFrame, items: DataFrame, sizes: list[int], threshold: float) -> DataFrame:
    """``doc_id, _print, _m, _k, _from, _long``: windows that hold enough shingles of an item."""
    worded = docs.select("doc_id", "_print", F.transform(words(ascii_lower(F.col("_text"))), lambda w: F.xxhash64(w)).alias("_w"))
    worded = worded.select("doc_id", "_print", "_w", F.size("_w").alias("_n"))
    found = None
    for k in sizes:  # items shorter than k words are one shingle
        own = items.filter(F.col("_k") == k)
        pairs = own.select(
            "item_id", "_m", F.size("_shingles").alias("_c"), F.explode(F.array_distinct(_hash_shingles("_hashes", F.col("_m"), k))).alias("_s")
        )
        lookup = cut_lineage(pairs.groupBy("_s").agg(F.collect_list(F.struct("item_id", "_m", "_c")).alias("_of"), F.count("*").alias("_pairs")))
        small = (lookup.agg(F.sum("_pairs")).first()[0] or 0) <= BROADCAST_PAIRS
        stands = worded.select("doc_id", "_print", "_n", F.posexplode(_hash_shingles("_w", F.col("_n"), k)).alias("_at", "_s"))
        met = stands.join(F.broadcast(lookup) if small else lookup, "_s").select("doc_id", "_print", "_n", "_at", F.inline("_of"))
        places = met.groupBy("doc_id", "_print", "_n", "item_id", "_m", "_c").agg(F.sort_array(F.collect_set("_at")).alias("_at"))
        places = places.withColumn("_long", F.least("_m", "_n")).withColumn("_own", F.col("_long") - F.lit(k - 1))
        need = F.ceil((F.col("_c") + F.col("_own")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)).cast("int")
        places = places.withColumn("_need", need).withColumn("_end", F.col("_n") - F.col("_long"))
        # a window may as well begin at its first shared shingle, or be the last one of the text
        dense = F.transform(
            "_at", lambda p, i: F.when((p <= F.col("_end")) & (F.get("_at", i + F.col("_need") - 1) <= p + F.col("_own") - 1), p)
        )
        last = F.when(F.get("_at", F.size("_at") - F.col("_need")) >= F.col("_end"), F.col("_end"))
        starts = F.explode(F.filter(F.concat(dense, F.array(last)), lambda p: p.isNotNull()))
        placed = places.select("doc_id", "_print", "_m", F.lit(k).alias("_k"), starts.alias("_from"), "_long").distinct()
        found = placed if found is None else found.union(placed)
    return found


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 23,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, hamming, similarity, text_print``: every item
    found in a document, at its most similar window (first of equals).

    Texts are lower-cased (A-Z) and cut into words at ASCII blanks. A window has as many words as
    the item, or all of a shorter document; it matches when its fingerprint is within ``radius``
    and the similarity of its ``k``-word shingles is ``threshold`` or more. An item shorter than
    ``k`` words is one shingle; items and documents without words match nothing. Rows that repeat
    id and text are one document. Empty tables give an empty result.
    """
    items = cut_lineage(_items(benchmark, k, item_col, item_text_col))
    sizes = [r["_k"] for r in items.select("_k").distinct().collect()] or [k]  # k values at most
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).withColumn("_print", F.xxhash64("_text"))
    windows = cut_lineage(_windows(texts, items, sizes, threshold))

    window = ["doc_id", "_print", "_m", "_k", "_from", "_long"]
    listed = windows.groupBy(F.col("doc_id").alias("_id"), F.col("_print").alias("_of")).agg(F.collect_list(F.struct(*window[2:])).alias("_windows"))
    listed = cut_lineage(listed)
    held = texts.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_of")))
    held = held.dropDuplicates(["doc_id", "_print"]).select("doc_id", "_print", "_windows", words(ascii_lower(F.col("_text"))).alias("_w"))
    cut = F.transform("_windows", lambda w: F.struct(w["_m"].alias("_m"), w["_k"].alias("_k"), w["_from"].alias("_from"), w["_long"].alias("_long"), F.slice("_w", w["_from"] + 1, w["_long"]).alias("_own")))
    opened = held.select("doc_id", "_print", F.size("_w").alias("_n"), F.inline(cut))
    shingles = F.transform(F.sequence(F.lit(0), F.col("_long") - F.col("_k")), lambda i: F.array_join(F.slice("_own", i + 1, F.col("_k")), " "))
    parts = cut_lineage(opened.select(*window, F.explode(shingles).alias("_shingle")).groupBy(*window, "_shingle").agg(F.count("*").alias("_times")))
    item_parts = cut_lineage(items.select("item_id", "_m", F.explode("_shingles").alias("_shingle")).groupBy("item_id", "_m", "_shingle").agg(F.count("*").alias("_item_times")))

    prints = cut_lineage(weighted_simhash(parts, window, "_shingle", "_times"))
    item_prints = cut_lineage(weighted_simhash(item_parts, ["item_id", "_m"], "_shingle", "_item_times"))
    index = cut_lineage(block_rows(item_prints.withColumnsRenamed({"_weight": "_item_weight"}), radius // BLOCKS).withColumnRenamed("_print64", "_item_print"))
    hamming = F.bit_count(F.col("_print64").bitwiseXOR(F.col("_item_print")))
    candidates = (
        block_rows(prints, 0).join(index, ["_m", "_at", "_value"])
        .withColumn("hamming", hamming).filter(F.col("hamming") <= radius)
        .select(*window, "item_id", "hamming", "_weight", "_item_weight").distinct()
    )
    candidates = cut_lineage(candidates)
    named = candidates.select(F.col("doc_id").alias("_id"), *window[1:], "item_id", "hamming", "_weight", "_item_weight")
    both = parts.join(named, window[1:]).filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    shared = (
        both.join(item_parts.drop("_m"), ["item_id", "_shingle"])
        .groupBy(*window, "item_id", "hamming", "_weight", "_item_weight")
        .agg(F.sum(F.least("_times", "_item_times")).alias("_both"))
    )
    similarity = F.col("_both") / (F.col("_weight") + F.col("_item_weight") - F.col("_both"))
    best = (
        shared.withColumn("_sim", similarity).filter(F.col("_sim") >= threshold)
        .groupBy("doc_id", "_print", "item_id")
        .agg(F.max(F.struct("_sim", (-F.col("_from")).alias("_back"), "_long", "hamming")).alias("b"))
    )
    return best.select(
        "doc_id", "item_id", (-F.col("b._back")).cast("long").alias("start_word"), F.col("b._long").cast("long").alias("n_words"),
        F.col("b.hamming").cast("int").alias("hamming"), F.col("b._sim").alias("similarity"), F.col("_print").alias("text_print"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a benchmark item."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    gone = cut_lineage(leaks.select(F.col("doc_id").alias("_id"), F.col("text_print").alias("_of")).distinct())
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(whole(text_col)) == gone["_of"]), "left_anti")
