"""Line dedup by range-partitioned line hashes; the answer is a keep bitmap per document.

Lines become 128-bit hashes of their keys. (hash, document, position) rows are partitioned by
range of hash and document, so a line found everywhere is spread over many tasks, and sorted;
each task streams its run of a hash into the number of documents and the first occurrence,
and only these sums meet. Texts never move for the decision: it comes back as bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclens.llm.common import BLANKS, ascii_lower, whole
from topiclens.session import cut_lineage


def line_keys(text: Column) -> Column:
    """Per line the 128-bit hash of its trimmed, lower-cased key; null for an empty key."""
    return F.transform(
        F.split(ascii_lower(text), "\n"),
        lambda line: F.when(
            F.length(F.btrim(line, F.lit(BLANKS))) > 0,
            F.struct(
                F.xxhash64(F.btrim(line, F.lit(BLANKS))).alias("hi"),
                F.xxhash64(F.lit("second"), F.btrim(line, F.lit(BLANKS))).alias("lo"),  # seeded before the key: independent of hi
            ),
        ),
    )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, _print, cleared``: the documents that lose lines.

    A line whose key stands in ``min_docs`` documents or more is dropped everywhere, or with
    ``keep_first`` everywhere but at its first (document, position). ``cleared`` is the keep
    bitmap, compressed: only its 64-bit words with a cleared bit, as (word, bits), in order.
    A document is told apart by its id and text (``_print`` is the text's hash); a row that
    repeats both is the same document.
    """
    lines = cut_lineage(
        docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).select(
            "doc_id", F.xxhash64("_text").alias("_print"), line_keys(F.col("_text")).alias("_keys")
        )
    )
    rows = lines.select("doc_id", "_print", F.posexplode("_keys").alias("_pos", "_key")).filter("_key is not null")
    rows = rows.select("doc_id", "_print", "_pos", F.col("_key.hi").alias("_hi"), F.col("_key.lo").alias("_lo"))
    place = ["_hi", "_lo", "doc_id", "_print"]
    found = rows.repartitionByRange(*place).sortWithinPartitions(*place, "_pos")
    frequent = (
        found.groupBy(*place).agg(F.min("_pos").alias("_pos"))  # rows of a place lie together: no exchange
        .groupBy("_hi", "_lo")
        .agg(F.count("*").alias("_docs"), F.min(F.struct("doc_id", "_print", "_pos")).alias("_first"))
        .filter(F.col("_docs") >= min_docs)
    )
    frequent = cut_lineage(frequent)  # its file size tells the planner whether it can be broadcast
    dropped = rows.join(frequent, ["_hi", "_lo"])
    if keep_first:
        dropped = dropped.filter(~F.struct("doc_id", "_print", "_pos").eqNullSafe(F.col("_first")))
    bits = dropped.groupBy("doc_id", "_print", F.expr("_pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_pos % 64 as int))")).alias("_gone")
    )
    return bits.groupBy("doc_id", "_print").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("_gone").alias("bits")))).alias("cleared")
    )


def kept_lines(lines: Column, cleared: Column) -> Column:
    """The lines whose bit is set; words missing from ``cleared`` are all ones."""
    by_word = F.map_from_entries(cleared)
    words = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int"))
    dense = F.transform(words, lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(-1).cast("long")))
    bits = F.flatten(F.transform(dense, lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w, b))))
    return F.filter(F.zip_with(lines, bits, lambda line, bit: F.when(bit == 1, line)), lambda line: line.isNotNull())


def drop_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for every row of ``docs``.

    Null and empty texts are one empty line, which has no key and stays. A document that loses
    all lines keeps the empty text. Other columns are ignored.
    """
    bitmaps = keep_bitmaps(docs, min_docs, keep_first, id_col, text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).withColumn("_print", F.xxhash64("_text"))
    bitmaps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("_print").alias("_of"), "cleared").hint("shuffle_hash")
    joined = texts.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_of")), "left")
    lines = F.split("_text", "\n")
    joined = joined.withColumn("_kept", F.when(F.col("cleared").isNotNull(), kept_lines(lines, F.col("cleared"))))
    n_lines = F.size(lines)
    return joined.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("_kept").isNull(), 0).otherwise(n_lines - F.size("_kept")).cast("long").alias("n_dropped"),
        F.when(F.col("_kept").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")).alias("kept_text"),
    )
