"""Exact dedup over recipes of content-defined chunks.

A text is cut where its own content says so (after a sentence end or a line break, 512 to
8192 characters), each chunk becomes a 64-bit identifier, and a document its ordered list of
identifiers. Identifiers are verified: every chunk also has its SHA-256, and an identifier
that stands for two digests makes the digests themselves the identifiers. Only these lists
move; a text is read once, where it lies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclens.llm.common import whole
from topiclens.session import cut_lineage

SHORTEST, LONGEST = 512, 8192
CHUNK = (
    rf"[\s\S]{{{SHORTEST},{LONGEST - 1}}}?(?:(?<=[.!?][ \t])|(?<=\n)|\z)"  # up to the next cut
    rf"|[\s\S]{{1,{LONGEST}}}"  # no cut in reach, or the rest of the text
)


def chunks(text: Column) -> Column:
    """The text in order, in pieces; joined they give the text. Empty text: no piece."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """``doc_id, recipe, text_sha256``: equal recipes mean equal texts.

    ``recipe`` lists verified chunk identifiers in text order. ``identify`` may be any hash;
    if two different chunks share its value anywhere, SHA-256 digests serve as identifiers.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).select(
        "doc_id", F.sha2("_text", 256).alias("text_sha256"), chunks(F.col("_text")).alias("_chunks")
    )
    narrow = cut_lineage(
        cut.select(
            "doc_id",
            "text_sha256",
            F.transform("_chunks", lambda c: identify(c)).alias("_ids"),
            F.transform("_chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("_digests"),
        )
    )
    pairs = narrow.select(F.explode(F.arrays_zip("_ids", "_digests")).alias("p")).select("p._ids", "p._digests")
    shared = pairs.distinct().groupBy("_ids").count().filter("count > 1")
    verified = "_digests" if shared.limit(1).count() else "_ids"
    return narrow.select("doc_id", F.col(verified).alias("recipe"), "text_sha256")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical, null counting as empty; of equal texts the largest
    ``doc_id`` stays (null ids are smallest). Rows that repeat a ``doc_id`` with its text are
    one document: each counts in ``group_size`` and all get the same answer. Other columns are
    ignored; an empty table gives an empty result.
    """
    recipes = chunk_recipes(docs, id_col, text_col, identify)
    groups = (
        recipes.groupBy("recipe")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    joined = recipes.join(cut_lineage(groups), "recipe", "left")  # apart from the sums, so that a hot recipe can be split
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
