"""Mix sources to target weights with nested hash-threshold histograms.

Every document has a fixed 60-bit hash. A source takes all its documents a whole number of
times and, once more, those whose hash lies below a threshold. The threshold is found without
sorting documents: words are summed by source and leading hash digits, the bucket in which
the budget runs out is the only one refined by the next digits, until it holds one hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiclens.llm.common import WORD
from topiclens.session import cut_lineage
from topiclens.spread import number_rows

HASH_BITS, LEVEL_BITS = 60, 12


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id, of the text where the id is null; equal in every run and engine."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit(" "), text), F.lit(""))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], ratio: float, most: float) -> DataFrame:
    """``_key, source, source_size, target``: the budget shared by weight, capped, reshared.

    Sources are numbered by code point (null last); only sums over all sources reach the driver.
    """
    table = number_rows(
        sizes.groupBy("_key", "source").agg(F.sum("size").alias("source_size")),
        [F.col("source").asc_nulls_last()], "_rank", 0,
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = cut_lineage(
        table.select("_key", "source", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_cap"))
    )
    budget = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * ratio
    full, share = F.lit(False), F.lit(0.0)
    found = -1
    while True:
        spent, weighing, n = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0)),
            F.coalesce(F.sum(full.cast("int")), F.lit(0)),
        ).first()
        if n == found or not weighing:
            break
        found = n
        share = F.lit(budget - spent) * F.col("_weight") / F.lit(float(weighing))
        full = full | (share > F.col("_cap"))  # shares only grow, so a full source stays full
    return table.select("_key", "source", "source_size", F.when(full, F.col("_cap")).otherwise(share).alias("target"))


def hash_thresholds(sizes: DataFrame, quotas: DataFrame) -> DataFrame:
    """``_key, _upto``: the largest hash each source takes once more; no row where it takes none.

    ``quotas`` has ``_key, _rest``, the words to take by threshold. The unit at the edge is
    taken when that ends nearer to the quota.
    """
    edges, shift = None, HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        rows = sizes.filter("size > 0")
        if edges is not None:
            here = edges.select("_key", F.col("_bucket").alias("_above"), "_base")
            rows = rows.withColumn("_above", F.shiftright("_hash", shift + LEVEL_BITS)).join(here, ["_key", "_above"])
        else:
            rows = rows.withColumn("_base", F.lit(0).cast("long"))
        buckets = rows.groupBy("_key", "_base", F.shiftright("_hash", shift).alias("_bucket")).agg(
            F.sum("size").alias("_words"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high")
        )
        upto = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # 4096 rows at most
        edges = cut_lineage(
            buckets.withColumn("_end", F.col("_base") + F.sum("_words").over(upto))
            .join(quotas, "_key")
            .filter("_rest > 0 and _end >= _rest and _end - _words < _rest")
            .select("_key", "_bucket", (F.col("_end") - F.col("_words")).alias("_base"), "_words", "_low", "_high", "_rest")
        )
        if not edges.filter("_low < _high").limit(1).count():
            break
    taken = F.col("_base") + F.col("_words") - F.col("_rest") <= F.col("_rest") - F.col("_base")
    return edges.select("_key", F.when(taken, F.col("_high")).otherwise(F.col("_low") - 1).alias("_upto"))


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # null has a key of its own


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("source"))
    size = F.coalesce(F.regexp_count(F.col("_text"), F.lit(WORD)), F.lit(0)).cast("long")
    return cut_lineage(
        only.select("doc_id", "source", size.alias("size"), _source_key("source").alias("_key"), document_hash(F.col("doc_id"), F.col("_text")).alias("_hash"))
    )


def _plan(sizes: DataFrame, weights: Sequence[int], ratio: float, most: float) -> DataFrame:
    """``_key, source_size, target, _times, _upto``: how often each source's documents are
    taken, and up to which hash once more."""
    targets = source_targets(sizes, weights, ratio, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut_lineage(
        targets.withColumn("_times", times).withColumn("_rest", F.col("target") - F.col("_times") * F.col("source_size"))
    )
    return cut_lineage(
        plan.join(hash_thresholds(sizes, plan.select("_key", "_rest")), "_key", "left")
        .select("_key", "source_size", "target", "_times", F.coalesce("_upto", F.lit(-1)).alias("_upto"))
    )


_COPIES = "_times + if(_hash <= _upto, 1, 0)"


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), ratio: float = 1.5, most: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row of ``docs``.

    Size is the number of words (null text: 0). Sources take ``weights`` in turn by code point,
    null last, and share ``ratio`` times all words; a target stops at ``most`` times its source
    and the rest is shared again. ``copies`` says how often the mix holds the document. Rows
    with the same id, or no id and the same text, share a hash and are taken together. Empty
    tables give an empty result.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    return (
        sizes.join(_plan(sizes, weights, ratio, most), "_key")
        .withColumn("copies", F.expr(_COPIES))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def mixed(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), ratio: float = 1.5, most: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as ``mix`` takes it."""
    plan = _plan(_sizes(docs, id_col, text_col, source_col), weights, ratio, most).select("_key", "_times", "_upto")
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")  # whole, so that no name can clash
    marked = docs.select(row, _source_key(source_col).alias("_key"), document_hash(F.col(id_col), F.col(text_col)).alias("_hash"))
    return marked.join(plan, "_key").select(F.explode(F.array_repeat("_row", F.expr(_COPIES).cast("int"))).alias("_row")).select("_row.*")
