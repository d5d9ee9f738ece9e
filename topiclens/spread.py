"""Building blocks that keep hot keys from landing in one task.

Every function here works for a key that holds a large share of all rows: joins are
salted, global numbering and medians run on a range-partitioned sort, per-group top-k is
cut per salt first, and all-against-all work inside a group is split into tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiclens.session import cut_lineage

SALTS = 16
BROADCAST_ROWS = 2_000_000
TILE_ROWS = 4096
SMALL_GROUP_ROWS = 1_000_000


def content_salt(columns: Sequence[str], salts: int) -> Column:
    """A salt computed from the row itself, so a re-run task places rows alike."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    lookup_rows: int | None = None,
    salts: int = SALTS,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join many ``facts`` to a ``lookup`` holding few rows per key.

    A lookup whose row count is known and small is broadcast. Otherwise the lookup is
    copied once per salt and the facts spread over the salts, so a hot key is shared by
    ``salts`` tasks; adaptive execution still turns this into a broadcast when the
    measured size allows it. The copies are made by a join, as the planner counts the rows of
    a join and takes those of ``explode`` for as many as went in, and broadcasts them unseen.
    """
    on = list(on)
    if lookup_rows is not None and lookup_rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(lookup), on, how)
    salted = facts.withColumn("_salt", content_salt(salt_by or facts.columns, salts))
    copies = lookup.crossJoin(F.broadcast(lookup.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def lookup_join_by_heat(facts: DataFrame, lookup: DataFrame, on: Sequence[str], heat: str) -> DataFrame:
    """Inner join of many ``facts`` with a ``lookup`` too large to send, whose column ``heat``
    (not returned) counts the facts of each key.

    The hot keys, which are fewer than ``BROADCAST_ROWS``, are sent and their facts stay where
    they are; only facts of the others are shuffled. None of these has many, so neither side is salted.
    """
    on = list(on)
    total = lookup.agg(F.sum(heat).alias("n")).first()["n"] or 0
    keys = F.broadcast(lookup.filter(F.col(heat) * BROADCAST_ROWS > total).select(*on).distinct())
    hot = facts.join(F.broadcast(lookup.join(keys, on, "left_semi").drop(heat)), on)
    rest = facts.join(keys, on, "left_anti").join(lookup.join(keys, on, "left_anti").drop(heat), on)
    return hot.unionByName(rest)


def running_total(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows sorting before each row.

    Range-partitioned sort, per-partition running sums, then one offset per partition:
    no step sees more than one partition, and only one row per partition is windowed
    globally.
    """
    placed = cut_lineage(
        df.withColumn("_w", weight.cast("long"))
        .orderBy(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33).cast("int"))
    )
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum("_w").alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_before", F.coalesce(F.sum("_w").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_before") + F.col("_offset"))
        .drop("_w", "_at", "_part", "_before", "_offset")
    )


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Consecutive ids in sort order without a single-task window.

    The position inside a sorted partition is free (low bits of the monotonic id), so
    only the per-partition row counts are needed to make the ids consecutive.
    """
    placed = cut_lineage(
        df.orderBy(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33).cast("int"))
    )
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_offset"))
    )
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(name, (position + F.col("_offset") + F.lit(start)).cast("long"))
        .drop("_at", "_part", "_offset")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = SALTS
) -> DataFrame:
    """The ``n`` first rows of every group, cut per salt before the final cut."""
    keys = list(keys)
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", content_salt(df.columns, salts))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= n)
        .withColumn("rank", F.row_number().over(last))
        .filter(F.col("rank") <= n)
        .drop("_salt", "_rank")
    )


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group (one partially aggregated pass)."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def group_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", small: int = SMALL_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Exact median of each group's values that are not null; mean of the middle two for an
    even count. A group without a value gives no row.

    Groups up to ``small`` rows use the built-in aggregate, which holds a group's values
    in memory. With a larger group present, the middle is located on a global sort of
    the distinct values and their counts.
    """
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull())
    if (largest_group(df, keys) if largest is None else largest) <= small:
        return df.groupBy(*keys).agg(F.median(value).alias(name))
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running_total(counted, [*map(F.col, keys), F.col(value)], F.col("_n"), "_start")
    spans = placed.groupBy(*keys).agg(F.min("_start").alias("_first"), F.sum("_n").alias("_rows"))
    low = F.expr("(_rows - 1) div 2")
    high = F.expr("_rows div 2")
    at = F.col("_start") - F.col("_first")
    holds = lambda pos: ((at <= pos) & (pos < at + F.col("_n"))).cast("int")
    return (
        lookup_join(placed, spans, keys)
        .withColumn("_hits", holds(low) + holds(high))
        .filter("_hits > 0")
        .groupBy(*keys)
        .agg((F.sum(F.col(value) * F.col("_hits")) / 2).alias(name))
    )


def tile_join(
    left: DataFrame,
    right: DataFrame,
    group: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    kernel: Callable,
    schema: str,
    rows: int = TILE_ROWS,
    largest: tuple[int, int] | None = None,
) -> DataFrame:
    """Run ``kernel(left_rows, right_rows)`` on every block pair of every group.

    Groups are cut into blocks of about ``rows`` rows on both sides and each pair of
    blocks is one cogroup, so no task holds more than two blocks however large a group
    is. The kernel must return partial results that a later ``groupBy`` can merge.
    ``largest`` gives upper bounds of the group sizes when the caller knows them.
    """
    group = list(group)
    if largest is None:  # both sides are counted, then joined: compute them once
        left, right = cut_lineage(left), cut_lineage(right)
    # new column identities, as both sides may come from one table
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    l_max, r_max = largest or (largest_group(left, group), largest_group(right, group))
    if l_max <= rows and r_max <= rows:
        return (
            left.groupBy(*group)
            .cogroup(right.groupBy(*group))
            .applyInPandas(kernel, schema)
        )
    blocks = lambda side, name: side.groupBy(*group).agg(
        F.ceil(F.count("*") / F.lit(rows)).cast("int").alias(name)
    )
    sizes = cut_lineage(blocks(left, "_lblocks").join(blocks(right, "_rblocks"), group))
    pick = lambda ids, n: F.pmod(F.xxhash64(*ids), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tiles = [*group, "_lb", "_rb"]
    lhs = (
        lookup_join(left, sizes, group, salt_by=left_id)
        .withColumn("_lb", pick(left_id, "_lblocks"))
        .withColumn("_rb", every("_rblocks"))
        .select(*left.columns, "_lb", "_rb")
    )
    rhs = (
        lookup_join(right, sizes, group, salt_by=right_id)
        .withColumn("_rb", pick(right_id, "_rblocks"))
        .withColumn("_lb", every("_lblocks"))
        .select(*right.columns, "_lb", "_rb")
    )
    return lhs.groupBy(*tiles).cogroup(rhs.groupBy(*tiles)).applyInPandas(kernel, schema)


def pack_blocks(df: DataFrame, group: Sequence[str], ids: Sequence[str], rows: int = TILE_ROWS) -> DataFrame:
    """Rows gathered as arrays, about ``rows`` to a block: the group columns, ``block``, one
    array per other column. For data that is read again and again by an iteration."""
    group = list(group)
    rest = [c for c in df.columns if c not in group]
    if largest_group(df, group) <= rows:
        placed = df.withColumn("block", F.lit(0))
    else:
        parts = df.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(rows)).alias("_parts"))
        placed = lookup_join(df, parts, group, salt_by=ids).withColumn(
            "block", F.pmod(F.xxhash64(*ids), F.col("_parts")).cast("int")
        )
    packed = placed.groupBy(*group, "block").agg(F.collect_list(F.struct(*rest)).alias("_r"))
    return packed.select(*group, "block", *(F.col(f"_r.{c}").alias(c) for c in rest))
