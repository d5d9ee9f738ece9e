"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a group, in order, are joined ``fanout`` at a time into
nodes, these again, up to the group's root; the groups' roots are joined alike. A node's label
is (last leaf below it, level): in the order of labels all children come before their parent.

The sweep up reads nodes in the order of their labels and keeps a priority queue of messages,
ordered by the label of the parent they are for; when the sweep reaches a parent, the head of
the queue holds its children's digests. The sweep down reads the same nodes in reversed order:
a node takes its own message, the siblings on its way to the root, from a queue ordered by
reversed label, and sends each child that list with the child's siblings in front; leaves take
their whole proof.

Spark's sort is the external part of both queues: subtrees of ``fanout ** height`` leaves are
dealt over the tasks and sorted by label, so a task streams its rows and its queue holds at
most ``fanout * height`` messages. What crosses subtrees, one digest up and one list of
siblings down, is the input of the next round; rounds are few (a twelfth of the bits of the
number of leaves at 8 and 4).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from topiclens.session import cut_lineage
from topiclens.spread import number_rows

HEX = 64
NODES = "tree string, n bigint, level int, at bigint, run string, digest string"
SIBLINGS = "array<struct<left:string,right:string>>"
MESSAGES = f"tree string, block bigint, last bigint, level int, path {SIBLINGS}, top string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself; null as a dash."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof (``left``, ``right`` at each level) lead to."""
    return F.aggregate(proof, leaf, lambda below, at: F.sha2(F.concat(at["left"], below, at["right"]), 256))


def _tree_height(n: Column, fanout: int) -> Column:
    """Levels above ``n`` leaves: the least h with fanout ** h >= n."""
    size, steps = 1, []
    while size < 1 << 62:
        size *= fanout
        steps.append(size)
    return sum((F.when(n > (s // fanout), 1).otherwise(0) for s in steps), F.lit(0))


def _last(at: int, level: int, n: int, fanout: int) -> int:
    """The last of ``n`` leaves below node ``at`` of a level."""
    return min((at + 1) * fanout**level, n) - 1


def _sweep_up(base: int, height: int, fanout: int):
    """Nodes above the sorted nodes ``tree, n, high, at, digest`` of level ``base``."""

    def sweep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple[int, int, int, str]] = []  # (label of the receiver, place of the sender, its digest)
        out: list[tuple] = []
        subtree = tree = n = top = None

        def deliver(until: tuple[int, int]) -> None:
            while queue and queue[0][:2] <= until:
                last, level, at, _ = queue[0]
                run = []
                while queue and queue[0][:2] == (last, level):
                    run.append(heapq.heappop(queue)[3])
                at, joined = at // fanout, "".join(run)
                own = digest(joined)
                out.append((tree, n, level, at, joined, own))
                if level < top:
                    heapq.heappush(queue, (_last(at // fanout, level + 1, n, fanout), level + 1, at, own))

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["tree", "n", "level", "at", "run", "digest"])
            out.clear()
            return rows

        end = (1 << 62, 0)
        for part in parts:
            for own_tree, own_n, high, at, own in zip(*(column.to_pylist() for column in part.columns)):
                block = at // fanout**height
                if subtree != (own_tree, block):
                    deliver(end)
                    subtree, tree, n, top = (own_tree, block), own_tree, own_n, min(base + height, high)
                deliver((_last(at, base, n, fanout), base))
                heapq.heappush(queue, (_last(at // fanout, base + 1, n, fanout), base + 1, at, own))
            if out:
                yield batch()
        deliver(end)
        if out:
            yield batch()

    return sweep


def _sweep_down(base: int, height: int, fanout: int, to_leaves: bool, names: list[str]):
    """From messages and nodes in reversed label order: messages to level ``base``, or proofs."""

    def sweep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple] = []  # (reversed label of the receiver, its siblings up to the root)
        tree = n = top = None
        pairs = pa.struct([("left", pa.string()), ("right", pa.string())])

        def lists(paths: list[tuple]) -> pa.Array:
            ends = [0]
            for path in paths:
                ends.append(ends[-1] + len(path))
            sides = [pa.array([pair[side] for path in paths for pair in path], pa.string()) for side in (0, 1)]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, fields=list(pairs)))

        for part in parts:
            column = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            own = {name: column[name].to_pylist() for name in ("tree", "n", "last", "level", "kind", "at", "run", "path", "top")}
            sent, leaves, proofs, tops = [], [], [], []
            for row, kind in enumerate(own["kind"]):
                label = (-own["last"][row], -own["level"][row])
                if kind == 2:  # a message from the sweep above
                    tree, top = own["tree"][row], own["top"][row]
                    path = tuple((p["left"], p["right"]) for p in own["path"][row])
                    heapq.heappush(queue, (*label, path))
                    continue
                *receiver, path = heapq.heappop(queue)
                if tuple(receiver) != label or own["tree"][row] != tree:
                    raise ValueError(f"no message for node {label} of a tree")
                if kind == 0:
                    leaves.append(row)
                    proofs.append(path)
                    tops.append(top)
                    continue
                n, level, at, run = own["n"][row], own["level"][row] - 1, own["at"][row], own["run"][row]
                for child in range(len(run) // HEX):
                    to = ((run[: child * HEX], run[(child + 1) * HEX :]), *path)
                    place = at * fanout + child
                    last = _last(place, level, n, fanout)
                    if level > base or to_leaves:
                        heapq.heappush(queue, (-last, -level, to))
                    else:
                        sent.append((tree, place, last, level, to, top))
            if to_leaves and leaves:
                rows = part.take(pa.array(leaves, pa.int64()))
                kept = [rows.column(i) for i, name in enumerate(rows.schema.names) if name in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(tops, pa.string()), lists(proofs)], [*names, "_top", "_proof"])
            if sent:
                trees, blocks, lasts, levels, paths, roots = zip(*sent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees), pa.array(blocks, pa.int64()), pa.array(lasts, pa.int64()), pa.array(levels, pa.int32()), lists(paths), pa.array(roots)],
                    ["tree", "block", "last", "level", "path", "top"],
                )
        if queue:
            raise ValueError("messages for nodes that are not there")

    return sweep


class _Forest:
    """Trees over numbered leaves ``tree, n, high, at, digest`` and columns of the caller."""

    def __init__(self, leaves: DataFrame, fanout: int, height: int):
        self.leaves, self.fanout, self.height = leaves, fanout, height
        self.rounds: list[DataFrame] = []
        below = leaves.filter("high > 0").select("tree", "n", "high", "at", "digest")
        single = leaves.filter("high = 0").select("tree", "n", "high", "digest")
        tops = [single]
        base, reach = 0, fanout**height
        while below.limit(1).count():
            dealt = below.repartition("tree", F.expr(f"at div {reach}")).sortWithinPartitions("tree", "at")
            nodes = cut_lineage(dealt.mapInArrow(_sweep_up(base, height, fanout), NODES))
            self.rounds.append(nodes)
            base += height
            high = nodes.withColumn("high", _tree_height(F.col("n"), fanout))
            tops.append(high.filter("level = high").select("tree", "n", "high", "digest"))
            below = high.filter(f"level = {base} and level < high").select("tree", "n", "high", "at", "digest")
        self.tops = tops[0]
        for more in tops[1:]:
            self.tops = self.tops.unionByName(more)

    def proofs(self, from_above: DataFrame) -> DataFrame:
        """The leaves with ``_top`` and ``_proof``, from a message ``tree, n, high, path, top`` to
        each tree's top node."""
        fanout, height = self.fanout, self.height
        entry = from_above.select("tree", F.lit(0).cast("long").alias("block"), (F.col("n") - 1).alias("last"), F.col("high").alias("level"), "path", "top")
        sent = None
        for number in reversed(range(max(1, len(self.rounds)))):
            base = number * height
            messages = entry.filter(F.col("level").between(base + 1 if number else 0, base + height))
            if sent is not None:
                messages = messages.unionByName(sent)
            rows = messages.select("*", F.lit(2).alias("kind"))
            if self.rounds:
                nodes = self.rounds[number]
                ends = block = F.lit(0).cast("long")
                for level in range(base + 1, base + height + 1):
                    here = F.col("level") == level
                    ends = F.when(here, F.least((F.col("at") + 1) * _power(fanout, level), F.col("n")) - 1).otherwise(ends)
                    block = F.when(here, F.expr(f"at div {fanout ** (base + height - level)}")).otherwise(block)
                nodes = nodes.select("tree", "n", "level", "at", "run", ends.alias("last"), block.alias("block"), F.lit(1).alias("kind"))
                rows = rows.unionByName(nodes, allowMissingColumns=True)
            names = []
            if number == 0:
                names = [c for c in self.leaves.columns if c not in ("n", "high", "at")]
                leaves = self.leaves.withColumns({
                    "last": F.col("at"), "level": F.lit(0), "block": F.expr(f"at div {fanout**height}"), "kind": F.lit(0)
                }).drop("high")
                rows = rows.unionByName(leaves, allowMissingColumns=True)
            for missing, kind in (("n", "bigint"), ("at", "bigint"), ("run", "string")):
                if missing not in rows.columns:
                    rows = rows.withColumn(missing, F.lit(None).cast(kind))
            order = ["tree", "n", "last", "level", "kind", "at", "run", "path", "top"]
            dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("last"), F.desc("level"), F.desc("kind"))
            rest = [c for c in names if c not in order]
            dealt = dealt.select(*order, *rest)
            if number:
                sent = cut_lineage(dealt.mapInArrow(_sweep_down(base, height, fanout, False, []), MESSAGES))
            else:
                kept = ["tree", *rest]
                schema = StructType([StructField(c, dealt.schema[c].dataType) for c in kept])
                schema = schema.add("_top", "string").add("_proof", dealt.schema["path"].dataType)
                return dealt.mapInArrow(_sweep_down(0, height, fanout, True, kept), schema)


def _power(fanout: int, level: int) -> int:
    return min(fanout**level, 1 << 62)


def _numbered(rows: DataFrame, fanout: int) -> DataFrame:
    """Rows ``tree, _order..., digest`` with their place ``at``, tree size ``n`` and height ``high``."""
    sizes = rows.groupBy("tree").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    sizes = sizes.withColumn("high", _tree_height(F.col("n"), fanout))
    return rows.join(sizes, "tree").withColumn("at", F.col("_place") - F.col("_first")).drop("_place", "_first")


def merkle_manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    carry: Sequence[str] = (), fanout: int = 8, height: int = 4,
) -> DataFrame:
    """``id_col, leaf, subroot, root, proof`` and the ``carry`` columns for every row.

    ``leaf`` digests ``columns`` (``leaf_digest``). Leaves of a group ascend by id (null first;
    equal ids by their digest, and rows that repeat are neighbours, each with its own proof);
    every ``fanout`` consecutive nodes are joined (a last, shorter run too) until one is left,
    the group's ``subroot``, which for a lone leaf is the leaf. A null group is one of its own
    and the first; groups go by their bytes, and their subroots are joined alike to ``root``.
    ``proof`` lists, level by level from the leaf through the subroot to the root, the siblings
    ``left`` and ``right`` of the node on the way (empty strings for a run of one): ``folded``
    leads from leaf and proof to the root. An empty table gives no row; columns not named are
    ignored, and ``carry`` must not name an output column.
    """
    spark = docs.sparkSession
    travelling = {f"_c{i}": c for i, c in enumerate([id_col, *carry])}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),  # null sorts first
        leaf_digest(*map(F.col, columns)).alias("digest"),
        *(F.col(c).alias(name) for name, c in travelling.items()),
    )
    # the last key parts rows that repeat, should they fill more than one task
    order = [F.col("tree"), F.col("_c0").asc_nulls_first(), F.col("digest"), F.col("_part")]
    placed = number_rows(rows.withColumn("_part", F.monotonically_increasing_id()), order, "_place", start=0)
    leaves = cut_lineage(_numbered(placed.withColumnRenamed("digest", "leaf").withColumn("digest", F.col("leaf")).select("tree", "digest", "leaf", "_place", *travelling), fanout))
    groups = _Forest(leaves, fanout, height)

    subroots = groups.tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("n").alias("size"), F.col("high").alias("levels"), "digest")
    over = number_rows(cut_lineage(subroots), [F.col("group")], "_place", start=0)
    over = _Forest(cut_lineage(_numbered(over, fanout)), fanout, height)
    top = over.tops.first()  # one row
    if top is None:
        kinds = StructType([StructField(c, docs.schema[c].dataType) for c in travelling.values()])
        for name in ("leaf", "subroot", "root"):
            kinds = kinds.add(name, "string")
        empty = spark.createDataFrame([], kinds)
        return empty.withColumn("proof", F.lit(None).cast(SIBLINGS)).select(id_col, "leaf", "subroot", "root", "proof", *carry)
    start = over.tops.select("tree", "n", "high", F.array().cast(SIBLINGS).alias("path"), F.col("digest").alias("top"))
    down = over.proofs(start)
    entry = cut_lineage(down.select(F.col("group").alias("tree"), F.col("size").alias("n"), F.col("levels").alias("high"), F.col("_proof").alias("path"), F.col("digest").alias("top")))
    proofs = groups.proofs(entry)
    named = {c: name for name, c in travelling.items()}
    return proofs.select(
        F.col(named[id_col]).alias(id_col), "leaf", F.col("_top").alias("subroot"), F.lit(top.digest).alias("root"), F.col("_proof").alias("proof"),
        *(F.col(named[c]).alias(c) for c in carry),
    )
