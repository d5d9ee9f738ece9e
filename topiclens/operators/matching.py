"""Nearest-neighbour matching of features and points inside many pairs at once.

Descriptor distances of a pair are computed block by block in the tasks; only the two best
candidates per block leave a task, so nothing quadratic is shuffled. Nearest points of large
pairs are found through an adaptive grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclens.functions.arrow import square_distances
from topiclens.session import cut_lineage
from topiclens.spread import TILE_ROWS, largest_group, lookup_join, number_rows, pack_blocks, tile_join, top_per_group


CELL_POINTS = 64  # targets in a cell of a fine index
INDEX_POINTS = 1 << 16  # targets in a cell that one task searches
QUERY_ROWS = 1 << 16  # queries that meet a cell together
MANY_CELLS = 1024  # of a pair, above which its boxes no longer travel with the queries
LEAF = 16  # targets in a leaf of ``Places``
LOOKED_AT = 1 << 16  # queries looked at together
CELL_STEP = 4  # cells joined along each side from one level to the next


def best_two(distances: DataFrame, keys: list[str], target: str = "target_id", dist: str = "d") -> DataFrame:
    """Best and second-best candidate per query: ``best_id, d1, d2`` (``d2`` null if alone)."""
    ranked = top_per_group(distances, keys, [F.asc(dist), F.asc(target)], 2)
    first, second = F.col("rank") == 1, F.col("rank") == 2
    return ranked.groupBy(*keys).agg(
        F.max(F.when(first, F.col(target))).alias("best_id"),
        F.max(F.when(first, F.col(dist))).alias("d1"),
        F.max(F.when(second, F.col(dist))).alias("d2"),
    )


def _exact(points: np.ndarray, targets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - targets[at]) ** 2).sum(2))


def _two_nearest(allowed=None):
    def kernel(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("pair_id", "query_id", "target_id", "d")})
        right = right.sort_values("target_id", ignore_index=True)
        a, b = np.stack(left["desc"]).astype(float), np.stack(right["desc"]).astype(float)
        d = square_distances(a, b)
        if allowed is not None:
            d[~allowed(left, right)] = np.inf
        n = min(2, len(right))
        at = np.argsort(d, axis=1, kind="stable")[:, :n] if d.shape[1] <= 64 else _smallest(d, n)
        ok = np.isfinite(np.take_along_axis(d, at, 1)).ravel()
        return pd.DataFrame(
            {
                "pair_id": np.repeat(left["pair_id"].to_numpy(), n)[ok],
                "query_id": np.repeat(left["query_id"].to_numpy(), n)[ok],
                "target_id": right["target_id"].to_numpy()[at].ravel()[ok],
                "d": _exact(a, b, at).ravel()[ok],
            }
        )

    return kernel


def _smallest(d: np.ndarray, n: int) -> np.ndarray:
    rows = np.arange(len(d))
    first = d.argmin(1)
    if n == 1:
        return first[:, None]
    held = d[rows, first].copy()
    d[rows, first] = np.inf
    second = d.argmin(1)
    d[rows, first] = held
    return np.stack([first, second], 1)


def nearest_features(
    queries: DataFrame, targets: DataFrame, max_size_ratio: float | None = None, rows: int = TILE_ROWS
) -> DataFrame:
    """``(pair_id, query_id, best_id, d1, d2)`` of the two nearest descriptors.

    Queries are ``(pair_id, query_id, scale, desc)``, targets ``(pair_id, target_id,
    scale, desc)``. With ``max_size_ratio`` only targets whose scale ratio lies in
    ``[1/r, r]`` count.
    """
    allowed = None
    if max_size_ratio is not None:

        def allowed(left, right):
            ratio = right["scale"].to_numpy()[None, :] / left["scale"].to_numpy()[:, None]
            return (ratio >= 1.0 / max_size_ratio) & (ratio <= max_size_ratio)

    found = tile_join(
        queries.select("pair_id", "query_id", "scale", "desc"),
        targets.select("pair_id", "target_id", "scale", "desc"),
        ["pair_id"], ["query_id"], ["target_id"], _two_nearest(allowed),
        "pair_id LONG, query_id LONG, target_id LONG, d DOUBLE", rows,
    )
    return best_two(found, ["pair_id", "query_id"])


def match_features(
    queries: DataFrame, targets: DataFrame, rod: float = 0.92, max_size_ratio: float | None = None, rows: int = TILE_ROWS
) -> DataFrame:
    """Point matches whose best distance is below ``rod`` times the second best.

    Rows ``(pair_id, query_id, target_id, x1, y1, x2, y2, weight, d1, d2)``; the weight is
    the mean scale of the two features.
    """
    near = nearest_features(queries, targets, max_size_ratio, rows).filter("d2 > 0 and d1 / d2 < {}".format(rod))
    left = queries.select("pair_id", "query_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("scale").alias("s1"))
    right = targets.select(
        "pair_id", F.col("target_id").alias("best_id"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("scale").alias("s2")
    )
    # many queries may share one target, so that join is salted
    joined = lookup_join(near.join(left, ["pair_id", "query_id"]), right, ["pair_id", "best_id"], salt_by=["query_id"])
    return joined.select(
        "pair_id", "query_id", F.col("best_id").alias("target_id"), "x1", "y1", "x2", "y2",
        ((F.col("s1") + F.col("s2")) / 2).alias("weight"), "d1", "d2",
    )


def size_ratio_in_band(s1, s2, max_size_ratio: float):
    """Column: does the scale ratio lie in ``[1/r, r]``?"""
    ratio = F.col(s2) / F.col(s1)
    return (ratio >= 1.0 / max_size_ratio) & (ratio <= max_size_ratio)


def drop_ambiguous(matches: DataFrame) -> DataFrame:
    """Drop all matches that share a target location.

    A grouped count that carries one row along: no group is ever gathered.
    """
    rest = [c for c in matches.columns if c not in ("pair_id", "x2", "y2")]
    grouped = matches.groupBy("pair_id", "x2", "y2").agg(
        F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_row")
    )
    return grouped.filter("_n = 1").select("pair_id", "x2", "y2", "_row.*").select(*matches.columns)


def distinct_places(ids, x, y) -> tuple[np.ndarray, ...]:
    """Of the targets at one place the one with the lowest id, which wins every tie: a search looks at a place once."""
    order = np.lexsort((ids, y, x))
    order = order[np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])][: len(order)]]
    return ids[order], x[order], y[order]


class Places:
    """Targets in memory, for exact nearest neighbours: cut by rank along x into slices and these
    by rank along y into leaves of ``LEAF`` targets, which lie in them by id."""

    def __init__(self, ids, x, y):
        ids, x, y = np.asarray(ids), np.asarray(x, float), np.asarray(y, float)
        n = len(ids)
        self.per = max(1, int(np.ceil(np.sqrt(n / LEAF))))  # leaves in a slice
        rows = self.per * LEAF
        room = -(-n // rows) * rows
        by_x = np.argsort(x, kind="stable")
        order = by_x[np.lexsort((y[by_x], np.arange(n) // rows))]
        order = order[np.lexsort((ids[order], np.arange(n) // LEAF))]
        self.ids = np.concatenate([ids[order], np.full(room - n, ids.max(initial=0))]).reshape(-1, LEAF)
        self.x, self.y = (np.concatenate([v[order], np.full(room - n, np.inf)]).reshape(-1, LEAF) for v in (x, y))
        there = (np.arange(room) < n).reshape(-1, LEAF)
        self.x_lo, self.y_lo = self.x.min(1), self.y.min(1)
        self.x_hi, self.y_hi = (np.where(there, v, -np.inf).max(1) for v in (self.x, self.y))
        self.y_hi[~there[:, 0]] = np.inf  # leaves without a target come last in either order
        self.left, self.right = self.x_lo.reshape(-1, self.per).min(1), self.x_hi.reshape(-1, self.per).max(1)

    def nearest(self, x, y) -> tuple[np.ndarray, ...]:
        """For every query the id of its nearest target, the lower on ties, its place and the distance."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        at, d = np.zeros(len(x), int), np.zeros(len(x))
        plain = np.isfinite(x) & np.isfinite(y)
        asked = np.flatnonzero(plain)
        if len(asked) > LOOKED_AT:  # neighbours together: the leaves they look at stay in the cache
            asked = asked[np.lexsort((y[asked], np.searchsorted(self.left, x[asked], "right")))]
        todo = np.array_split(asked, -(-max(1, len(asked)) // LOOKED_AT))
        while todo:
            part = todo.pop()
            if len(part):
                found = self._search(x[part], y[part])
                if found is None:  # too many leaves at once
                    todo += np.array_split(part, 2)
                else:
                    at[part], d[part] = found
        for i in np.flatnonzero(~plain):
            with np.errstate(all="ignore"):
                away = np.sqrt((x[i] - self.x.ravel()) ** 2 + (y[i] - self.y.ravel()) ** 2)
            at[i] = np.lexsort((self.ids.ravel(), away))[0]
            d[i] = away[at[i]]
        return self.ids.ravel()[at], self.x.ravel()[at], self.y.ravel()[at], d

    def _search(self, x, y):
        n, rows = len(x), np.arange(len(x))
        home = np.clip(np.searchsorted(self.left, x, "right") - 1, 0, len(self.left) - 1)
        home = home * self.per + np.maximum(self._below(self.y_lo, home, y, True) - 1, 0)
        at, d = self._look(x, y, home)
        reach = lambda v: d * (1 + 1e-12) + np.abs(v) * 1e-15
        slices_of = lambda: (np.searchsorted(self.right, x - reach(x), "left"), np.searchsorted(self.left, x + reach(x), "right"))
        low, high = slices_of()
        far = np.flatnonzero(high - low > 3)
        if len(far):  # a query beside its targets: nearer ones in other slices spare the search most leaves
            x_far, y_far, at_far, d_far = x[far], y[far], at[far], d[far]
            here, step = home[far] // self.per, 1 << (len(self.left) - 1).bit_length()
            while step := step // 2:
                for other in (here - step, here + step):
                    other = np.clip(other, 0, len(self.left) - 1)
                    leaf = other * self.per + np.maximum(self._below(self.y_lo, other, y_far, True) - 1, 0)
                    place, away = self._look(x_far, y_far, leaf)
                    less = away < d_far
                    at_far, d_far, here = np.where(less, place, at_far), np.where(less, away, d_far), np.where(less, other, here)
            at[far], d[far] = at_far, d_far
            home[far] = -1
            low, high = slices_of()
        counts = np.maximum(high - low, 0)
        if counts.sum() > 4 * LOOKED_AT and n > 1:
            return None
        who, slices = _spans(rows, low, counts)
        side = np.maximum(np.maximum(self.left[slices] - x[who], 0.0), x[who] - self.right[slices])
        r = d[who]
        r = np.sqrt(np.maximum(r * r * (1 + 1e-12) - side * side, 0.0)) * (1 + 1e-12) + (np.abs(y[who]) + r * 1e-3) * 1e-12
        first = self._below(self.y_hi, slices, y[who] - r, False)
        counts = np.maximum(self._below(self.y_lo, slices, y[who] + r, True) - first, 0)
        if counts.sum() > 4 * LOOKED_AT and n > 1:
            return None
        spans, leaf = _spans(np.arange(len(who)), slices * self.per + first, counts)
        who = who[spans]
        near = self._gap(x[who], y[who], leaf)
        kept = (near <= d[who]) & (leaf != home[who])
        who, leaf, near = who[kept], leaf[kept], near[kept]
        order = np.lexsort((near, who))
        who, leaf, near = who[order], leaf[order], near[order]
        for last in (False, False, True):  # the nearest leaves first, as they spare others
            if not len(who):
                break
            now = np.ones(len(who), bool) if last else np.r_[True, who[1:] != who[:-1]]
            place, away = self._look(x[who[now]], y[who[now]], leaf[now])
            owner = np.concatenate([rows, who[now]])
            place, away = np.concatenate([at, place]), np.concatenate([d, away])
            order = np.lexsort((self.ids.ravel()[place], away, owner))
            best = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            at, d = place[best], away[best]
            left = ~now & (near <= d[who])
            who, leaf, near = who[left], leaf[left], near[left]
        return at, d

    def _below(self, bounds, slices, value, equal):
        """How many leaves of each slice have a bound below the value (or equal to it)."""
        low, high = slices * self.per, (slices + 1) * self.per
        start = low
        for _ in range(self.per.bit_length()):
            middle = (low + high) // 2
            bound = bounds[np.minimum(middle, len(bounds) - 1)]
            below = (low < high) & ((bound <= value) if equal else (bound < value))
            low, high = np.where(below, middle + 1, low), np.where(below, high, middle)
        return low - start

    def _look(self, x, y, leaf):
        dx, dy = x[:, None] - self.x[leaf], y[:, None] - self.y[leaf]
        away = np.sqrt(dx * dx + dy * dy)
        at = away.argmin(1)
        return leaf * LEAF + at, away[np.arange(len(at)), at]

    def _gap(self, x, y, leaf):
        dx = np.maximum(np.maximum(self.x_lo[leaf] - x, 0.0), x - self.x_hi[leaf])
        dy = np.maximum(np.maximum(self.y_lo[leaf] - y, 0.0), y - self.y_hi[leaf])
        return np.sqrt(dx * dx + dy * dy)


def _spans(owners: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every owner with each number of its run of ``counts`` numbers from ``first``."""
    ends = np.cumsum(counts)
    return np.repeat(owners, counts), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - first, counts)


def nearest_point(p: DataFrame, q: DataFrame, rows: int = TILE_ROWS, largest: tuple[int, int] | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Closest target point of every source point, the lower id on ties.

    ``p`` is ``(pair_id, query_id, x, y)``, ``q`` is ``(pair_id, target_id, x, y)``. Points without
    coordinates take no part. Pairs of up to ``rows`` points on both sides are compared in a
    task; larger ones by an index over the targets (``_cells``), whose work is in proportion to
    the points. ``largest`` gives the sizes of the largest pair on both sides when known, ``cells`` the
    index of ``q`` when it was made before.
    """
    there = ~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull()
    p, q = p.filter(there).select("pair_id", "query_id", "x", "y"), q.filter(there).select("pair_id", "target_id", "x", "y")
    if largest is None:
        p, q = cut_lineage(p), cut_lineage(q)
        largest = largest_group(p, ["pair_id"]), largest_group(q, ["pair_id"])
    if max(largest) > rows:
        return _nearest_by_cells(p, q, cells=cells)

    def kernel(left, right):
        names = ["pair_id", "query_id", "target_id", "x2", "y2", "d"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in names})
        right = right.sort_values("target_id", ignore_index=True)
        a, b = left[["x", "y"]].to_numpy(), right[["x", "y"]].to_numpy()
        d = np.sqrt((a[:, :1] - b[:, 0]) ** 2 + (a[:, 1:] - b[:, 1]) ** 2)
        at = d.argmin(1)
        return pd.DataFrame(
            {
                "pair_id": left["pair_id"], "query_id": left["query_id"], "target_id": right["target_id"].to_numpy()[at],
                "x2": b[at, 0], "y2": b[at, 1], "d": d[np.arange(len(at)), at],
            }
        )

    return tile_join(p, q, ["pair_id"], ["query_id"], ["target_id"], kernel, "pair_id LONG, query_id LONG, target_id LONG, x2 DOUBLE, y2 DOUBLE, d DOUBLE", rows, largest)


def _cells(q: DataFrame, points: int = CELL_POINTS) -> DataFrame:
    """An adaptive grid: ``(pair_id, s, b, x_lo, x_hi, y_lo, y_hi, points)``.

    The targets of a pair are cut by rank along x into slices, every slice by rank along y into
    cells of ``points`` targets. Cells are small where points are dense, so none is crowded; of
    targets at one place only the lowest id is kept, which wins any tie.
    """
    places = q.groupBy("pair_id", "x", "y").agg(F.min("target_id").alias("target_id"))
    by_x = number_rows(places, [F.col(c) for c in ("pair_id", "x", "y")], "no", start=0)
    sizes = by_x.groupBy("pair_id").agg(F.min("no").alias("first"), F.count("*").alias("n"))
    per_slice = F.ceil(F.col("n") / F.ceil(F.sqrt(F.col("n") / points))).cast("long")
    sizes = sizes.select("pair_id", "first", per_slice.alias("per_slice"))
    sliced = lookup_join(by_x, sizes, ["pair_id"], salt_by=["x", "y"]).select("pair_id", F.expr("(no - first) div per_slice").alias("s"), "x", "y", "target_id")
    by_y = number_rows(sliced, [F.col(c) for c in ("pair_id", "s", "y", "x")], "no", start=0)
    firsts = by_y.groupBy("pair_id", "s").agg(F.min("no").alias("first"))
    celled = lookup_join(by_y, firsts, ["pair_id", "s"], salt_by=["x", "y"]).withColumn("b", F.expr(f"(no - first) div {points}"))
    return cut_lineage(celled.groupBy("pair_id", "s", "b").agg(*_box("x", "x", "y", "y"), F.collect_list(F.struct("target_id", "x", "y")).alias("points")))


def _box(x_lo, x_hi, y_lo, y_hi):
    return F.min(x_lo).alias("x_lo"), F.max(x_hi).alias("x_hi"), F.min(y_lo).alias("y_lo"), F.max(y_hi).alias("y_hi")


def _near_cells(p: DataFrame, cells: DataFrame) -> DataFrame:
    """``(pair_id, query_id, x, y, s, b)``: the cells that may hold a query's nearest target.

    From one box around all targets of a pair down to its cells, ``CELL_STEP`` squared boxes of
    the next level stand for each one. A box is left out when its nearest edge is farther than
    the farthest edge of another, as every box holds a target.
    """
    most = cells.agg(F.greatest(F.max("s"), F.max("b")).alias("most")).first()["most"]
    level, top = 0, most or 0
    while top:
        level, top = level + 1, top // CELL_STEP
    wide = CELL_STEP**level
    boxes = cells.groupBy("pair_id").agg(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("b"))
    open_ = lookup_join(p, boxes, ["pair_id"], salt_by=["query_id"])
    own = Window.partitionBy("pair_id", "query_id")
    gap = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.lit(0.0), F.col(v) - F.col(hi))
    span = lambda v, lo, hi: F.greatest(F.abs(F.col(lo) - F.col(v)), F.abs(F.col(hi) - F.col(v)))
    length = lambda of: F.sqrt(of("x", "x_lo", "x_hi") * of("x", "x_lo", "x_hi") + of("y", "y_lo", "y_hi") * of("y", "y_lo", "y_hi"))
    while level:
        level, wide = level - 1, wide // CELL_STEP
        below = cells.groupBy("pair_id", F.expr(f"s div {wide}").alias("cs"), F.expr(f"b div {wide}").alias("cb")).agg(*_box("x_lo", "x_hi", "y_lo", "y_hi"))
        below = below.withColumns({"s": F.expr(f"cs div {CELL_STEP}"), "b": F.expr(f"cb div {CELL_STEP}")})
        met = open_.join(below, ["pair_id", "s", "b"]).withColumns({"near": length(gap), "far": length(span)})
        kept = met.withColumn("bound", F.min("far").over(own)).filter("near <= bound")
        open_ = kept.select("pair_id", "query_id", "x", "y", F.col("cs").alias("s"), F.col("cb").alias("b"))
    return open_


def target_cells(q: DataFrame) -> DataFrame:
    """The index of ``nearest_point`` for targets with coordinates that are searched more than once."""
    return _cells(q.select("pair_id", "target_id", "x", "y"), INDEX_POINTS)


def _boxes_of(cells: DataFrame) -> DataFrame:
    """Per pair the boxes of its cells: ``(pair_id, boxes)``."""
    return cells.groupBy("pair_id").agg(F.collect_list(F.struct("s", "b", "x_lo", "x_hi", "y_lo", "y_hi")).alias("boxes"))


def _gap(box):
    """Distance of the point ``x, y`` to a box, in the arithmetic of distances to its points."""
    apart = lambda v, lo, hi: F.greatest(box[lo] - F.col(v), F.lit(0.0), F.col(v) - box[hi])
    dx, dy = apart("x", "x_lo", "x_hi"), apart("y", "y_lo", "y_hi")
    return F.sqrt(dx * dx + dy * dy)


def _at_home(p: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every query with its nearest cell ``s, b`` and the distance ``next`` to the cell after it."""
    gaps = F.transform("boxes", lambda box: F.struct(_gap(box).alias("near"), box["s"].alias("s"), box["b"].alias("b")))
    held = lookup_join(p, boxes, ["pair_id"], salt_by=["query_id"]).withColumn("_g", gaps).withColumn("_h", F.array_min("_g"))
    others = F.filter("_g", lambda g: ~((g["s"] == F.col("_h.s")) & (g["b"] == F.col("_h.b"))))
    after = F.array_min(F.transform(others, lambda g: g["near"]))
    return held.select("pair_id", "query_id", "x", "y", "_h.s", "_h.b", after.alias("next"))


def _others_near(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """The other cells that may hold a target as near as the one found at home."""
    met = lookup_join(found.filter("next <= d"), boxes, ["pair_id"], salt_by=["query_id"])
    near = F.filter("boxes", lambda box: (_gap(box) <= F.col("d")) & ~((box["s"] == F.col("s")) & (box["b"] == F.col("b"))))
    return met.withColumn("_c", F.explode(near)).select("pair_id", "query_id", "x", "y", "_c.s", "_c.b")


def _search_cells(routed: DataFrame, cells: DataFrame) -> DataFrame:
    """The nearest target of each routed query in its cell: a task holds a cell and a block of queries."""
    extra = [c for c in ("next",) if c in routed.columns]
    packed = pack_blocks(cut_lineage(routed), ["pair_id", "s", "b"], ["query_id"], QUERY_ROWS)
    met = packed.join(cells.select("pair_id", "s", "b", *(F.col(f"points.{c}").alias(f"t_{c}") for c in ("target_id", "x", "y"))), ["pair_id", "s", "b"])

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                x, y = np.asarray(row.x, float), np.asarray(row.y, float)
                ids, x2, y2, d = Places(row.t_target_id, row.t_x, row.t_y).nearest(x, y)
                yield pd.DataFrame({
                    "pair_id": row.pair_id, "query_id": row.query_id, "x": x, "y": y, "s": row.s, "b": row.b,
                    **{c: np.asarray(getattr(row, c), float) for c in extra}, "target_id": ids, "x2": x2, "y2": y2, "d": d,
                })

    fields = "".join(f"{c} DOUBLE, " for c in extra)
    return met.drop("block").mapInPandas(run, f"pair_id LONG, query_id LONG, x DOUBLE, y DOUBLE, s LONG, b LONG, {fields}target_id LONG, x2 DOUBLE, y2 DOUBLE, d DOUBLE")


def _nearest_by_cells(p: DataFrame, q: DataFrame, points: int = INDEX_POINTS, cells: DataFrame | None = None) -> DataFrame:
    """Every query is searched in the cell nearest to it, and again in the cells that are no farther
    than what it found there, which few are. Pairs with very many cells go down to them level by level."""
    cells = _cells(q, points) if cells is None else cells
    columns = ["pair_id", "query_id", "target_id", "x2", "y2", "d"]
    if largest_group(cells, ["pair_id"]) <= MANY_CELLS:
        boxes = cut_lineage(_boxes_of(cells))
        found = cut_lineage(_search_cells(_at_home(p, boxes), cells))
        found = found.select(*columns).unionByName(_search_cells(_others_near(found, boxes), cells).select(*columns))
    else:
        found = _search_cells(_near_cells(p, cells), cells).select(*columns)
    best = found.groupBy("pair_id", "query_id").agg(F.min(F.struct("d", "target_id", "x2", "y2")).alias("b"))
    return best.select("pair_id", "query_id", "b.target_id", "b.x2", "b.y2", "b.d")
