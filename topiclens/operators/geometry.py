"""2-D registration of many pairs at once: fits, scoring, RANSAC, trimming, ICP, smoothness.

Matches are rows ``(pair_id, match_id, x1, y1, x2, y2)`` with an optional ``weight``; models
are ``(pair_id, cos, sin, tx, ty)``, or ``pair_id`` and the parameters of a model of one's own:
wherever ``kind`` is asked for, ``"translation"``, ``"rigid"`` or an ``operators.models.Model``
will do. Fits are single grouped aggregates of co-moments, so a pair of any size is only ever
reduced to a handful of sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.functions.scalars import draw
from topiclens.operators.matching import Places, distinct_places, nearest_point, target_cells
from topiclens.operators.models import ARRAYS, COLUMNS, POINTS, Model, model_of
from topiclens.session import cut_lineage
from topiclens.spread import TILE_ROWS, group_median, largest_group, lookup_join, number_rows, pack_blocks

MAX_TRUST = 4.0  # fixed value
GROW_ITERATIONS = 1000  # fixed value: hypotheses per round of the growing search
GROW_PATIENCE = 4  # fixed value: rounds without more inliers
BUCKETS = 32  # of a residual histogram
ICP_ROWS = 5 << 18  # points of a pair that goes through all rounds of ``icp`` in a task
TERM_ROWS = 1 << 18  # matches whose moments are held together
SCORED = 1 << 15  # (hypothesis, match) pairs scored together, which stay in the cache
CELLS = 1 << 20  # (candidate, match) pairs looked at together
WHOLE_ROWS = 1 << 18  # matches of a pair that a task holds for the local fits around some of them
PART_CELLS = 1 << 24  # (candidate, match) pairs of such a task's share of a pair
PARTS = 32  # shares of a pair at most, each with a copy of its matches
ONE_BY_ONE = 1024  # matches of a pair from which its candidates are fitted one by one


def fit_translation(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shift between the centroids."""
    return matches.groupBy(*(keys or ["pair_id"])).agg(
        F.lit(1.0).alias("cos"), F.lit(0.0).alias("sin"),
        (F.avg("x2") - F.avg("x1")).alias("tx"), (F.avg("y2") - F.avg("y1")).alias("ty"),
        F.count("*").alias("n"),
    )


def fit_rigid(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least-squares rotation and translation.

    The angle follows from co-moments about the centroids, which are mergeable
    aggregates: one pass, no join with the centroids.
    """
    angle = F.atan2(
        F.covar_pop("x1", "y2") - F.covar_pop("y1", "x2"), F.covar_pop("x1", "x2") + F.covar_pop("y1", "y2")
    )
    keys = keys or ["pair_id"]
    sums = matches.groupBy(*keys).agg(
        angle.alias("a"), F.avg("x1").alias("mx1"), F.avg("y1").alias("my1"),
        F.avg("x2").alias("mx2"), F.avg("y2").alias("my2"), F.count("*").alias("n"),
    )
    c, s = F.cos("a"), F.sin("a")
    return sums.select(
        *keys, c.alias("cos"), s.alias("sin"),
        (F.col("mx2") - c * F.col("mx1") + s * F.col("my1")).alias("tx"),
        (F.col("my2") - s * F.col("mx1") - c * F.col("my1")).alias("ty"),
        "n",
    )


FITS: dict[str, Callable] = {"translation": fit_translation, "rigid": fit_rigid}


def fit_model(matches: DataFrame, kind: str | Model = "rigid", keys: list[str] | None = None) -> DataFrame:
    """Least-squares model of every group; of a model of one's own only where it is defined."""
    keys = keys or ["pair_id"]
    return FITS[kind](matches, keys) if isinstance(kind, str) else kind.fit_matches(matches, keys)


def apply_transform(points: DataFrame, models: DataFrame, amount: float = 1.0, kind: str | Model = "rigid") -> DataFrame:
    """Map ``x, y``; ``amount`` moves a point that fraction of the way."""
    model = model_of(kind)
    return _moved(points, models, model, model.apply, amount)


def apply_inverse(points: DataFrame, models: DataFrame, amount: float = 1.0, kind: str | Model = "rigid") -> DataFrame:
    model = model_of(kind)
    return _moved(points, models, model, model.inverse, amount)


def _moved(points, models, model, function, amount):
    fields = [c for c in points.columns if c not in ("x", "y")]
    held = models.select("pair_id", *(F.col(c).alias(f"_{c}") for c in model.params))
    joined = lookup_join(points, held, ["pair_id"])
    x, y = function({c: F.col(f"_{c}") for c in model.params}, F.col("x"), F.col("y"))
    part = lambda old, new: new if amount == 1.0 else old + (new - old) * amount
    return joined.select(*fields, part(F.col("x"), x).alias("x"), part(F.col("y"), y).alias("y"))


def with_error(matches: DataFrame, models: DataFrame, kind: str | Model = "rigid") -> DataFrame:
    """``error``: distance between the mapped first point and the second."""
    model = model_of(kind)
    joined = lookup_join(matches, models.select("pair_id", *model.params), ["pair_id"])
    return joined.withColumn("error", model.error_column()).select(*matches.columns, "error")


def threshold_inliers(matches: DataFrame, models: DataFrame, eps: float, kind: str | Model = "rigid") -> DataFrame:
    """Matches with a transfer error below ``eps``."""
    return with_error(matches, models, kind).filter(F.col("error") < eps)


def score_model(
    matches: DataFrame, models: DataFrame, eps: float, min_ratio: float, min_n: int, kind: str | Model = "rigid"
) -> DataFrame:
    """Inliers, their share, cost and whether the model passes, per pair."""
    counted = with_error(matches, models, kind).groupBy("pair_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("error") < eps).alias("inliers")
    )
    ratio = F.col("inliers") / F.col("n")
    return counted.select(
        "pair_id", "n", "inliers", ratio.alias("ratio"), (1.0 - ratio).alias("cost"),
        ((F.col("inliers") >= min_n) & (ratio > min_ratio)).alias("good"),
    )


def flip_matches(matches: DataFrame) -> DataFrame:
    """Swap source and target."""
    rest = [c for c in matches.columns if c not in ("x1", "y1", "x2", "y2")]
    swap = [F.col(a).alias(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("x1", "x2"), ("y1", "y2"))]
    return matches.select(*rest, *swap)


def source_points(matches: DataFrame) -> DataFrame:
    return matches.select("pair_id", "match_id", F.col("x1").alias("x"), F.col("y1").alias("y"))


def target_points(matches: DataFrame) -> DataFrame:
    return matches.select("pair_id", "match_id", F.col("x2").alias("x"), F.col("y2").alias("y"))


def point_distance(matches: DataFrame) -> DataFrame:
    """Squared and plain distance of the two points."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    return matches.select("pair_id", "match_id", square.alias("square"), F.sqrt(square).alias("distance"))


@dataclass
class PreparedMatches:
    """Matches in the forms random sampling reads: counted, in random order, in blocks."""

    totals: DataFrame
    ranked: DataFrame
    blocks: DataFrame


def prepare_matches(matches: DataFrame, seed: int = 0, rows: int = TILE_ROWS) -> PreparedMatches:
    """Done once per search. ``place`` (from 0) is the position in a random order of a pair."""
    plain = cut_lineage(matches.select("pair_id", "match_id", "x1", "y1", "x2", "y2"))
    tossed = plain.withColumn("toss", F.xxhash64("pair_id", "match_id", F.lit(seed)))
    numbered = number_rows(tossed, [F.col("pair_id"), F.col("toss"), F.col("match_id")], "no", start=0)
    firsts = numbered.groupBy("pair_id").agg(F.min("no").alias("first"), F.count("*").alias("total"))
    firsts = cut_lineage(firsts)
    ranked = lookup_join(numbered, firsts, ["pair_id"]).withColumn("place", F.col("no") - F.col("first"))
    ranked = cut_lineage(ranked.select("pair_id", "place", "x1", "y1", "x2", "y2"))
    blocks = cut_lineage(pack_blocks(plain, ["pair_id"], ["match_id"], rows).drop("match_id"))
    return PreparedMatches(firsts.select("pair_id", "total"), ranked, blocks)


def draw_hypotheses(
    prepared: PreparedMatches, iterations: int, kind: str | Model, seed: int = 0, only: DataFrame | None = None
) -> DataFrame:
    """Models from random minimal sets: ``pair_id, hyp`` and the parameters.

    A hypothesis takes the matches at random places of the pair, found by equi-join; a set
    that determines no model (two equal points) gives none.
    """
    model = model_of(kind)
    size = model.min_matches
    pairs = prepared.totals if only is None else prepared.totals.join(only, "pair_id", "left_semi")
    tries = pairs.filter(F.col("total") >= size).withColumn("hyp", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    for j in range(size):
        # a place is drawn from the remaining ones, so no two are equal
        pick = F.pmod(draw("pair_id", "hyp", F.lit(seed), F.lit(j)), F.col("total") - j).cast("long")
        if j:
            before = F.array_sort(F.array(*(F.col(f"r{i}") for i in range(j))))
            pick = F.aggregate(before, pick, lambda at, other: F.when(at >= other, at + 1).otherwise(at))
        tries = tries.withColumn(f"r{j}", pick)
    for j in range(size):
        side = prepared.ranked.select("pair_id", F.col("place").alias(f"r{j}"), *(F.col(c).alias(f"{c}_{j}") for c in POINTS))
        tries = tries.join(side, ["pair_id", f"r{j}"])
    fitted, whole = model.minimal([{c: F.col(f"{c}_{j}") for c in POINTS} for j in range(size)], COLUMNS)
    return tries.filter(whole).select("pair_id", "hyp", *(fitted[c].alias(c) for c in model.params))


def _inlier_sums(blocks: DataFrame, models: DataFrame, eps: float, model: Model) -> DataFrame:
    """Moments of the inliers of every (pair, hypothesis), summed over match blocks.

    The models of a pair travel as one row to its blocks; blocks of a large pair are
    salted over tasks, and only sums leave them.
    """
    names = model.sums()
    packed = models.groupBy("pair_id").agg(F.collect_list(F.struct("hyp", *model.params)).alias("m"))
    packed = packed.select("pair_id", *(F.col(f"m.{c}").alias(c) for c in ("hyp", *model.params)))

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                params = {k: np.asarray(getattr(row, k))[:, None] for k in model.params}
                terms = model.row_terms(row.x1, row.y1, row.x2, row.y2)
                sums, step = np.empty((len(row.hyp), len(names))), max(1, SCORED // len(terms))
                for at in range(0, len(row.hyp), step):
                    x, y = model.apply({k: v[at : at + step] for k, v in params.items()}, row.x1, row.y1)
                    x, y = x - row.x2, y - row.y2
                    x *= x
                    y *= y
                    x += y
                    sums[at : at + step] = (x < eps * eps).astype(float) @ terms
                out.append(pd.DataFrame({"pair_id": row.pair_id, "hyp": row.hyp, **dict(zip(names, sums.T))}))
            if out:
                yield pd.concat(out)

    met = lookup_join(blocks, packed, ["pair_id"], salt_by=["block"]).drop("block")
    parts = met.mapInPandas(run, "pair_id LONG, hyp INT, " + ", ".join(f"{n} DOUBLE" for n in names))
    return parts.groupBy("pair_id", "hyp").agg(*(F.sum(n).alias(n) for n in names))


def search_models(
    prepared: PreparedMatches, iterations: int, eps: float, min_ratio: float, min_n: int | None, kind: str | Model, seed: int,
    only: DataFrame | None = None,
) -> DataFrame:
    """The core of ``ransac`` on prepared matches, for the pairs in ``only``."""
    model = model_of(kind)
    params, least = model.params, model.min_matches
    min_n = least if min_n is None else min_n
    settled, need = None, least
    before = draw_hypotheses(prepared, iterations, model, seed, only).withColumn("before", F.lit(0.0))
    while True:
        before = cut_lineage(before)
        if before.isEmpty():
            break
        sums = _inlier_sums(prepared.blocks, before, eps, model)
        scored = cut_lineage(sums.join(before, ["pair_id", "hyp"]).join(prepared.totals, "pair_id"))
        ratio = F.col("n") / F.col("total")
        good = scored.filter((F.col("n") >= need) & (ratio > min_ratio))
        stopped = good.filter("n <= before").select("pair_id", "hyp", *params, F.col("n").alias("inliers"), (1 - ratio).alias("cost"))
        settled = stopped if settled is None else settled.unionByName(stopped)
        # inliers that determine no model end a search: it settles on the model that found them
        grown = good.filter("n > before")
        settled = settled.unionByName(
            grown.filter(~model.defined_column()).select("pair_id", "hyp", *params, F.col("n").alias("inliers"), (1 - ratio).alias("cost"))
        )
        before = grown.filter(model.defined_column()).select("pair_id", "hyp", *model.fit_columns(), F.col("n").alias("before"))
        need = min_n
    if settled is None:  # no pair has enough matches for a hypothesis
        none = [F.lit(0.0).alias(c) for c in (*params, "inliers", "cost")]
        settled = before.select("pair_id", "hyp", *none)
    best = settled.filter(F.col("inliers") >= min_n).groupBy("pair_id").agg(
        F.min_by(F.struct(*params, "inliers", "cost"), F.struct("cost", "hyp")).alias("b")
    )
    return best.select("pair_id", *(F.col(f"b.{c}").alias(c) for c in params), F.col("b.inliers").cast("long").alias("inliers"), "b.cost")


def ransac(
    matches: DataFrame, iterations: int, eps: float, min_ratio: float, min_n: int | None = None,
    kind: str | Model = "rigid", seed: int = 0, rows: int = TILE_ROWS,
) -> DataFrame:
    """Best model per pair: ``pair_id``, the parameters, ``inliers, cost``.

    All hypotheses of all pairs are scored together, then refitted on their inliers while
    these grow. Pairs without an acceptable model give no row.
    """
    return search_models(prepare_matches(matches, seed, rows), iterations, eps, min_ratio, min_n, kind, seed)


def ransac_grow_epsilon(
    matches: DataFrame, min_eps: float, max_eps: float, min_ratio: float, kind: str | Model = "rigid",
    iterations: int = GROW_ITERATIONS, seed: int = 0,
) -> DataFrame:
    """RANSAC with a rising tolerance until several rounds bring no more inliers.

    Pairs that have settled leave the search; the loop ends when none is left.
    """
    model = model_of(kind)
    params = model.params
    prepared = prepare_matches(matches, seed)
    active = cut_lineage(
        prepared.totals.filter(F.col("total") > model.min_matches).select(
            "pair_id", F.lit(0).alias("stale"), F.lit(0).cast("long").alias("most")
        )
    )
    found_any, eps, step = None, 0.0, 0
    while eps < max_eps and not active.isEmpty():
        eps, step = eps + min_eps, step + 1
        found = search_models(prepared, iterations, eps, min_ratio, None, model, seed + step, active)
        state = cut_lineage(active.join(found, "pair_id", "left"))
        grew = F.col("inliers") > F.col("most")
        better = state.filter(grew).select("pair_id", *params, "inliers", "cost", F.lit(eps).alias("eps"))
        found_any = better if found_any is None else found_any.unionByName(better)
        stale = F.when(F.col("inliers").isNull(), F.col("stale")).when(grew, 0).otherwise(F.col("stale") + 1)
        active = cut_lineage(
            state.select(
                "pair_id", stale.alias("stale"), F.greatest("most", F.coalesce("inliers", F.lit(0).cast("long"))).alias("most")
            ).filter(F.col("stale") < GROW_PATIENCE)
        )
    if found_any is None:  # no pair has enough matches
        none = [F.lit(0.0).alias(c) for c in (*params, "cost", "eps")]
        found_any = active.filter("false").select("pair_id", *none, F.lit(0).cast("long").alias("inliers"))
    # inliers only ever rise from one kept model of a pair to the next
    last = found_any.groupBy("pair_id").agg(F.max_by(F.struct(*params, "inliers", "cost", "eps"), "inliers").alias("b"))
    return last.select("pair_id", "b.*")


def _with_counts(judged: DataFrame) -> DataFrame:
    """Add per pair how many matches were judged (``n``) and kept (``left``), then materialise."""
    state = judged.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if("keep").alias("left"))
    return cut_lineage(lookup_join(judged, state, ["pair_id"], salt_by=["pair_id", "match_id"]))


def _progress(judged: DataFrame) -> tuple[bool, int]:
    """Is any pair still losing matches, and how large is the largest of these?"""
    moving = judged.filter("n > left").agg(F.max("left").alias("top")).first()["top"]
    return moving is not None, moving or 0


def trim_outliers(
    matches: DataFrame, max_trust: float = MAX_TRUST, kind: str | Model = "rigid", min_n: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Refit and drop residuals above ``max_trust`` times the median until stable.

    Returns (models, kept matches). Only pairs that still lose matches are worked on
    again; finished rows stay in their round's table. A pair without a model keeps nothing.
    """
    model = model_of(kind)
    min_n = model.min_matches if min_n is None else min_n
    open_ = cut_lineage(matches)
    largest, done = largest_group(open_, ["pair_id"]), None
    while True:
        fitted = fit_model(open_, kind).drop("n")
        errors = cut_lineage(
            lookup_join(open_, fitted, ["pair_id"], salt_by=["pair_id", "match_id"]).withColumn("error", model.error_column())
        )
        limits = group_median(errors.select("pair_id", "error"), ["pair_id"], "error", "mid", largest=largest)
        judged = lookup_join(errors, limits, ["pair_id"], salt_by=["pair_id", "match_id"])
        judged = _with_counts(judged.withColumn("keep", F.col("error") <= F.col("mid") * max_trust))
        stable = judged.filter("n = left")
        done = stable if done is None else done.unionByName(stable)
        moving, largest = _progress(judged)
        if not moving:
            break
        open_ = judged.filter("n > left and keep").select(*matches.columns)
    models = done.groupBy("pair_id").agg(
        *(F.first(c).alias(c) for c in model.params), F.count("*").alias("n"), F.avg("error").alias("mean_error")
    )
    return models.filter(F.col("n") >= min_n), done.select(*matches.columns)


def ransac_trim(
    matches: DataFrame, iterations: int, eps: float, min_ratio: float, min_n: int | None = None,
    max_trust: float = MAX_TRUST, kind: str | Model = "rigid", seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """RANSAC, then trimming of its inliers."""
    best = cut_lineage(ransac(matches, iterations, eps, min_ratio, min_n, kind, seed))
    return trim_outliers(threshold_inliers(matches, best, eps, kind).drop("error"), max_trust, kind, min_n)


def _fit_arrays(kind: str | Model, x1, y1, x2, y2) -> dict | None:
    """``fit_model`` of the matches of one pair."""
    n, model = len(x1), model_of(kind)
    if n == 0:
        return None
    with np.errstate(all="ignore"):
        if isinstance(kind, str):  # about the centroids
            m = [v.mean() for v in (x1, y1, x2, y2)]
            parts = (slice(at, at + TERM_ROWS) for at in range(0, n, TERM_ROWS))
            sums = sum(model.row_terms(*(v[part] - c for v, c in zip((x1, y1, x2, y2), m))).sum(0) for part in parts)
            p = model.fit(dict(zip(model.sums(), sums)), ARRAYS)
            c, s = float(p["cos"]), float(p["sin"])
            return {"cos": c, "sin": s, "tx": m[2] - c * m[0] + s * m[1], "ty": m[3] - s * m[0] - c * m[1]}
        parts = (slice(at, at + TERM_ROWS) for at in range(0, n, TERM_ROWS))
        sums = sum(model.row_terms(*(v[part] for v in (x1, y1, x2, y2))).sum(0) for part in parts)
        sums = dict(zip(model.sums(), sums))
        return model.fit(sums, ARRAYS) if n >= model.min_matches and model.defined(sums, ARRAYS) else None


def _icp_in_tasks(start: DataFrame, q: DataFrame, kind: str | Model, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """``icp`` with all rounds of a pair in a task, the targets indexed once."""
    model, names = model_of(kind), ["pair_id", "query_id", "target_id", "x2", "y2", "x1", "y1"]
    shape = pa.schema([*((c, pa.int64()) for c in names[:3]), *((c, pa.float64()) for c in names[3:]), ("model", pa.list_(pa.float64())), ("settled", pa.bool_())])
    plain = lambda table, name: table.column(name).to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.filter(pc.and_(pc.is_valid(left.column("pair_id")), pc.is_valid(left.column("query_id"))))
        here = [pc.and_(pc.is_valid(right.column(c)), pc.invert(pc.is_nan(right.column(c)))) for c in ("x", "y")]
        right = right.filter(pc.and_(*here))
        if left.num_rows == 0 or right.num_rows == 0:
            return shape.empty_table()
        places = Places(*distinct_places(*(plain(right, c) for c in ("target_id", "x", "y"))))
        queries, x1, y1 = (plain(left, c) for c in ("query_id", "x1", "y1"))
        alone = len(np.unique(queries)) == len(queries)
        x, y = x1, y1
        found = params = was = None
        settled = False
        for _ in range(max_rounds):
            there = ~(np.isnan(x) | np.isnan(y))
            ids, x2, y2, _d = places.nearest(x[there], y[there])
            current = {"query_id": queries[there], "target_id": ids, "x2": x2, "y2": y2, "x1": x1[there], "y1": y1[there]}
            if not alone:  # rows with one query id meet each other's targets, as in a join by that id
                near, own = pd.DataFrame({c: current[c] for c in ("query_id", "target_id", "x2", "y2")}), pd.DataFrame({"query_id": queries, "x1": x1, "y1": y1})
                current = {c: v.to_numpy() for c, v in near.merge(own, on="query_id").items()}
            fitted = _fit_arrays(kind, *(current[c] for c in POINTS))
            if found is None or fitted is not None:
                found = current
            params = fitted or params
            if was is not None:
                if alone and len(was["query_id"]) == len(current["query_id"]):
                    settled = not ((was["query_id"] == current["query_id"]) & (was["target_id"] != current["target_id"])).any()
                else:
                    both = pd.DataFrame({c: current[c] for c in ("query_id", "target_id")}).merge(pd.DataFrame({"query_id": was["query_id"], "was": was["target_id"]}).drop_duplicates(), on="query_id")
                    settled = not (both["target_id"] != both["was"]).any()
            if settled or fitted is None:
                settled = settled or was is not None or max_rounds > 1
                break
            was = {c: current[c] for c in ("query_id", "target_id")}
            x, y = model.apply(fitted, x1, y1)
        n = len(found["query_id"])
        if params:
            held = np.tile([float(params[p]) for p in model.params], n)
            models = pa.ListArray.from_arrays(pa.array(np.arange(0, len(held) + 1, len(model.params)), pa.int32()), pa.array(held))
        else:
            models = pa.nulls(n, shape.field("model").type)
        columns = [pa.repeat(left.column("pair_id")[0], n), *(pa.array(found[c], from_pandas=True) for c in names[1:]), models, pa.repeat(pa.scalar(bool(settled)), n)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    fields = "pair_id LONG, query_id LONG, target_id LONG, x2 DOUBLE, y2 DOUBLE, x1 DOUBLE, y1 DOUBLE, model ARRAY<DOUBLE>, settled BOOLEAN"
    found = cut_lineage(start.groupBy("pair_id").cogroup(q.groupBy("pair_id")).applyInArrow(run, fields))
    models = found.filter("model is not null").groupBy("pair_id").agg(F.first("model").alias("m"), F.count("*").alias("n"), F.first("settled").alias("settled"))
    models = models.select("pair_id", *(F.col("m")[i].alias(c) for i, c in enumerate(model.params)), "n", "settled")
    return models, found.select(*names)


def icp(
    p: DataFrame, q: DataFrame, kind: str | Model = "rigid", max_rounds: int = 50, rows: int = ICP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Match nearest points and refit until the matches stay the same.

    ``p`` is ``(pair_id, query_id, x, y)``, ``q`` is ``(pair_id, target_id, x, y)``. Returns
    (models, matches); every round works on the pairs whose matches still change. A model's
    ``settled`` is false if its pair's matches still changed in the last of ``max_rounds``.
    Pairs of up to ``rows`` points on both sides go through all rounds in a task, side by side.
    """
    start = cut_lineage(p.select("pair_id", "query_id", F.col("x").alias("x1"), F.col("y").alias("y1")))
    q = cut_lineage(q.select("pair_id", "target_id", "x", "y"))
    largest = largest_group(start, ["pair_id"]), largest_group(q, ["pair_id"])
    if max(largest) <= rows:
        return _icp_in_tasks(start, q, kind, max_rounds)
    there = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    cells = target_cells(q.filter(there)) if max(largest) > TILE_ROWS else None  # the targets stay where they are
    moved, previous = p, None
    models = matches = active = None
    for _ in range(max_rounds):
        near = nearest_point(moved, q, largest=largest, cells=cells).select("pair_id", "query_id", "target_id", "x2", "y2")
        current = cut_lineage(near.join(start, ["pair_id", "query_id"]))
        fitted = cut_lineage(fit_model(current, kind))
        if previous is None:
            active = current.select("pair_id").distinct()
            matches, models = current, fitted
        else:
            old = previous.select("pair_id", "query_id", F.col("target_id").alias("was"))
            active = current.join(old, ["pair_id", "query_id"]).filter("target_id <> was").select("pair_id").distinct()
            fresh = fitted.select("pair_id")
            models = cut_lineage(models.join(fresh, "pair_id", "left_anti").unionByName(fitted))
            matches = cut_lineage(lookup_join(matches, fresh.withColumn("_new", F.lit(1)), ["pair_id"], "left").filter("_new is null").drop("_new").select(*current.columns).unionByName(current))
        active = cut_lineage(active)
        if active.isEmpty():
            break
        previous = current
        still = lookup_join(start, active, ["pair_id"]).select(
            "pair_id", "query_id", F.col("x1").alias("x"), F.col("y1").alias("y")
        )
        moved = apply_transform(still, fitted, kind=kind)
    open_ = active.withColumn("_open", F.lit(True))
    models = models.join(open_, "pair_id", "left").withColumn("settled", F.col("_open").isNull()).drop("_open")
    return models, matches


def _nearness(one: dict, other: dict, var2: float) -> np.ndarray:
    """Weight of every match around every candidate, none for itself."""
    dx, dy = one["x1"][:, None] - other["x1"], one["y1"][:, None] - other["y1"]
    w = np.exp(-(dx * dx + dy * dy) / var2)
    w[one["match_id"][:, None] == other["match_id"]] = 0.0
    return w


def _slices(left: dict, others: int):
    """The candidates of a block in runs of at most ``CELLS`` pairs."""
    n = len(left["match_id"])
    step = max(1, CELLS // max(1, others))
    for at in range(0, n, step):
        yield {k: v[at : at + step] for k, v in left.items()}


def _residuals(model: Model, params: np.ndarray, right: dict) -> np.ndarray:
    """Errors of all matches under the model of each candidate (a row of ``params``)."""
    p = {name: params[:, i, None] for i, name in enumerate(model.params)}
    return model.errors(p, *(right[c] for c in POINTS))


def _members(model: Model, past: np.ndarray, right: dict) -> np.ndarray:
    """Which matches a candidate has kept so far: those within every limit of its past models."""
    width = len(model.params) + 1
    kept = np.ones((len(past), len(right["x1"])), bool)
    for at in range(0, past.shape[1], width):
        kept &= _residuals(model, past[:, at : at + width - 1], right) <= past[:, at + width - 1, None]
    return kept


def _trimmed_fits(left: dict, right: dict, model: Model, var2: float, max_trust: float) -> tuple[np.ndarray, np.ndarray]:
    """For candidates whose surroundings are all at hand: parameters, and whether there are any."""
    n, names = len(left["match_id"]), model.sums()
    terms = model.row_terms(*(right[c] for c in POINTS))
    weights, kept = _nearness(left, right, var2), np.ones((n, len(terms)), bool)
    params, found, open_ = np.zeros((n, len(model.params))), np.zeros(n, bool), np.arange(n)
    while len(open_):
        held = kept[open_].sum(1)
        sums = dict(zip(names, ((weights[open_] * kept[open_]) @ terms).T))
        with np.errstate(all="ignore"):
            whole = (held >= model.min_matches) & model.defined(sums, ARRAYS)
            fitted = model.fit(sums, ARRAYS)
        fitted = np.stack([np.broadcast_to(fitted[p], held.shape) for p in model.params], 1)[whole]
        open_, held = open_[whole], held[whole]
        errors = np.where(kept[open_], _residuals(model, fitted, right), np.inf)
        ordered, rows = np.sort(errors, 1), np.arange(len(open_))
        middle = (ordered[rows, (held - 1) // 2] + ordered[rows, held // 2]) / 2
        kept[open_] &= errors <= (middle * max_trust)[:, None]
        same = kept[open_].sum(1) == held
        params[open_[same]], found[open_[same]] = fitted[same], True
        open_ = open_[~same]
    return params, found


def _fits_together(right: dict, at: slice, model: Model, var2: float, max_trust: float):
    """``_local_fits`` of the candidates ``at`` in runs of ``CELLS`` pairs: their places, parameters and sums."""
    places = np.arange(len(right["x1"]))[at]
    for left in _slices({"place": places, **{c: v[at] for c, v in right.items()}}, len(right["x1"])):
        params, found = _trimmed_fits(left, right, model, var2, max_trust)
        left, params = {c: v[found] for c, v in left.items()}, params[found]
        w, errors = _nearness(left, right, var2), _residuals(model, params, right)
        yield left["place"], params, w.sum(1), (w * errors).sum(1)


def _fits_one_by_one(right: dict, at: slice, model: Model, var2: float, max_trust: float):
    """The same for many matches: a candidate's rows stay in the cache, and medians need no sorting."""
    n, names = len(right["x1"]), model.sums()
    ids, x1, y1, x2, y2 = (right[c] for c in ("match_id", *POINTS))
    terms = np.ascontiguousarray(model.row_terms(x1, y1, x2, y2).T)
    w, held_w, apart, kept, within = np.empty(n), np.empty(n), np.empty(n), np.empty(n, bool), np.empty(n, bool)
    places, params, sums = [], [], []
    for i in range(n)[at]:
        np.subtract(x1, x1[i], out=w)
        np.multiply(w, w, out=w)
        np.subtract(y1, y1[i], out=apart)
        np.multiply(apart, apart, out=apart)
        np.exp(np.divide(np.add(w, apart, out=w), -var2, out=w), out=w)
        w[ids == ids[i]] = 0.0
        held_w[:], kept[:], held = w, True, n
        while True:
            total = dict(zip(names, terms @ held_w))
            if held < model.min_matches or not model.defined(total, ARRAYS):
                break
            with np.errstate(all="ignore"):
                p = model.fit(total, ARRAYS)
                errors = model.errors(p, x1, y1, x2, y2)
            own = errors[kept]
            own.partition(held // 2)
            middle = own[held // 2] if held % 2 else (own[: held // 2].max() + own[held // 2]) / 2
            np.logical_and(kept, np.less_equal(errors, middle * max_trust, out=within), out=kept)
            left = np.count_nonzero(kept)
            if left == held:
                places.append(i)
                params.append([float(p[c]) for c in model.params])
                sums.append((w.sum(), w @ errors))
                break
            np.multiply(w, kept, out=held_w)
            held = left
    if places:
        yield np.asarray(places), np.asarray(params), *np.asarray(sums).T


def _local_fits(matches: DataFrame, sigma: float, max_trust: float, model: Model) -> DataFrame:
    """``_local_models`` for pairs that a task can hold, with the weights ``w`` around each match and their
    product ``we`` with the errors, summed over all others.

    The candidates of a pair are shared out; a task has all matches of the pair and some of the candidates.
    """
    n = F.count("*").cast("double")
    packed = matches.filter("pair_id is not null").groupBy("pair_id").agg(
        (n * n).alias("cells"), F.least(F.ceil(n * n / PART_CELLS), F.lit(PARTS)).cast("int").alias("parts"),
        F.collect_list(F.struct("match_id", *POINTS)).alias("r"),
    )
    packed = cut_lineage(packed.select("pair_id", "cells", "parts", *(F.col(f"r.{c}").alias(c) for c in ("match_id", *POINTS))))
    cells = packed.agg(F.coalesce(F.sum("cells"), F.lit(0.0))).first()[0]
    tasks = max(matches.sparkSession.sparkContext.defaultParallelism, min(4096, int(2 * cells / PART_CELLS)))
    dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("cells").repartition(tasks, "pair_id", "part")
    var2 = 2.0 * sigma * sigma

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                right = {c: np.ascontiguousarray(row[c]) for c in ("match_id", *POINTS)}
                fits = _fits_together if len(right["x1"]) < ONE_BY_ONE else _fits_one_by_one
                for places, params, w, we in fits(right, slice(row["part"], None, row["parts"]), model, var2, max_trust):
                    yield pd.DataFrame({"pair_id": row["pair_id"], "match_id": right["match_id"][places], **dict(zip(model.params, params.T)), "w": w, "we": we})

    fields = ", ".join(f"{c} DOUBLE" for c in (*model.params, "w", "we"))
    return dealt.mapInPandas(run, f"pair_id LONG, match_id LONG, {fields}")


@dataclass
class _Surroundings:
    """The matches around the candidates of a pass: rows, blocks of them, and their largest pair."""

    matches: DataFrame
    blocks: DataFrame
    rows: int
    largest: int

    def tiles(self, candidates: DataFrame, kernel: Callable, schema: str) -> DataFrame:
        """``kernel(left, right)`` for every block of candidates and block of matches of a pair,
        each a dict of arrays; it returns columns that are merged afterwards."""
        packed = pack_blocks(candidates, ["pair_id"], ["match_id"], self.rows)
        own = [c for c in packed.columns if c not in ("pair_id", "block")]
        other = self.blocks.select("pair_id", F.col("block").alias("_other"), *(F.col(c).alias(f"_r_{c}") for c in ("match_id", *POINTS)))
        met = lookup_join(packed, other.select("pair_id", "_other"), ["pair_id"], salt_by=["pair_id", "block"])
        met = met.join(other, ["pair_id", "_other"]).drop("block", "_other")

        def run(frames):
            for pdf in frames:
                for row in pdf.to_dict("records"):
                    right = {c: row[f"_r_{c}"] for c in ("match_id", *POINTS)}
                    left = {c: np.stack(row[c]) if c == "past" else row[c] for c in own}
                    for part in _slices(left, len(right["x1"])):
                        yield pd.DataFrame({"pair_id": row["pair_id"], **kernel(part, right)})

        return met.mapInPandas(run, "pair_id LONG, match_id LONG, " + schema)


def _local_models(around: _Surroundings, sigma: float, max_trust: float, model: Model) -> DataFrame:
    """Model around each match, trimmed: ``pair_id, match_id`` and the parameters, for those that have one.

    The others are weighted by their distance and fitted; those whose error exceeds
    ``max_trust`` times the median error of the matches still held go, and so on until none
    goes. No task sees all matches of a pair: sums come back for the fit, and the median is found
    by histograms (``_medians``). What a candidate holds is never stored: its past models and limits
    say it. Pairs that a task can hold go through ``_local_fits``.
    """
    var2, key, names = 2.0 * sigma * sigma, ["pair_id", "match_id"], model.sums()

    def sums_kernel(left, right):
        held = _members(model, left["past"], right)
        sums = (_nearness(left, right, var2) * held) @ model.row_terms(*(right[c] for c in POINTS))
        return {"match_id": left["match_id"], "held": held.sum(1), **dict(zip(names, sums.T))}

    fields = "held LONG, " + ", ".join(f"{n} DOUBLE" for n in names)
    open_ = around.matches.withColumn("past", F.array().cast("array<double>")).withColumn("was", F.lit(0).cast("long"))
    done = None
    while True:
        parts = around.tiles(open_.drop("was"), sums_kernel, fields)
        sums = parts.groupBy(*key).agg(F.sum("held").alias("held"), *(F.sum(n).alias(n) for n in names))
        judged = cut_lineage(open_.join(sums, key))
        # nothing went: the last model was fitted to just these
        size = len(model.params) + 1
        last = [F.expr(f"past[size(past) - {size} + {i}]").alias(p) for i, p in enumerate(model.params)]
        stable = judged.filter("held = was").select(*key, *last)
        done = stable if done is None else done.unionByName(stable)
        moving = judged.filter("held <> was").filter((F.col("held") >= model.min_matches) & model.defined_column())
        open_ = cut_lineage(moving.select(*key, *POINTS, "past", F.col("held").alias("was"), *model.fit_columns()))
        if open_.isEmpty():
            return cut_lineage(done)
        limits = _medians(around, open_, model).select(*key, (F.col("median") * max_trust).alias("_limit"))
        open_ = open_.join(limits, key).select(*key, *POINTS, F.concat("past", F.array(*model.params, "_limit")).alias("past"), "was")
        open_ = cut_lineage(open_)


def _medians(around: _Surroundings, candidates: DataFrame, model: Model) -> DataFrame:
    """Exact median error, under each candidate's model, of the ``was`` matches it holds.

    Errors are not negative, so they sort as the whole numbers their bits are. A histogram of
    32 buckets between two of them, with the least and greatest error of each bucket, is summed
    over the blocks; the bucket with the middle is divided next, until it holds one value. The
    upper middle of an even number is that value again or the least above it.
    """
    key = ["pair_id", "match_id"]

    def histogram(left, right):
        params = np.stack([left[p] for p in model.params], 1)
        errors = _residuals(model, params, right)
        bits, low, high = (np.ascontiguousarray(a).view(np.int64) for a in (errors, left["low"], left["high"]))
        at, other = np.nonzero(_members(model, left["past"], right) & (bits >= low[:, None]) & (bits <= high[:, None]))
        own = errors[at, other]
        place = at * BUCKETS + (bits[at, other] - low[at]) // ((high - low) // BUCKETS + 1)[at]
        order = np.lexsort((own, place))
        place, own = place[order], own[order]
        met, first, count = np.unique(place, return_index=True, return_counts=True)
        return {
            "match_id": left["match_id"][met // BUCKETS], "bucket": met % BUCKETS, "n": count, "least": own[first], "most": own[first + count - 1]
        }

    columns = [*key, *POINTS, "past", *model.params, "rank", "even", "low", "high", "above"]
    open_ = candidates.select(
        *key, *POINTS, "past", *model.params, F.expr("(was - 1) div 2").alias("rank"), (F.col("was") % 2 == 0).alias("even"),
        F.lit(0.0).alias("low"), F.lit(float(np.finfo(float).max)).alias("high"), F.lit(None).cast("double").alias("above"),
    )
    done = None
    while True:
        parts = around.tiles(open_.drop("rank", "even", "above"), histogram, "bucket LONG, n LONG, least DOUBLE, most DOUBLE")
        buckets = parts.groupBy(*key, "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        lists = buckets.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "least", "most"))).alias("h"))  # at most 32
        found = open_.join(lists, key)
        # the bucket of the rank, what lies before it, and the least value after it
        start = F.struct(
            F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("least"),
            F.lit(None).cast("double").alias("most"), F.lit(None).cast("double").alias("next"),
        )

        def step(s, b):
            hit = s["n"].isNull() & (F.col("rank") < s["before"] + b["n"])
            return F.struct(
                F.when(s["n"].isNull() & ~hit, s["before"] + b["n"]).otherwise(s["before"]).alias("before"),
                F.when(hit, b["n"]).otherwise(s["n"]).alias("n"),
                F.when(hit, b["least"]).otherwise(s["least"]).alias("least"),
                F.when(hit, b["most"]).otherwise(s["most"]).alias("most"),
                F.when(s["n"].isNotNull() & s["next"].isNull(), b["least"]).otherwise(s["next"]).alias("next"),
            )

        found = found.withColumn("b", F.aggregate("h", start, step)).withColumn("rank", F.col("rank") - F.col("b.before"))
        found = found.withColumn("above", F.coalesce("b.next", "above")).withColumns({"low": F.col("b.least"), "high": F.col("b.most")})
        found = cut_lineage(found.withColumn("inside", F.col("b.n")).select(*columns, "inside"))
        upper = F.when(F.col("even") & (F.col("rank") + 1 >= F.col("inside")), F.col("above")).otherwise(F.col("low"))
        settled = found.filter("low = high").select(*key, ((F.col("low") + upper) / 2).alias("median"))
        done = settled if done is None else done.unionByName(settled)
        open_ = found.filter("low < high").select(*columns)
        if open_.isEmpty():
            return cut_lineage(done)


def _local_error(around: _Surroundings, candidates: DataFrame, sigma: float, model: Model) -> DataFrame:
    """Weighted mean error of the surroundings under each candidate's local model."""

    def kernel(left, right):
        w = _nearness(left, right, 2.0 * sigma * sigma)
        errors = _residuals(model, np.stack([left[p] for p in model.params], 1), right)
        return {"match_id": left["match_id"], "w": w.sum(1), "we": (w * errors).sum(1)}

    parts = around.tiles(candidates, kernel, "w DOUBLE, we DOUBLE")
    return parts.groupBy("pair_id", "match_id").agg((F.sum("we") / F.sum("w")).alias("mean_error"))


def local_smoothness_filter(
    matches: DataFrame, sigma: float, max_eps: float, max_trust: float, kind: str | Model = "rigid", rows: int = WHOLE_ROWS
) -> DataFrame:
    """Keep matches that agree with a trimmed local fit around them.

    Around each match the others of its pair are weighted by a Gaussian of ``sigma`` and
    fitted, with those above ``max_trust`` times the median error trimmed (``_local_models``). The
    match goes when its error under this model exceeds ``max_eps`` or ``max_trust`` times the
    weighted mean error of all others; repeated while matches go. A pair in which any match's
    surroundings give no model keeps none, and so does one left with fewer matches than the
    model needs. Two matches of a pair with equal ids count as one match seen twice. Pairs of up to
    ``rows`` matches are held by the tasks that fit around their matches; larger ones are cut into blocks
    of at most ``TILE_ROWS``. Either way every match meets every other, in each round of trimming.
    """
    model = model_of(kind)
    columns, key = ["pair_id", "match_id", *POINTS], ["pair_id", "match_id"]
    open_, done = cut_lineage(matches.select(*columns)), None
    largest, block = largest_group(open_, ["pair_id"]), min(rows, TILE_ROWS)
    alone = largest_group(open_, key) <= 1
    while True:
        around = None
        if largest > rows or not alone:
            around = _Surroundings(open_, cut_lineage(pack_blocks(open_, ["pair_id"], ["match_id"], block)), block, largest)
        fits = _local_fits(open_, sigma, max_trust, model) if largest <= rows else _local_models(around, sigma, max_trust, model)
        local = cut_lineage(open_.join(fits, key).withColumn("error", model.error_column()))
        if around is None:
            means = local.select(*key, (F.col("we") / F.col("w")).alias("mean_error"))
        else:
            means = _local_error(around, local.select(*columns, *model.params), sigma, model)
        agrees = (F.col("error") <= max_eps) & (F.col("error") <= max_trust * F.col("mean_error"))
        verdicts = local.select(*key, "error").join(means, key).select(*key, F.coalesce(agrees, F.lit(False)).alias("keep"))
        judged = cut_lineage(open_.join(verdicts, key, "left"))
        lost = judged.filter("keep is null").select("pair_id").distinct()
        judged = _with_counts(judged.join(lost, "pair_id", "left_anti"))
        stable = judged.filter((F.col("n") == F.col("left")) & (F.col("left") >= model.min_matches)).select(*columns)
        done = stable if done is None else done.unionByName(stable)
        moving, largest = _progress(judged)
        if not moving:
            return done
        open_ = judged.filter("n > left and keep").select(*columns)
