"""One step of the spatial topic model: patches choose region documents of their image by topic and distance.

A patch n (a visual word at x, y) belongs to region document m of its image with responsibility

    rho_mn  ~  exp( sum_k xi_nk E[log pi_mk]  -  dist(m, n)^2 / sigma^2 )      (sums to 1 over m)
    xi_nk   ~  exp( sum_m rho_mn E[log pi_mk]  +  E[log phi_k,w(n)] )          (sums to 1 over k)
    gamma_mk = alpha_k + sum_n rho_mn xi_nk
    lambda_kv = beta + sum over n with w(n) = v of xi_nk

with E[log pi_mk] = digamma(gamma_mk) - digamma(sum_k' gamma_mk'), the expectation under the
Dirichlet of region m, and E[log phi_kv] = digamma(lambda_kv) - digamma(sum_v' lambda_kv').
The prior of a region and the word's own term are equal for all regions and cancel in rho.

Patches and regions meet by image, or by cells of the distance bound, in blocks; a block pair
returns per patch a shifted sum (merged like log-sums), per region a sum over patches.
Responsibilities are never stored: the second pass computes them again from a patch's total.

Shapes: patches ``(image_id, patch_id, x, y, term_id, xi ARRAY)``, regions ``(image_id,
region_id, x, y, gamma ARRAY)``, terms ``(term_id, weight ARRAY)``: the weights are lambda.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclens.functions.special import digamma
from topiclens.session import cut_lineage
from topiclens.spread import TILE_ROWS, largest_group, lookup_join, tile_join

CELLS = 1 << 20  # (patch, region) pairs looked at together


@dataclass
class SpatialState:
    """What a step takes and returns. After a step patches also have ``region_id`` and ``rho``:
    the region of the largest responsibility (ties: the smaller id) and that responsibility."""

    patches: DataFrame
    regions: DataFrame
    terms: DataFrame


def region_grid(sizes: DataFrame, step: int) -> DataFrame:
    """Regions ``(image_id, region_id, x, y)`` every ``step`` pixels, from half a step on, line by
    line; an image of ``(image_id, width, height)`` has at least one."""
    across, down = (F.greatest(F.lit(1), F.expr(f"({side} + {step - step // 2 - 1}) div {step}")) for side in ("width", "height"))
    grid = sizes.select("image_id", across.alias("nx"), down.alias("ny")).withColumn("region_id", F.explode(F.sequence(F.lit(0), (F.col("nx") * F.col("ny") - 1).cast("int"))))
    place = lambda index: (F.lit(step // 2) + index * step).cast("double")
    return grid.select("image_id", "region_id", place(F.expr("region_id % nx")).alias("x"), place(F.expr("region_id div nx")).alias("y"))


def _expected_log(values: Column) -> Column:
    """digamma of each value less digamma of their sum."""

    @F.pandas_udf("array<double>")
    def expected(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        g = np.stack(rows)
        return pd.Series(list(digamma(g) - digamma(g.sum(1))[:, None]))

    return expected(values)


def _expected_terms(terms: DataFrame, totals: np.ndarray) -> DataFrame:
    below = digamma(totals)

    @F.pandas_udf("array<double>")
    def expected(rows: pd.Series) -> pd.Series:
        return pd.Series(list(digamma(np.stack(rows)) - below)) if len(rows) else pd.Series([], dtype=object)

    return terms.select("term_id", expected("weight").alias("log_word"))


def _vector_sum(rows: DataFrame, keys: Sequence[str], vector: str, name: str) -> DataFrame:
    """Sum of equally long vectors of a group, element by element: partial aggregates only."""
    spread = rows.select(*keys, F.posexplode(vector).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    packed = spread.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_l"))  # one entry for each topic
    return packed.select(*keys, F.col("_l._v").alias(name))


def _logits(patch, region, sigma: float, reach: float | None) -> np.ndarray:
    """Of patches by regions: log responsibility up to the patch's total; minus infinity beyond reach."""
    dx = patch["x"].to_numpy()[:, None] - region["x"].to_numpy()
    dy = patch["y"].to_numpy()[:, None] - region["y"].to_numpy()
    away = dx * dx + dy * dy
    logits = np.stack(patch["xi"]) @ np.stack(region["log_topic"]).T - away / (sigma * sigma)
    if reach is not None:
        logits[away > reach * reach] = -np.inf
    return logits


def _slices(frame: pd.DataFrame, others: int):
    step = max(1, CELLS // max(1, others))
    for at in range(0, len(frame), step):
        yield frame.iloc[at : at + step]


def _pull(sigma: float, reach: float | None):
    """Per patch of a block pair: largest logit, the sums shifted by it, and the region it is of."""
    columns = ["image_id", "patch_id", "top", "total", "pull", "region_id"]

    def kernel(patches, regions):
        out = []
        if len(patches) and len(regions):
            regions = regions.sort_values("region_id", ignore_index=True)
            topics = np.stack(regions["log_topic"])
            for part in _slices(patches, len(regions)):
                logits = _logits(part, regions, sigma, reach)
                at = logits.argmax(1)
                top = logits[np.arange(len(at)), at]
                met = np.isfinite(top)
                shifted = np.exp(logits[met] - top[met, None])
                out.append(pd.DataFrame({
                    "image_id": part["image_id"].to_numpy()[met], "patch_id": part["patch_id"].to_numpy()[met], "top": top[met],
                    "total": shifted.sum(1), "pull": list(shifted @ topics), "region_id": regions["region_id"].to_numpy()[at[met]],
                }))
        return pd.concat(out) if sum(map(len, out)) else pd.DataFrame({c: [] for c in columns}, dtype=object)

    return kernel


def _share(sigma: float, reach: float | None):
    """Per region of a block pair: the responsibilities of its patches, times their new topics."""

    def kernel(regions, patches):
        out = []
        if len(patches) and len(regions):
            for part in _slices(patches, len(regions)):
                rho = np.exp(_logits(part, regions, sigma, reach) - part["norm"].to_numpy()[:, None])
                out.append(rho.T @ np.stack(part["new_xi"]))
        if not out:
            return pd.DataFrame({c: [] for c in ("image_id", "region_id", "share")}, dtype=object)
        return pd.DataFrame({"image_id": regions["image_id"], "region_id": regions["region_id"], "share": list(sum(out))})

    return kernel


def spatial_lda_step(
    state: SpatialState, alpha: Sequence[float], beta: float, sigma: float, reach: float | None = None, rows: int = TILE_ROWS
) -> SpatialState:
    """One round of the updates above: rho from the given state, then xi, gamma and lambda from it.

    With ``reach`` a region beyond that distance has no responsibility for a patch, and the two
    are not compared (patches meet the regions of their own and the eight cells around); ``None``
    compares every patch with every region of its image. A patch without a region, be it out of
    reach or in an image that has none, keeps its ``xi``, has null ``region_id`` and ``rho`` and
    counts in no sum. A region without patches goes back to ``alpha``, a term without patches to
    ``beta``; a patch's term that is not among the terms counts as one of weight ``beta`` and joins
    them. Rows with a null in x, y, xi, gamma or weight are an error of the caller's.
    """
    keys = ["image_id"]
    topics = len(alpha)
    patches = state.patches.select("image_id", "patch_id", "x", "y", "term_id", "xi")
    regions = cut_lineage(state.regions.select("image_id", "region_id", "x", "y", _expected_log(F.col("gamma")).alias("log_topic")))
    placed, around = patches, regions
    if reach is not None:
        cell = lambda c: F.floor(F.col(c) / reach)
        keys = ["image_id", "cx", "cy"]
        placed = patches.withColumns({"cx": cell("x"), "cy": cell("y")})
        beside = F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        around = regions.withColumn("c", F.explode(beside)).select("*", "c.cx", "c.cy").drop("c")
    placed = cut_lineage(placed)
    around = around if reach is None else cut_lineage(around)
    sizes = largest_group(placed, keys), largest_group(around, keys)
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in (*patches.schema, *regions.schema))}
    ids = lambda *names: ", ".join(f"{c} {kinds[c]}" for c in names)

    parts = tile_join(
        placed.select(*keys, "patch_id", "x", "y", "xi"), around.select(*keys, "region_id", "x", "y", "log_topic"), keys, ["patch_id"], ["region_id"],
        _pull(sigma, reach), f"{ids('image_id', 'patch_id')}, top DOUBLE, total DOUBLE, pull ARRAY<DOUBLE>, {ids('region_id')}", rows, sizes,
    )
    # one entry for each block of regions
    met = parts.groupBy("image_id", "patch_id").agg(F.collect_list(F.struct("top", "total", "pull")).alias("p"), F.max("top").alias("top"), F.min(F.struct(-F.col("top"), "region_id")).alias("b"))
    scaled = F.transform("p", lambda e: F.struct((e["total"] * F.exp(e["top"] - F.col("top"))).alias("total"), F.transform(e["pull"], lambda v: v * F.exp(e["top"] - F.col("top"))).alias("pull")))
    zero = F.struct(F.lit(0.0).alias("total"), F.array_repeat(F.lit(0.0), topics).alias("pull"))
    added = F.aggregate(scaled, zero, lambda s, e: F.struct((s["total"] + e["total"]).alias("total"), F.zip_with(s["pull"], e["pull"], lambda a, b: a + b).alias("pull")))
    met = met.select("image_id", "patch_id", "top", F.col("b.region_id").alias("region_id"), added.alias("s")).select(
        "image_id", "patch_id", "region_id", (F.col("top") + F.log("s.total")).alias("norm"), (1.0 / F.col("s.total")).alias("rho"),
        F.transform("s.pull", lambda v: v / F.col("s.total")).alias("pull"),
    )

    totals = {r.k: r.v for r in state.terms.select(F.posexplode("weight").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()}  # K numbers
    totals = np.array([totals.get(k, 0.0) for k in range(topics)])
    joined = lookup_join(placed.join(met, ["image_id", "patch_id"], "left"), _expected_terms(state.terms, totals), ["term_id"], "left", salt_by=["image_id", "patch_id"])
    with np.errstate(all="ignore"):
        unseen = digamma(beta) - digamma(np.where(totals > 0, totals, math.nan))
    unseen = F.array(*(F.lit(float(v) if v == v else 0.0) for v in unseen))
    raw = F.zip_with(F.col("pull"), F.coalesce("log_word", unseen), lambda a, b: a + b)
    joined = joined.withColumn("raw", raw).withColumn("raw", F.transform("raw", lambda v: F.exp(v - F.array_max("raw"))))
    fresh = F.transform("raw", lambda v: v / F.aggregate("raw", F.lit(0.0), lambda s, e: s + e))
    joined = cut_lineage(joined.withColumn("new_xi", F.coalesce(fresh, F.col("xi"))).drop("raw", "pull", "log_word"))
    held = joined.filter("norm is not null")

    shares = tile_join(
        around.select(*keys, "region_id", "x", "y", "log_topic"), held.select(*keys, "patch_id", "x", "y", "xi", "norm", "new_xi"), keys, ["region_id"], ["patch_id"],
        _share(sigma, reach), f"{ids('image_id', 'region_id')}, share ARRAY<DOUBLE>", rows, (sizes[1], sizes[0]),
    )
    prior = F.array(*(F.lit(float(a)) for a in alpha))
    gamma = F.coalesce(F.zip_with(prior, F.col("share"), lambda a, s: a + s), prior)
    new_regions = state.regions.drop("gamma").join(_vector_sum(shares, ["image_id", "region_id"], "share", "share"), ["image_id", "region_id"], "left")
    words = _vector_sum(held.select("term_id", "new_xi"), ["term_id"], "new_xi", "sum")
    floor = F.array_repeat(F.lit(float(beta)), topics)
    new_terms = state.terms.select("term_id").join(words, "term_id", "full").select(
        "term_id", F.coalesce(F.transform("sum", lambda s: s + beta), floor).alias("weight")
    )
    return SpatialState(
        joined.select("image_id", "patch_id", "x", "y", "term_id", F.col("new_xi").alias("xi"), "region_id", "rho"),
        new_regions.select("image_id", "region_id", "x", "y", gamma.alias("gamma")),
        new_terms,
    )
