"""Vector quantisation: seeding, assignment, centre updates, k-means and code maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topiclens.functions.arrow import matrix, square_distances
from topiclens.functions.scalars import draw, patch_name
from topiclens.session import cut_lineage, remove_round, write_round
from topiclens.sources.side import read_side, write_side
from topiclens.spread import lookup_join, number_rows

CENTER_CELLS = 8_000_000  # numbers of the codebook a task may keep
BLOCK_CENTERS, BLOCK_POINTS = 4096, 1024  # compared at once
ROWS_PER_LIST = 65_536


def sample_rows(df: DataFrame, ratio: float, key: list[str], seed: int = 0) -> DataFrame:
    """Keep a row when the draw of its key falls below ``ratio``; same rows on every run."""
    return df.filter(draw(*key, F.lit(seed)) < ratio * (1 << 32))


def shuffle_rows(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """Random order that depends only on the key and the seed."""
    return df.orderBy(draw(*key, F.lit(seed)), *key)


def renumber_clusters(centers: DataFrame, key: str = "seed_id") -> DataFrame:
    """Codes 1..K in key order."""
    return number_rows(centers, [F.col(key)], "code").withColumn("code", F.col("code").cast("int"))


def seed_centers(points: DataFrame, k: int, key: str, vec: str = "desc", seed: int = 0) -> DataFrame:
    """``k`` random rows as first centres, numbered from 1 in draw order."""
    toss = draw(key, F.lit(seed)).alias("toss")
    chosen = points.select(F.col(key).alias("seed_id"), F.col(vec).alias("center"), toss)
    chosen = chosen.orderBy("toss", "seed_id").limit(k)
    return number_rows(chosen, [F.col("toss"), F.col("seed_id")], "code").select(
        F.col("code").cast("int").alias("code"), "seed_id", "center"
    )


class _Codebook:
    """Inside a task: the centres of a side table, kept while they have at most ``cells`` numbers."""

    def __init__(self, path: str, cells: int):
        self.path, self.cells, self.kept = path, cells, None

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Codes, vectors and shifts, ``BLOCK_CENTERS`` centres at a time."""
        if self.kept is not None:
            yield from self.kept
            return
        kept, held = [], 0
        for batch in read_side(self.path, BLOCK_CENTERS):
            if batch.num_rows:
                shift = batch.column("shift").to_numpy() if "shift" in batch.schema.names else np.zeros(batch.num_rows)
                block = batch.column("code").to_numpy(), matrix(batch, "center"), shift
                held += block[1].size
                kept = None if kept is None or held > self.cells else [*kept, block]
                yield block
        self.kept = kept  # None: too large, read again for the next points

    def two_nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code and square distance of the nearest centre, and the square distance of the next one."""
        n = len(points)
        code, best, second = np.zeros(n, np.int32), np.full(n, np.inf), np.full(n, np.inf)
        for codes, vectors, _ in self.blocks():
            for at in range(0, n, BLOCK_POINTS):
                some = slice(at, at + BLOCK_POINTS)
                d = square_distances(points[some], vectors)
                order = np.lexsort((codes,))  # equal distances: the lower code
                d, own = d[:, order], codes[order]
                rows = np.arange(len(d))
                near = d.argmin(1)
                first = d[rows, near]
                d[rows, near] = np.inf
                other = d.min(1)
                wins = (first < best[some]) | ((first == best[some]) & (own[near] < code[some]))
                second[some] = np.minimum(np.where(wins, best[some], first), np.minimum(second[some], other))
                code[some], best[some] = np.where(wins, own[near], code[some]), np.where(wins, first, best[some])
        return code, best, second


def assign_clusters(
    points: DataFrame, centers: DataFrame, key: list[str], vec: str = "desc", cells: int = CENTER_CELLS
) -> DataFrame:
    """Nearest centre of every point: adds ``code`` and ``dist``; equal distances take the lower code.

    The points stay where they are. The codebook is a side table: tasks read it in blocks and
    keep it while it has at most ``cells`` numbers; a larger one is read again for each batch.
    """
    path = write_side(centers.select("code", "center"))
    fields = [T.StructField("code", T.IntegerType()), T.StructField("dist", T.DoubleType())]

    def nearest(batches):
        book = _Codebook(path, cells)
        for batch in batches:
            if batch.num_rows:
                code, best, _ = book.two_nearest(matrix(batch, vec))
                yield batch.append_column("code", pa.array(code)).append_column("dist", pa.array(np.sqrt(best)))

    return points.mapInArrow(nearest, T.StructType([*points.schema.fields, *fields]))


def update_centers(assigned: DataFrame, vec: str = "desc") -> DataFrame:
    """Mean vector and size of every cluster; partial means are merged before the shuffle."""
    means = assigned.groupBy("code").agg(
        Summarizer.mean(array_to_vector(vec)).alias("m"), F.count("*").alias("n")
    )
    return means.select("code", vector_to_array("m").alias("center"), "n")


def build_codebook(
    points: DataFrame, k: int = 1024, max_iter: int = 100, tol: float = 1e-5, seed: int = 0, vec: str = "desc"
) -> DataFrame:
    """``(code, center)`` by Lloyd k-means from ``k`` random rows, codes from 1."""
    spark = points.sparkSession
    vectors = points.select(array_to_vector(vec).alias("features"))
    fitted = KMeans(k=k, maxIter=max_iter, tol=tol, seed=seed, initMode="random").fit(vectors)
    rows = [(i + 1, [float(v) for v in c]) for i, c in enumerate(fitted.clusterCenters())]
    return spark.createDataFrame(rows, "code INT, center ARRAY<DOUBLE>")


def _bounded_round(state: DataFrame, path: str, vec: str, cells: int, measured=None) -> DataFrame:
    """Codes of all points under moved centres: ``code, upper, lower`` are replaced.

    ``upper`` is at least the distance to a point's centre and ``lower`` at most that to any
    other. They widen by the centres' shifts; where they still part, the code stands and no
    distance is measured. The slack is above the rounding of the distances, so codes are those
    of a full search. ``measured`` adds up the points that were searched.
    """

    def step(batches):
        book, shifts = _Codebook(path, cells), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if shifts is None:
                codes, moves, sizes = zip(*((c, s, np.sqrt((v * v).sum(1)).max()) for c, v, s in book.blocks()))
                codes, moves, reach = np.concatenate(codes), np.concatenate(moves), max(sizes)
                order = np.argsort(codes)
                shifts, codes, most = moves[order], codes[order], moves.max()
            rest = batch.select([c for c in batch.schema.names if c not in ("code", "upper", "lower")])
            points = matrix(batch, vec)
            code, upper, lower = (batch.column(c).to_numpy().copy() for c in ("code", "upper", "lower"))
            upper += shifts[np.minimum(np.searchsorted(codes, code), len(codes) - 1)]
            lower -= most
            slack = 1e-6 * (np.sqrt((points * points).sum(1)) + reach)
            open_ = np.flatnonzero(~(upper + slack < lower))
            if len(open_):
                code[open_], best, second = book.two_nearest(points[open_])
                upper[open_], lower[open_] = np.sqrt(best), np.sqrt(second)
                if measured is not None:
                    measured.add(len(open_))
            yield rest.append_column("code", pa.array(code)).append_column("upper", pa.array(upper)).append_column("lower", pa.array(lower))

    return state.mapInArrow(step, state.schema)


def lloyd_codebook(
    points: DataFrame, centers: DataFrame, key: list[str], max_iter: int = 100, tol: float = 1e-5, vec: str = "desc",
    cells: int = CENTER_CELLS, measured=None,
) -> DataFrame:
    """Lloyd rounds from given centres; a centre that loses all points keeps its place.

    Points carry bounds of their distances from round to round, so that only those near a
    border are searched again (``_bounded_round``); tables of past rounds are deleted. Nothing but
    the largest shift reaches the driver.
    """
    spark = points.sparkSession
    unknown = {"code": F.lit(0), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}
    state, old = points.select(*key, vec).withColumns(unknown), None
    centers = cut_lineage(centers.select("code", "center").withColumn("shift", F.lit(0.0)))
    for _ in range(max_iter):
        side = write_side(centers)
        state, path = write_round(_bounded_round(state, side, vec, cells, measured))
        means = update_centers(state, vec).select("code", F.col("center").alias("mean"))
        gap = F.aggregate(F.zip_with("center", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        moved = centers.drop("shift").join(means, "code", "left").select(
            "code", F.coalesce("mean", "center").alias("center"), F.coalesce(F.sqrt(gap), F.lit(0.0)).alias("shift")
        )
        centers = cut_lineage(moved)
        for past in (side, old):
            if past is not None:
                remove_round(spark, past)
        old = path
        if (centers.agg(F.max("shift").alias("s")).first()["s"] or 0.0) <= tol:
            break
    if old is not None:
        remove_round(spark, old)
    return centers.select("code", "center")


def build_codebook_sampled(
    points: DataFrame, ratio: float, key: list[str], k: int = 1024, max_iter: int = 100, tol: float = 1e-5,
    seed: int = 0, vec: str = "desc",
) -> tuple[DataFrame, DataFrame]:
    """Fit on a sample, assign all points: ``(centers, assigned)``."""
    centers = build_codebook(sample_rows(points, ratio, key, seed), k, max_iter, tol, seed, vec)
    return centers, assign_clusters(points, centers, key, vec)


def apply_codebook(points: DataFrame, centers: DataFrame, key: list[str], vec: str = "desc") -> DataFrame:
    """Assign only, with given centres."""
    return assign_clusters(points, centers, key, vec)


def _parts_in_order(df: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    """Add ``part`` and the size ``n`` of each ``key``: its rows in ``order``, ``rows`` to a part."""
    placed = number_rows(df, [F.col(key), *map(F.col, order)], "_place", 0)
    sizes = placed.groupBy(key).agg(F.min("_place").alias("_from"), F.count("*").alias("n"))
    return lookup_join(placed, sizes, [key]).withColumn("part", F.expr(f"cast((_place - _from) div {rows} as int)")).drop("_place", "_from")


def cluster_members(assigned: DataFrame, name, rows_per_list: int = ROWS_PER_LIST) -> DataFrame:
    """``(code, part, members, n)``: sorted member names of every cluster and its size.

    Lists are cut at every ``rows_per_list`` names in sort order, so that the parts in turn
    are the sorted list and no task holds a whole large cluster.
    """
    named = assigned.select("code", name.alias("member"))
    listed = _parts_in_order(named, "code", ["member"], rows_per_list)
    return listed.groupBy("code", "part").agg(
        F.array_sort(F.collect_list("member")).alias("members"), F.first("n").alias("n")
    )


def cluster_report(points: DataFrame, k: int, key: list[str], name, tol: float = 1e-3, max_iter: int = 100, seed: int = 0, vec: str = "desc") -> DataFrame:
    """Vectors to a readable list of members per cluster."""
    centers = build_codebook(points, k, max_iter, tol, seed, vec)
    return cluster_members(assign_clusters(points, centers, key, vec), name)


def last_code(codes: DataFrame, order: str) -> DataFrame:
    """One code per patch position; the highest ``order`` wins."""
    return codes.groupBy("image_id", "x", "y").agg(F.max_by("code", order).alias("code"))


def collect_code_map(codes: DataFrame, rows_per_map: int = ROWS_PER_LIST) -> DataFrame:
    """``(image_id, part, patches)``: the code map of each image as a sorted list of entries.

    Maps are cut at every ``rows_per_map`` patches in order of position. Positions must
    be unique (see ``last_code``); ``map_from_entries`` over the list gives the map form.
    """
    placed = _parts_in_order(codes, "image_id", ["x", "y"], rows_per_map)
    return placed.groupBy("image_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("x", "y", "code"))).alias("patches")
    )


def code_map(patches="patches"):
    """Column: the list form as ``MAP<STRUCT<x,y>,code>``."""
    return F.map_from_entries(
        F.transform(patches, lambda e: F.struct(F.struct(e["x"].alias("x"), e["y"].alias("y")), e["code"]))
    )


def explode_codes(maps: DataFrame) -> DataFrame:
    """Code maps (list form) back to one row per patch."""
    return maps.select("image_id", F.explode("patches").alias("e")).select("image_id", "e.x", "e.y", "e.code")


def member_name():
    return patch_name("image_id", "x", "y")
