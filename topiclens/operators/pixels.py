"""Operators on pixel tables ``(image_id, x, y, v)``.

Neighbourhoods are computed on strips of image lines with some lines of the strips beside them,
so that neighbours along both axes lie in one task: one exchange, and no task holds more
than a strip. Images are complete from (0, 0) on; per-image statistics are partial aggregates
joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclens.functions.kernels import filter_lines, gaussian_1d
from topiclens.functions.scalars import luma
from topiclens.spread import lookup_join

STRIP_LINES = 64


def on_strips(pixels: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], reach: int, columns: str = "v", lines: int | None = None) -> DataFrame:
    """``kernel`` on every strip of lines: ``image_id, x, y`` and ``columns``.

    A strip has ``lines`` image lines of its own (at least twice ``reach``) and up to ``reach`` more on
    both sides. The kernel gets them as one array and returns arrays of its shape; it may take the
    array's edges for the image's, as results beside a cut are left out.
    """
    names = columns.split()

    def own(block, first, last, top):
        found = kernel(block)
        height, width = block[first:last].shape
        y, x = np.divmod(np.arange(height * width), max(1, width))
        return {"x": x, "y": y + first, **{c: found[c][first:last].ravel() for c in names}}

    return _strips(pixels, own, reach, names, lines)


def _strips(pixels, own, reach, names, lines=None):
    """``own(block, first, last, top)`` gives the cells of lines ``first`` to ``last`` of a block whose
    line 0 is line ``top`` of the image; their y counts from the block's own line 0."""
    lines = max(lines or STRIP_LINES, 2 * reach, 1)
    strip = lambda y: F.floor(y / lines).cast("int")
    meets = F.sequence(F.greatest(strip(F.col("y") - reach), F.lit(0)), strip(F.col("y") + reach))
    copied = pixels.select("image_id", F.explode(meets).alias("strip"), "y", "x", F.col("v").cast("double").alias("v"))
    packed = copied.groupBy("image_id", "strip").agg(F.collect_list(F.struct("y", "x", "v")).alias("c"))  # a strip's pixels
    packed = packed.select("image_id", "strip", "c.y", "c.x", "c.v")
    id_type = pixels.schema["image_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = []
            for image_id, number, y, x, v in zip(*(pdf[c] for c in ("image_id", "strip", "y", "x", "v"))):
                top = int(y.min())
                first, last = number * lines - top, min((number + 1) * lines, int(y.max()) + 1) - top
                if first >= last:  # only lines of its neighbour
                    continue
                block = np.zeros((int(y.max()) - top + 1, int(x.max()) + 1))
                block[y - top, x] = v
                cells = own(block, first, last, top)
                cells["y"] = cells["y"] + top * cells.pop("times", 1)
                out.append(pd.DataFrame({"image_id": image_id, **cells}))
            if out:
                yield pd.concat(out)

    return packed.mapInPandas(run, f"image_id {id_type}, x INT, y INT, " + ", ".join(f"{c} DOUBLE" for c in names))


def _beside(block: np.ndarray, step: int, axis: int, outside: float | None) -> np.ndarray:
    """The values ``step`` places on along an axis; beyond the edge ``outside``, or the nearest value."""
    n = block.shape[axis]
    at = np.arange(n) + step
    found = np.take(block, np.clip(at, 0, n - 1), axis)
    if outside is not None:
        beyond = np.expand_dims((at < 0) | (at >= n), 1 - axis)
        found = np.where(beyond, outside, found)
    return found


def pixel_gradients(pixels: DataFrame, lines: int | None = None) -> DataFrame:
    """Half central differences, clamped at edges; magnitude and direction."""

    def kernel(block):
        dx, dy = ((_beside(block, 1, axis, None) - _beside(block, -1, axis, None)) / 2 for axis in (1, 0))
        return {"dx": dx, "dy": dy, "magnitude": np.sqrt(dx * dx + dy * dy), "direction": np.arctan2(dy, dx)}

    return on_strips(pixels, kernel, 1, "dx dy magnitude direction", lines)


def laplace(pixels: DataFrame, radius: int = 1, lines: int | None = None) -> DataFrame:
    """Length of the second differences at distance ``radius``; 0 on the border."""

    def kernel(block):
        second = [_beside(block, -radius, axis, np.nan) - 2 * block + _beside(block, radius, axis, np.nan) for axis in (1, 0)]
        return {"v": np.nan_to_num(np.sqrt(second[0] * second[0] + second[1] * second[1]), nan=0.0)}

    return on_strips(pixels, kernel, radius, "v", lines)


def pixel_extent(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def with_extent(pixels: DataFrame) -> DataFrame:
    return lookup_join(pixels, pixel_extent(pixels), ["image_id"])


def enhance(pixels: DataFrame, scale: float = 1.0) -> DataFrame:
    """Stretch every image to ``[0, scale]``."""
    s = F.lit(float(scale)) / (F.col("hi") - F.col("lo"))
    return with_extent(pixels).select("image_id", "x", "y", (s * (F.col("v") - F.col("lo"))).alias("v"))


def crop_normalize(pixels: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``(v - lo) / (hi - lo)`` with limits from columns; values outside are not clipped."""
    s = F.lit(1.0) / (F.col(hi) - F.col(lo))
    return pixels.select("image_id", "x", "y", ((F.col("v") - F.col(lo)) * s).alias("v"))


def normalize_to_byte(pixels: DataFrame, cutoff: bool) -> DataFrame:
    """Clamp to 0..255, or rescale an image that leaves this range to whole numbers in it."""
    if cutoff:
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("v")))
        return pixels.select("image_id", "x", "y", clamped.alias("v"))
    factor = (F.col("hi") - F.col("lo")) / 255.0
    scaled = ((F.col("v") - F.col("lo")) / factor).cast("int").cast("double")
    outside = (F.col("hi") > 255) | (F.col("lo") < 0)
    return with_extent(pixels).select(
        "image_id", "x", "y", F.when(outside, scaled).otherwise(F.col("v")).alias("v")
    )


def gaussian_kernel_rows(df: DataFrame, sigma: str, normalize: bool = True) -> DataFrame:
    """1-D kernel weights ``(sigma, dx, w)`` for every distinct sigma of a table."""
    half = F.greatest(F.lit(1), (F.col("sigma") * 3 + 0.5).cast("int"))
    cells = df.select(F.col(sigma).alias("sigma")).distinct().withColumn(
        "dx", F.explode(F.sequence(-half, half))
    )
    raw = F.when(F.col("sigma") > 0, F.exp(-(F.col("dx") * F.col("dx")) / (2 * F.col("sigma") * F.col("sigma"))))
    weighted = cells.withColumn("w", raw.otherwise((F.col("dx") == 0).cast("double")))
    if not normalize:
        return weighted
    total = F.sum("w").over(Window.partitionBy("sigma"))  # as many rows as the kernel is long
    return weighted.select("sigma", "dx", (F.col("w") / total).alias("w"))


def gaussian_kernel_2d_rows(df: DataFrame, sigma: str, ox: str | None = None, oy: str | None = None, normalize: bool = True) -> DataFrame:
    """2-D kernel weights ``(sigma, ox, oy, dx, dy, w)``, optionally moved by sub-pixel offsets."""
    shift = lambda c: F.lit(0.0) if c is None else F.col(c)
    base = df.select(F.col(sigma).alias("sigma"), shift(ox).alias("ox"), shift(oy).alias("oy")).distinct()
    half = F.greatest(F.lit(1), F.floor(F.col("sigma") * 3 + 0.5).cast("int"))
    cells = base.withColumn("dx", F.explode(F.sequence(-half, half)))
    cells = cells.withColumn("dy", F.explode(F.sequence(-half, half)))
    fx, fy = F.col("dx") - F.col("ox"), F.col("dy") - F.col("oy")
    raw = F.when(F.col("sigma") > 0, F.exp(-(fx * fx + fy * fy) / (2 * F.col("sigma") * F.col("sigma"))))
    impulse = ((F.col("dx") == 0) & (F.col("dy") == 0)).cast("double")
    weighted = cells.withColumn("w", raw.otherwise(impulse))
    if normalize:
        total = F.sum("w").over(Window.partitionBy("sigma", "ox", "oy"))
        weighted = weighted.withColumn("w", F.col("w") / total)
    return weighted.select("sigma", "ox", "oy", "dx", "dy", "w")


def convolve_axis(pixels: DataFrame, kernel, axis: str, edge: str = "mirror", lines: int | None = None) -> DataFrame:
    """One 1-D pass along ``axis``."""
    weights = np.asarray(kernel, float)
    if axis == "x":
        return on_strips(pixels, lambda block: {"v": filter_lines(block, weights, edge)}, 0, "v", lines)
    return on_strips(pixels, lambda block: {"v": filter_lines(block.T, weights, edge).T}, len(weights) // 2, "v", lines)


def separable_convolve(pixels: DataFrame, kernel_x, kernel_y=None, edge: str = "mirror", lines: int | None = None) -> DataFrame:
    """Horizontal then vertical pass."""
    across, down = np.asarray(kernel_x, float), np.asarray(kernel_x if kernel_y is None else kernel_y, float)

    def kernel(block):
        return {"v": filter_lines(filter_lines(block, across, edge).T, down, edge).T}

    return on_strips(pixels, kernel, len(down) // 2, "v", lines)


def gaussian_blur(pixels: DataFrame, sigma: float, lines: int | None = None) -> DataFrame:
    """Weights outside the image are dropped and the result divided by the weight used.

    The valid neighbourhood is a rectangle, so both the sum and the weight factor into two
    1-D passes.
    """
    return separable_convolve(pixels, gaussian_1d(sigma), edge="renorm", lines=lines)


def gaussian_blur_mirror(pixels: DataFrame, sigma: float, lines: int | None = None) -> DataFrame:
    """Two passes reflecting about the edge samples."""
    return separable_convolve(pixels, gaussian_1d(sigma), edge="inner", lines=lines)


def gaussian_blur_ramp_x(pixels: DataFrame, start: float, end: float, lines: int | None = None) -> DataFrame:
    """Sigma grows linearly with x; weights outside the image are dropped.

    Both passes use the kernel of the target column; the image width sets the slope. The kernels
    of a width are one band: a row of weights for each offset.
    """
    reach = len(gaussian_1d(max(start, end))) // 2
    bands: dict[int, np.ndarray] = {}

    def band(width):
        if width not in bands:
            weights = np.zeros((2 * reach + 1, width))
            for x in range(width):
                k = gaussian_1d(start + (end - start) / width * x)
                weights[reach - len(k) // 2 : reach + len(k) // 2 + 1, x] = k
            bands[width] = weights
        return bands[width]

    def kernel(block):
        for axis in (1, 0):
            block = sum(w * _beside(block, i - reach, axis, 0.0) for i, w in enumerate(band(block.shape[1])))
        return {"v": block}

    return on_strips(pixels, kernel, reach, "v", lines)


def jitter_resample(pixels: DataFrame, axis: str = "x", seed: int = 0, lines: int | None = None) -> DataFrame:
    """Shift every column (or row) by a random part of a pixel, by 3-tap interpolation.

    The shift in (-1, 1) depends on seed and column only (the draw of ``functions.scalars.draw``);
    samples outside count as 0.
    """
    along = 1 if axis == "x" else 0

    def shift(place):
        return (int(hashlib.md5(f"{seed}:{place}".encode()).hexdigest()[:8], 16) / float(1 << 32) - 0.5) * 2

    def own(block, first, last, top):
        places = np.arange(block.shape[1]) if along else np.arange(top, top + len(block))
        r = np.expand_dims(np.array([shift(i) for i in places.tolist()]), 1 - along)
        back, ahead = _beside(block, -1, along, 0.0), _beside(block, 1, along, 0.0)
        mixed = np.where(r < 0, -r * back + (1 + r) * block, (1 - r) * block + r * ahead)[first:last]
        y, x = np.divmod(np.arange(mixed.size), max(1, mixed.shape[1]))
        return {"x": x, "y": y + first, "v": mixed.ravel()}

    return _strips(pixels, own, 1 - along, ["v"], lines)


def downsample2(pixels: DataFrame) -> DataFrame:
    """Keep even positions, halve the coordinates."""
    even = pixels.filter("x % 2 = 0 and y % 2 = 0")
    return even.select("image_id", F.expr("x div 2").cast("int").alias("x"), F.expr("y div 2").cast("int").alias("y"), "v")


def upsample2(pixels: DataFrame, lines: int | None = None) -> DataFrame:
    """Linear interpolation to (2w-1) x (2h-1).

    A target between two pixels is their mean, one between four the mean of the upper left and
    the lower right.
    """

    def own(block, first, last, top):
        height, width = block.shape
        below = min(last, height - 1)  # lines that have a next one
        fresh = np.empty((2 * (last - first), 2 * width - 1))
        fresh[::2, ::2] = block[first:last]
        fresh[::2, 1::2] = (block[first:last, :-1] + block[first:last, 1:]) / 2
        n = below - first
        fresh[1 : 2 * n : 2, ::2] = (block[first:below] + block[first + 1 : below + 1]) / 2
        fresh[1 : 2 * n : 2, 1::2] = (block[first:below, :-1] + block[first + 1 : below + 1, 1:]) / 2
        fresh = fresh[: (last - first) + n]
        y, x = np.divmod(np.arange(fresh.size), fresh.shape[1])
        return {"x": x, "y": y + 2 * first, "v": fresh.ravel(), "times": 2}

    return _strips(pixels, own, 1, ["v"], lines)


def grid_points(sizes: DataFrame, step: int = 8, policy: str = "half_step", fd_size: int = 4) -> DataFrame:
    """Descriptor grid of every image.

    ``half_step`` starts at half a step and runs to the end, ``half_block`` starts half a
    descriptor in, ``inside`` also stops that far before the end.
    """
    start = step // 2 if policy == "half_step" else 4 * fd_size // 2
    margin = start if policy == "inside" else 0
    points = lambda c: F.explode(
        F.when(F.col(c) - margin > start, F.sequence(F.lit(start), F.col(c) - margin - 1, F.lit(step))).otherwise(
            F.array().cast("array<int>")
        )
    )
    return sizes.withColumn("x", points("width")).withColumn("y", points("height")).select("image_id", "x", "y")


def pixel_luma(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "x", "y", luma("rgb").alias("v"))
