"""Image rows ``(image_id, width, height, data)`` to features.

One image is one row, so every operator here is a narrow stage: numpy works on one image
at a time inside an Arrow batch and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.functions.kernels import blur, filter_lines, gaussian_1d, gaussian_offset, gradients, mirror
from topiclens.operators.labels import colorize, map_colors
from topiclens.sources.files import full_path
from topiclens.spread import lookup_join

SIGMA = 1.6  # fixed value: blur of the first level of an octave
STEPS = 3  # fixed value: levels per octave
ASSUMED_BLUR = 0.5  # fixed value: blur an input image is taken to have
MAX_SIDE = 1024  # fixed value: larger images are shrunk
MIN_SIDE = 64  # fixed value: an octave needs more than this less one
MIN_CONTRAST = 0.025  # fixed value
MAX_CURVATURE_RATIO = 12.1  # fixed value: (10 + 1)^2 / 10
ORIENTATION_BINS = 36  # fixed value
PEAK_RATIO = 0.8  # fixed value: further orientations must exceed this part of the highest

FEATURES = "image_id {id}, scale DOUBLE, orientation DOUBLE, x DOUBLE, y DOUBLE, desc ARRAY<DOUBLE>"


OUTPUT_BYTES = 32 << 20  # rows of features that a task holds, beyond those of one image
FAILURES = (ValueError, TypeError, IndexError, ArithmeticError)


def _one_image(fn: Callable[[np.ndarray], Iterator[tuple]], w, h, data) -> tuple[list[tuple], str | None]:
    """All rows of an image, or none and the reason."""
    if data is None or w is None or h is None:
        return [], "no pixels"
    if len(data) != w * h:
        return [], f"{len(data)} pixels for {w} x {h}"
    try:
        return list(fn(np.asarray(data, dtype=np.float64).reshape(int(h), int(w)))), None
    except FAILURES as e:
        return [], f"{type(e).__name__}: {e}"


def extract_features(images: DataFrame, fn: Callable[[np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``fn(image) -> rows`` to every image; rows get the image id in front.

    An image gives all its rows or, if ``fn`` fails or its pixels do not fit its size, none;
    ``failed_images`` with the same ``fn`` lists those and why.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames):
        for pdf in frames:
            rows, held = [], 0
            for image_id, w, h, data in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["data"]):
                for row in _one_image(fn, w, h, data)[0]:
                    rows.append((image_id, *row))
                    held += sum(v.nbytes for v in row if isinstance(v, np.ndarray)) + 8 * len(columns)
                if held > OUTPUT_BYTES:  # images with much output leave the task before the next ones are read
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return images.select("image_id", "width", "height", "data").mapInPandas(run, schema)


def failed_images(images: DataFrame, fn: Callable[[np.ndarray], Iterator[tuple]] = lambda image: ()) -> DataFrame:
    """``image_id, reason`` of the images that ``extract_features`` leaves out for ``fn``."""

    def run(frames):
        for pdf in frames:
            reasons = [_one_image(fn, *image)[1] for image in zip(pdf["width"], pdf["height"], pdf["data"])]
            out = pd.DataFrame({"image_id": pdf["image_id"], "reason": reasons})
            yield out[out["reason"].notna()]

    return images.select("image_id", "width", "height", "data").mapInPandas(run, f"image_id {_id_type(images)}, reason STRING")


NOT_AN_IMAGE = "not an image"


def account_files(decoded: DataFrame, fn: Callable[[np.ndarray], Iterator[tuple]]) -> DataFrame:
    """``path, reason`` of every file in one pass: null for an image that ``fn`` takes, else why not.

    ``decoded`` is ``sources.files.decode_images`` with the files the decoder rejects kept; ``fn`` gets
    the brightness. Pixels stay where they are read: only paths and reasons leave the task.
    """

    def run(frames):
        for pdf in frames:
            reasons = []
            for w, h, channels, data in zip(pdf["width"], pdf["height"], pdf["channels"], pdf["data"]):
                if w <= 0 or h <= 0 or not data:
                    reasons.append(NOT_AN_IMAGE)
                    continue
                bgr = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(np.float64)
                grey = bgr[:, 0] if channels < 3 else bgr[:, 2] * 0.3 + bgr[:, 1] * 0.6 + bgr[:, 0] * 0.1
                reasons.append(_one_image(fn, w, h, grey)[1])
            yield pd.DataFrame({"path": pdf["path"], "reason": pd.Series(reasons, dtype=object)})

    return decoded.select("path", "width", "height", "channels", "data").mapInPandas(run, "path STRING, reason STRING")


def _id_type(images: DataFrame) -> str:
    return images.schema["image_id"].dataType.simpleString()


def normalise_image(image: np.ndarray) -> np.ndarray:
    lo, hi = image.min(), image.max()
    return (image - lo) / (hi - lo) if hi > lo else np.zeros(image.shape)


def resize(image: np.ndarray, scale: float) -> np.ndarray:
    """Shrink by blur and nearest sample, enlarge bilinearly."""
    h, w = image.shape
    if scale == 1.0:
        return image.copy()
    nw, nh = int(np.floor(w * scale + 0.5)), int(np.floor(h * scale + 0.5))
    if scale < 1.0:
        spread = (ASSUMED_BLUR / scale) ** 2 - ASSUMED_BLUR**2
        smooth = blur(image, np.sqrt(spread)) if spread > 0 else image
        pick = lambda n, old: np.clip(np.floor(np.arange(n) / scale + 0.5).astype(int), 0, old - 1)
        return smooth[np.ix_(pick(nh, h), pick(nw, w))]
    fx, fy = np.minimum(np.arange(nw) / scale, w - 1), np.minimum(np.arange(nh) / scale, h - 1)
    x0, y0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    ax, ay = fx - x0, (fy - y0)[:, None]
    top = image[np.ix_(y0, x0)] * (1 - ax) + image[np.ix_(y0, x1)] * ax
    low = image[np.ix_(y1, x0)] * (1 - ax) + image[np.ix_(y1, x1)] * ax
    return top * (1 - ay) + low * ay


def double(image: np.ndarray) -> np.ndarray:
    """Linear interpolation to (2w-1) x (2h-1)."""
    h, w = image.shape
    out = np.empty((2 * h - 1, 2 * w - 1))
    out[::2, ::2] = image
    out[::2, 1::2] = (image[:, 1:] + image[:, :-1]) / 2
    out[1::2, ::2] = (image[1:, :] + image[:-1, :]) / 2
    out[1::2, 1::2] = (image[1:, 1:] + image[:-1, :-1]) / 2
    return out


def prepare(image: np.ndarray, sigma: float = SIGMA, max_side: int = MAX_SIDE) -> tuple[np.ndarray, float, float]:
    """Normalised and pre-blurred image, the factor to its coordinates, and its sigma."""
    h, w = image.shape
    scale = 1.0
    if max(h, w) > max_side - 1:
        scale = min((max_side - 1) / w, (max_side - 1) / h)
        image = resize(image, scale)
    image = normalise_image(image)
    held = ASSUMED_BLUR
    if sigma < 1.0:
        image, scale, sigma, held = double(image), scale * 2.0, sigma * 2.0, 2 * ASSUMED_BLUR
    return blur(image, np.sqrt(sigma * sigma - held * held)), scale, sigma


def octaves(image: np.ndarray, steps: int = STEPS, sigma: float = SIGMA, min_side: int = MIN_SIDE):
    """Blurred levels of every octave: ``(octave, [levels])``; each octave halves the last."""
    spread = [np.sqrt(max((sigma * 2 ** (i / steps)) ** 2 - sigma**2, 0.0)) for i in range(steps + 3)]
    limit = max(len(gaussian_1d(spread[-1])), min_side - 1)
    h, w = (float(s) for s in image.shape)
    octave = 0
    while w > limit and h > limit:
        levels = [image] + [blur(image, s) for s in spread[1:]]
        yield octave, levels
        image = levels[steps][::2, ::2]
        octave, w, h = octave + 1, w / 2, h / 2


def differences(levels: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    k = 2 ** (1.0 / steps) - 1.0
    return np.stack([(b - a) / k for a, b in zip(levels, levels[1:])])


def scale_space(images: DataFrame, steps: int = STEPS, sigma: float = SIGMA, min_side: int = MIN_SIDE) -> DataFrame:
    """Rows ``(image_id, octave, level, kind, width, height, data)``: blurred levels and differences."""

    def levels(image):
        prepared, _, s = prepare(image, sigma)
        for octave, blurred in octaves(prepared, steps, s, min_side):
            for kind, stack in (("blur", blurred), ("difference", differences(blurred, steps))):
                for i, level in enumerate(stack):
                    yield octave, i, kind, level.shape[1], level.shape[0], level.ravel()

    return extract_features(
        images, levels,
        f"image_id {_id_type(images)}, octave INT, level INT, kind STRING, width INT, height INT, data ARRAY<DOUBLE>",
    )


def prepare_images(images: DataFrame, max_side: int = MAX_SIDE, sigma: float = SIGMA) -> DataFrame:
    """Normalised, size-limited, pre-blurred images and their coordinate factor."""

    def one(image):
        out, scale, _ = prepare(image, sigma, max_side)
        yield out.shape[1], out.shape[0], scale, out.ravel()

    return extract_features(
        images, one, f"image_id {_id_type(images)}, width INT, height INT, scale DOUBLE, data ARRAY<DOUBLE>"
    )


def resize_images(images: DataFrame, scale: float) -> DataFrame:
    def one(image):
        out = resize(image, scale)
        yield out.shape[1], out.shape[0], out.ravel()

    return extract_features(images, one, f"image_id {_id_type(images)}, width INT, height INT, data ARRAY<DOUBLE>")


def normalise_descriptors(d: np.ndarray, norm: str) -> np.ndarray:
    if norm == "max":
        top = d.max(1, keepdims=True) / 0.2
        return np.where(top > 0, np.minimum(1.0, d / np.where(top > 0, top, 1.0)), d)
    total = (d * d).sum(1, keepdims=True)
    flat = np.full_like(d, 1.0 / np.sqrt(d.shape[1]))
    return np.where(total >= 1e-9, np.minimum(1.0, d / np.sqrt(np.maximum(total, 1e-300))), flat)


def descriptors(
    magnitude: np.ndarray, direction: np.ndarray, xs, ys, sigma: float, orientation=0.0, fd_size: int = 4, bins: int = 8, norm: str = "l2"
) -> np.ndarray:
    """Descriptors at many points of one level, all at once.

    A square of (4 n)^2 gradient samples spaced ``sigma``, turned by the orientation and
    weighted by a Gaussian, fills n x n cells of ``bins`` directions; each sample is
    shared by the two nearest directions.
    """
    xs, ys = np.atleast_1d(np.asarray(xs, float)), np.atleast_1d(np.asarray(ys, float))
    theta = np.broadcast_to(np.asarray(orientation, float), xs.shape)
    side = 4 * fd_size
    at = np.arange(side) - 2 * fd_size + 0.5
    gy, gx = (a.ravel() for a in np.meshgrid(at, at, indexing="ij"))
    mask = np.exp(-(gx * gx + gy * gy) / (8.0 * fd_size * fd_size))
    cell = (np.arange(side)[:, None] // 4 * fd_size + np.arange(side)[None, :] // 4).ravel()
    cos, sin = np.cos(theta)[:, None], np.sin(theta)[:, None]
    h, w = magnitude.shape
    col = mirror(np.floor(cos * gx * sigma - sin * gy * sigma + xs[:, None] + 0.5).astype(int), w)
    row = mirror(np.floor(cos * gy * sigma + sin * gx * sigma + ys[:, None] + 0.5).astype(int), h)
    weight = magnitude[row, col] * mask
    place = (direction[row, col] - theta[:, None] + np.pi) / (2 * np.pi / bins)
    low = np.trunc(place).astype(int)
    part = place - low
    point = np.arange(len(xs))[:, None]
    slots = (point * fd_size * fd_size + cell) * bins
    size = len(xs) * fd_size * fd_size * bins
    hist = np.bincount((slots + low % bins).ravel(), (weight * (1 - part)).ravel(), size)
    hist += np.bincount((slots + (low + 1) % bins).ravel(), (weight * part).ravel(), size)
    # cells and directions are listed from the last to the first
    return normalise_descriptors(hist.reshape(len(xs), -1)[:, ::-1], norm)


def grid_axis(n: int, step: int, policy: str, fd_size: int) -> np.ndarray:
    start = step // 2 if policy == "half_step" else 2 * fd_size
    return np.arange(start, n - (start if policy == "inside" else 0), step)


POINTS_AT_ONCE = 2048


def dense_features(
    images: DataFrame, step: int = 8, fd_size: int = 4, bins: int = 8, policy: str = "half_step", norm: str = "l2",
    sigma: float = SIGMA, max_side: int = MAX_SIDE,
) -> DataFrame:
    """Descriptors on a regular grid of the prepared image, orientation 0.

    Coordinates are those of the original image.
    """

    def grid(image):
        level, scale, s = prepare(image, sigma, max_side)
        magnitude, direction = gradients(level)
        h, w = level.shape
        gx, gy = np.meshgrid(grid_axis(w, step, policy, fd_size), grid_axis(h, step, policy, fd_size), indexing="ij")
        xs, ys = gx.ravel(), gy.ravel()
        for lo in range(0, len(xs), POINTS_AT_ONCE):
            cut = slice(lo, lo + POINTS_AT_ONCE)
            found = descriptors(magnitude, direction, xs[cut], ys[cut], s, 0.0, fd_size, bins, norm)
            for x, y, d in zip(xs[cut], ys[cut], found):
                yield s / scale, 0.0, x / scale, y / scale, d

    return extract_features(images, grid, FEATURES.format(id=_id_type(images)))


def extrema(d: np.ndarray) -> np.ndarray:
    """(level, y, x) of strict extrema among the 26 neighbours."""
    core = d[1:-1, 1:-1, 1:-1]
    high, low = np.ones(core.shape, bool), np.ones(core.shape, bool)
    n, h, w = d.shape
    for i in range(3):
        for y in range(3):
            for x in range(3):
                if (i, y, x) == (1, 1, 1):
                    continue
                other = d[i : n - 2 + i, y : h - 2 + y, x : w - 2 + x]
                high &= other < core
                low &= other > core
    return np.argwhere(high | low) + 1


def locate(d: np.ndarray, i: int, y: int, x: int, tries: int = 6):
    """Sub-pixel position of an extremum, or None when it is unstable, weak or an edge."""
    n, h, w = d.shape
    shortest = np.inf
    for _ in range(tries):
        c = d[i - 1 : i + 2, y - 1 : y + 2, x - 1 : x + 2]
        g = np.array([c[1, 1, 2] - c[1, 1, 0], c[1, 2, 1] - c[1, 0, 1], c[2, 1, 1] - c[0, 1, 1]]) / 2
        mid = 2 * c[1, 1, 1]
        xx, yy, ii = c[1, 1, 0] + c[1, 1, 2] - mid, c[1, 0, 1] + c[1, 2, 1] - mid, c[0, 1, 1] + c[2, 1, 1] - mid
        xy = (c[1, 2, 2] - c[1, 2, 0] - c[1, 0, 2] + c[1, 0, 0]) / 4
        xi = (c[2, 1, 2] - c[2, 1, 0] - c[0, 1, 2] + c[0, 1, 0]) / 4
        yi = (c[2, 2, 1] - c[2, 0, 1] - c[0, 2, 1] + c[0, 0, 1]) / 4
        hessian = np.array([[xx, xy, xi], [xy, yy, yi], [xi, yi, ii]])
        try:
            offset = -np.linalg.solve(hessian, g)
        except np.linalg.LinAlgError:
            return None
        length = offset @ offset
        if not length < 2.0:
            return None
        if (np.abs(offset) > 0.5).any() and length < shortest:
            shortest = length
            x, y, i = (int(np.floor(v + o + 0.5)) for v, o in zip((x, y, i), offset))
            if x < 1 or y < 1 or i < 1 or x > w - 2 or y > h - 2 or i > n - 2:
                return None
            continue
        fx, fy, fi = x + offset[0], y + offset[1], i + offset[2]
        if min(fx, fy, fi) < 0 or fx > w - 1 or fy > h - 1 or fi > n - 1:
            return None
        if abs(c[1, 1, 1] + 0.5 * (g @ offset)) < MIN_CONTRAST:
            return None
        det, trace = xx * yy - xy * xy, xx + yy
        if det == 0 or trace * trace / det > MAX_CURVATURE_RATIO:
            return None
        return fx, fy, fi
    return None


def _candidates(image, sigma, min_side):
    prepared, scale, s = prepare(image, sigma)
    for octave, levels in octaves(prepared, STEPS, s, min_side):
        d = differences(levels)
        for i, y, x in extrema(d)[::-1]:
            found = locate(d, i, y, x)
            if found is not None:
                yield octave, levels, found, scale, s


def keypoints(images: DataFrame, sigma: float = SIGMA, min_side: int = MIN_SIDE) -> DataFrame:
    """Stable extrema ``(image_id, octave, x, y, level)`` in octave coordinates."""

    def one(image):
        for octave, _, (x, y, i), _, _ in _candidates(image, sigma, min_side):
            yield octave, x, y, i

    return extract_features(
        images, one, f"image_id {_id_type(images)}, octave INT, x DOUBLE, y DOUBLE, level DOUBLE"
    )


def orientations(magnitude, direction, x: float, y: float, sigma: float) -> list[float]:
    """Dominant gradient direction around a point and every other strong local peak."""
    window = gaussian_offset(sigma * 1.5, x - np.floor(x), y - np.floor(y))
    half = window.shape[0] // 2
    h, w = magnitude.shape
    around = np.arange(-half, half + 1)
    rows = np.clip(int(y) + around, 0, h - 1)
    cols = np.clip(min(int(x), w - 1) + around, 0, max(w - 2, 0))
    width = 2 * np.pi / ORIENTATION_BINS
    at = np.ix_(rows, cols)
    bins = np.clip(((direction[at] + np.pi) / width).astype(int), 0, ORIENTATION_BINS - 1)
    hist = np.bincount(bins.ravel(), (magnitude[at] * window).ravel(), ORIENTATION_BINS)
    before, after = np.roll(hist, 1), np.roll(hist, -1)
    curve = before - 2 * hist + after
    offset = np.divide((before - after) / 2, curve, out=np.zeros_like(curve), where=curve != 0)
    top = int(hist.argmax())
    found = [(top + offset[top]) * width - np.pi]
    apart = (np.arange(ORIENTATION_BINS) - top) % ORIENTATION_BINS
    peaks = (apart > 1) & (apart < ORIENTATION_BINS - 1) & (hist > PEAK_RATIO * hist[top])
    peaks &= (before < hist) & (after < hist)
    return found + [(i + 0.5 + offset[i]) * width - np.pi for i in np.flatnonzero(peaks)]


def keypoint_features(
    images: DataFrame, fd_size: int = 4, bins: int = 8, norm: str = "l2", sigma: float = SIGMA, min_side: int = MIN_SIDE
) -> DataFrame:
    """Descriptors at the stable extrema, one per orientation, in image coordinates."""

    def one(image):
        level_gradients = {}
        for octave, levels, (x, y, i), scale, s in _candidates(image, sigma, min_side):
            level = int(np.floor(i + 0.5))
            if (octave, level) not in level_gradients:
                level_gradients[octave, level] = gradients(levels[level])
            magnitude, direction = level_gradients[octave, level]
            size = s * 2 ** (i / STEPS)
            zoom = 2**octave / scale
            for theta in orientations(magnitude, direction, x, y, size):
                d = descriptors(magnitude, direction, x, y, size, theta, fd_size, bins, norm)[0]
                yield size * zoom, theta, x * zoom, y * zoom, d

    return extract_features(images, one, FEATURES.format(id=_id_type(images)))


def sort_features(features: DataFrame) -> DataFrame:
    """Largest scale first."""
    return features.orderBy(F.desc("scale"), "image_id", "x", "y", "orientation")


def image_pixels(images: DataFrame, name: str = "v") -> DataFrame:
    """One row per pixel of image rows."""
    cells = images.select("image_id", "width", F.posexplode("data").alias("pos", name))
    return cells.select(
        "image_id", (F.col("pos") % F.col("width")).alias("x"), F.expr("cast(pos div width as int)").alias("y"), name
    )


def decoded_rgb(decoded: DataFrame, manifest: DataFrame, name=full_path) -> DataFrame:
    """Decoded files as rows ``(image_id, width, height, data ARRAY<INT>)`` of packed colours.

    Grey, colour and colour-with-alpha layouts are told apart by the channel count.
    """
    keyed = lookup_join(
        decoded.withColumn("file", name(F.col("path"))).drop("path"),
        manifest.select("image_id", name(F.col("path")).alias("file")),
        ["file"],
        salt_by=["file"],
    ).select("image_id", "width", "height", "channels", "data")

    def run(frames):
        for pdf in frames:
            rows = []
            for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"]):
                px = np.frombuffer(data, np.uint8).reshape(h * w, c).astype(np.int32)
                b, g, r = (px[:, 0], px[:, 0], px[:, 0]) if c == 1 else (px[:, 0], px[:, 1], px[:, 2])
                rows.append((r << 16) | (g << 8) | b)
            yield pd.DataFrame({"image_id": pdf["image_id"], "width": pdf["width"], "height": pdf["height"], "data": rows})

    return keyed.mapInPandas(run, f"image_id {_id_type(keyed)}, width INT, height INT, data ARRAY<INT>")


def grey_images(rgb: DataFrame) -> DataFrame:
    """Packed colours to grey values."""
    grey = F.transform(
        "data",
        lambda c: F.shiftright(c, 16).bitwiseAND(255) * 0.3 + F.shiftright(c, 8).bitwiseAND(255) * 0.6 + c.bitwiseAND(255) * 0.1,
    )
    return rgb.select("image_id", "width", "height", grey.alias("data"))


def images_to_pixels(rgb: DataFrame, color_map: DataFrame, grouped: bool = False) -> DataFrame:
    """``(image_id, x, y, label)`` of packed-colour images, optionally sorted by label."""
    labelled = map_colors(image_pixels(rgb, "rgb"), color_map).select("image_id", "x", "y", "label")
    return labelled.orderBy("label", "image_id", "y", "x") if grouped else labelled


def assemble_images(pixels: DataFrame, sizes: DataFrame, value: str, empty) -> DataFrame:
    """Image rows from a pixel table; unset pixels get ``empty``.

    Positions outside the canvas are dropped and repeated ones merged first (largest value
    wins), so a line has at most ``width`` entries and an image at most ``height`` lines.
    """
    inside = lookup_join(pixels.select("image_id", "x", "y", value), sizes, ["image_id"]).filter(
        "x >= 0 and y >= 0 and x < width and y < height"
    )
    unique = inside.groupBy("image_id", "x", "y").agg(
        F.max(value).alias(value), F.first("width").alias("width"), F.first("height").alias("height")
    )
    lines = unique.groupBy("image_id", "y").agg(
        F.map_from_entries(F.collect_list(F.struct("x", value))).alias("cells"),
        F.first("width").alias("width"), F.first("height").alias("height"),
    ).select(
        "image_id", "y", "width", "height",
        F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.col("cells")[i], F.lit(empty))).alias("line"),
    )
    whole = lines.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("lines"),
        F.first("width").alias("width"), F.first("height").alias("height"),
    )
    blank = F.transform(F.sequence(F.lit(1), F.col("width")), lambda _: F.lit(empty))
    data = F.flatten(
        F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: F.coalesce(F.col("lines")[i], blank))
    )
    return whole.select("image_id", "width", "height", data.alias("data"))


def pixels_to_images(pixels: DataFrame, color_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Labelled pixels to packed-colour images, 0 where nothing is set."""
    return assemble_images(colorize(pixels, color_map), sizes, "rgb", 0)
