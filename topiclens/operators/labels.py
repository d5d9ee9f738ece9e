"""Topic labels on patches and pixels, colours, and scoring against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclens.functions.scalars import color_code, label_from_probability, rgb_channels
from topiclens.session import cut_lineage
from topiclens.spread import lookup_join, number_rows


def label_terms(phi: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """``(doc_no, term_id, label)`` from per-document topic log probabilities."""
    return phi.select("doc_no", "term_id", label_from_probability("log_phi", cutoff).alias("label"))


def cast_labels(labels: DataFrame) -> DataFrame:
    """Text keys to numbers: ``(image_id, code, label)`` from ``(title, term, label)``."""
    return labels.select(
        F.col("title").cast("int").alias("image_id"), F.col("term").cast("int").alias("code"), "label"
    )


def cast_label_maps(df: DataFrame) -> DataFrame:
    """The map form of ``cast_labels``: ``title, labels MAP<STRING,INT>``."""
    return df.select(
        F.col("title").cast("int").alias("image_id"),
        F.transform_keys("labels", lambda k, _: k.cast("int")).alias("labels"),
    )


def join_code_topic(codes: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Replace each patch's code by its topic; patches without a label keep a null topic.
    Columns of ``codes`` named in ``keep`` stay."""
    topics = labels.select("image_id", "code", F.col("label").alias("topic"))
    return lookup_join(codes, topics, ["image_id", "code"], "left").select("image_id", "x", "y", "topic", *keep)


def map_colors(pixels: DataFrame, color_map: DataFrame, n_colors: int | None = None) -> DataFrame:
    """Pixel colour to label id; an unknown colour gives null."""
    return lookup_join(pixels, color_map.select("rgb", "label"), ["rgb"], "left", n_colors)


def colorize(pixels: DataFrame, color_map: DataFrame, n_colors: int | None = None) -> DataFrame:
    """Label to pixel colour, 0 when the label has none."""
    colors = color_map.groupBy("label").agg(F.max("rgb").alias("rgb"))
    joined = lookup_join(pixels, colors, ["label"], "left", n_colors)
    return joined.withColumn("rgb", F.coalesce("rgb", F.lit(0)))


def rekey_by_image(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", F.struct("x", "y", "value").alias("pixel"))


def rekey_by_value(pixels: DataFrame) -> DataFrame:
    return pixels.select("value", F.struct("image_id", "x", "y").alias("position"))


def rekey_by_position(df: DataFrame) -> DataFrame:
    return df.select(
        F.struct("image_id", "pixel.x", "pixel.y").alias("position"), F.col("pixel.value").alias("value")
    )


def build_color_map(pixels: DataFrame) -> DataFrame:
    """Distinct colours with ids from 0 in order of first appearance (image, x, y)."""
    firsts = pixels.groupBy("rgb").agg(F.min(F.struct("image_id", "x", "y")).alias("at"))
    return number_rows(firsts, [F.col("at"), F.col("rgb")], "label", start=0).select(
        "rgb", F.col("label").cast("int").alias("label")
    )


def group_pixels_by_label(pixels: DataFrame) -> DataFrame:
    """Rows sorted by label; a frequent label spreads over several partitions."""
    return pixels.orderBy("label", "image_id", "y", "x")


def nearest_palette(pixels: DataFrame, palette: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Add ``truth``: the 1-based palette entry with the nearest colour code, first on ties."""
    ch = rgb_channels("rgb")
    code = color_code(ch["r"], ch["g"], ch["b"])
    offers = F.array(
        *(
            F.struct(F.abs(code - (129 * 129 * r + 129 * g + b)).alias("off"), F.lit(i + 1).alias("entry"))
            for i, (r, g, b) in enumerate(palette)
        )
    )
    return pixels.withColumn("truth", F.array_min(offers)["entry"])


def paint_patches(patches: DataFrame, sizes: DataFrame, step: int = 8) -> DataFrame:
    """Paint every patch as a square of ``step`` + 1 pixels; later patches win.

    ``patches`` is ``(image_id, x, y, label, ordinal)``; of equal ordinals the larger label wins, a
    patch without label or ordinal paints nothing. Squares are clipped to the image on all
    sides and pixels outside every square are 0.

    A square travels as one span for each of its lines, to the task that paints the line: spans
    are laid in their order into one array, and pixels are only made there. Patches at one place
    are first reduced to the one that wins, so a line's spans are bounded by its width.
    """
    half = step // 2
    winner = F.max(F.struct("ordinal", "label")).alias("_top")
    places = patches.filter("label is not null and ordinal is not null").groupBy("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).agg(winner)
    spans = places.select(
        "image_id", F.explode(F.sequence(F.col("y") - half, F.col("y") + half)).alias("y"), F.lit(None).cast("int").alias("width"),
        F.struct(F.col("_top.ordinal").alias("ordinal"), F.col("_top.label").alias("label"), "x").alias("span"),
    )
    lines = sizes.filter("height > 0").select("image_id", F.explode(F.sequence(F.lit(0), (F.col("height") - 1).cast("int"))).alias("y"), F.col("width").cast("int").alias("width"))
    met = spans.unionByName(lines, allowMissingColumns=True).groupBy("image_id", "y").agg(F.max("width").alias("width"), F.collect_list("span").alias("_s"))
    met = met.filter("width > 0").select("image_id", "y", "width", F.sort_array("_s").alias("_s")).select("image_id", "y", "width", "_s.label", "_s.x")
    kinds = {c: patches.schema[c].dataType.simpleString() for c in ("image_id", "label")}

    def paint(frames):
        for pdf in frames:
            out = []
            for image_id, y, width, labels, places in zip(*(pdf[c] for c in ("image_id", "y", "width", "label", "x"))):
                line = np.zeros(width, np.int64)
                for label, x in zip(labels.tolist(), places.tolist()):
                    line[max(0, x - half) : max(0, x + half + 1)] = label
                out.append(pd.DataFrame({"image_id": image_id, "x": np.arange(width), "y": y, "label": line}))
            if out:
                yield pd.concat(out)

    return met.mapInPandas(paint, f"image_id {kinds['image_id']}, x INT, y INT, label {kinds['label']}")


def _runs(pixels: DataFrame, value: str, side: str) -> DataFrame:
    """Pixels that follow each other in one line of an image, as one row: ``image_id, y`` and a struct
    ``side`` of the lists ``x`` and ``value``. Null keys meet nothing and are left out."""
    rows = pixels.filter("image_id is not null and x is not null and y is not null").select("image_id", "y", "x", F.col(value).alias("value"))

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            image, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("image_id", "y"))
            first = np.concatenate([[0], np.flatnonzero((image[1:] != image[:-1]) | (y[1:] != y[:-1])) + 1])
            ends = pa.array(np.append(first, batch.num_rows).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("x", "value"))
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(first)), batch.column("y").take(pa.array(first)), *lists], ["image_id", "y", "x", "value"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    runs = rows.mapInArrow(pack, f"image_id {kinds['image_id']}, y {kinds['y']}, x array<{kinds['x']}>, value array<{kinds['value']}>")
    return runs.select("image_id", "y", F.struct("x", "value").alias(side))


def join_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Prediction and ground truth per pixel; positions are unique on both sides.

    Lines of pixels are shuffled and sorted, one row for each run of them: both sides come in
    lines from ``paint_patches``. Other orders give shorter runs and the same pixels. A line of an
    image is put together in one task.
    """
    both = _runs(predicted, "label", "_p").unionByName(_runs(truth, "truth", "_t"), allowMissingColumns=True)
    met = both.groupBy("image_id", "y").agg(F.collect_list("_p").alias("_p"), F.collect_list("_t").alias("_t")).filter("size(_p) > 0 and size(_t) > 0")
    kinds = {"image_id": predicted.schema["image_id"], "x": predicted.schema["x"], "y": predicted.schema["y"], "label": predicted.schema["label"], "truth": truth.schema["truth"]}

    def pair(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                left, right = (batch.column(c).slice(i, 1).flatten() for c in ("px", "tx"))
                a, b = left.to_numpy(zero_copy_only=False), right.to_numpy(zero_copy_only=False)
                order = np.argsort(b, kind="stable")
                at, to = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
                mine = np.repeat(np.arange(len(a)), to - at)  # a position that repeats meets each of its like
                other = order[np.repeat(at - np.cumsum(to - at) + (to - at), to - at) + np.arange(len(mine))]
                label, found = (batch.column(c).slice(i, 1).flatten().take(pa.array(k)) for c, k in (("pv", mine), ("tv", other)))
                image, y = (batch.column(c).take(pa.array(np.full(len(mine), i))) for c in ("image_id", "y"))
                out.append(pa.RecordBatch.from_arrays([image, left.take(pa.array(mine)), y, label, found], list(kinds)))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    keys = (F.col(c).cast(kinds[c].dataType).alias(c) for c in ("image_id", "y"))
    lists = (F.flatten(f"{side}.{c}").alias(f"{side[1]}{c[0]}") for side in ("_p", "_t") for c in ("x", "value"))
    flat = met.select(*keys, *lists)
    return flat.mapInArrow(pair, ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in kinds.items()))


def class_to_topic(joined: DataFrame) -> DataFrame:
    """Most frequent predicted label per true class, the smallest on ties."""
    counts = joined.groupBy("truth", "label").agg(F.count("*").alias("n"))
    order = Window.partitionBy("truth").orderBy(F.desc("n"), "label")
    best = counts.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return best.select("truth", "label", "n")


def detection_false_alarm(joined: DataFrame, void: int = 1) -> DataFrame:
    """Detection rate and false-alarm rate of every class but ``void``.

    Works on the (class, label) counts, which are computed once; predictions on void
    pixels do not count.
    """
    counts = cut_lineage(joined.groupBy("truth", "label").agg(F.count("*").alias("n")))
    order = Window.partitionBy("truth").orderBy(F.desc("n"), "label")
    chosen = counts.withColumn("place", F.row_number().over(order)).filter("place = 1")
    chosen = chosen.select("truth", "label")
    in_class = counts.groupBy("truth").agg(F.sum("n").alias("truth_n"))
    predicted = counts.filter(F.col("truth") != void).groupBy("label").agg(F.sum("n").alias("label_n"))
    hits = counts.filter(F.col("truth") != void).select("truth", "label", F.col("n").alias("hit_n"))
    scored = (
        chosen.filter(F.col("truth") != void)
        .join(in_class, "truth")
        .join(predicted, "label", "left")
        .join(hits, ["truth", "label"], "left")
        .na.fill(0, ["hit_n", "label_n"])
    )
    false_alarm = F.when(F.col("label_n") > 0, (F.col("label_n") - F.col("hit_n")) / F.col("label_n"))
    return scored.select(
        "truth",
        "label",
        (F.col("hit_n") / F.col("truth_n")).alias("detection"),
        false_alarm.alias("false_alarm"),
    )
