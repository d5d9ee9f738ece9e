"""Topics back to the documents and pixels they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.operators.corpus import decode_labels
from topiclens.operators.labels import cast_labels, join_code_topic, label_terms, paint_patches


def annotate(phi: DataFrame, terms: DataFrame, titles: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """``(title, labels MAP<term, label>)``: the most certain topic of every term, 0 for none.

    A document's map has as many entries as it has distinct terms.
    """
    named = decode_labels(label_terms(phi, cutoff), terms, titles)
    return named.groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("term", "label"))).alias("labels"))


def label_pixels(
    phi: DataFrame, terms: DataFrame, titles: DataFrame, codes: DataFrame, sizes: DataFrame, cutoff: float = 0.9, step: int = 8
) -> DataFrame:
    """Topic of every pixel: decode, cast, join to the patches, paint.

    ``codes`` is ``(image_id, x, y, code, ordinal)``; the long form of the labels is joined
    directly, so no per-image map is built on the way.
    """
    labels = cast_labels(decode_labels(label_terms(phi, cutoff), terms, titles)).filter("label > 0")
    topics = join_code_topic(codes, labels, keep=("ordinal",))
    patches = topics.select(
        "image_id", "x", "y", F.coalesce("topic", F.lit(0)).alias("label"), "ordinal"
    )
    return paint_patches(patches, sizes, step)
