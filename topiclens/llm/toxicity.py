"""Toxicity: logistic regression on character n-grams scaled by naive Bayes log-count ratios.

Grams of 3 to 5 characters (lower case, blanks at both ends) are hashed to buckets. A bucket's
feature is its log-count ratio (how much more of the toxic than of the other documents hold it)
if the document holds it, else zero; rare and undecided buckets are left out. Fitting takes a
bounded sample of labelled documents; scoring takes every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclens.llm.common import whole
from topiclens.session import cut_lineage

ORDERS = (3, 4, 5)
BUCKET_BITS = 18
BLOCK_CHARS = 1 << 18
SLICE_ROWS = 128
#: Labelled documents used for fitting, chosen by a hash of their id.
SAMPLE_ROWS = 12_000
LEAST_DOCS, LEAST_RATIO, SMOOTHING = 3, 0.7, 1.0
SCALE, PENALTY, STEPS, RATE = 0.2, 1e-5, 80, 0.5


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Characters of some texts, the end of the own text for each, and whose they are; long
    texts come in overlapping blocks."""
    waiting: list[tuple[int, np.ndarray]] = []
    held, reach = 0, max(ORDERS) - 1

    def together():
        sizes = np.array([len(c) for _, c in waiting])
        return np.concatenate([c for _, c in waiting]), np.repeat(np.cumsum(sizes), sizes), np.repeat(np.array([n for n, _ in waiting]), sizes)

    for number, text in enumerate(texts):
        codes = _codes(text)
        for at in range(0, len(codes), BLOCK_CHARS):
            part = codes[at : at + BLOCK_CHARS + reach]
            if held and held + len(part) > BLOCK_CHARS:
                yield together()
                waiting, held = [], 0
            waiting.append((number, part))
            held += len(part)
    if waiting:
        yield together()


def present(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct buckets, as (text number, bucket); only ``wanted`` ones if given."""
    pairs = [np.zeros(0, np.int64)]
    for codes, ends, owner in _blocks(texts):
        hashed = np.zeros(len(codes), np.uint64)
        wide, places = codes.astype(np.uint64), np.arange(len(codes))
        for order in range(1, max(ORDERS) + 1):
            hashed = hashed[: len(codes) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[order - 1 :]
            if order in ORDERS:
                mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                inside = places[: len(bucket)] + order <= ends[: len(bucket)]
                if wanted is not None:
                    inside &= wanted[bucket]
                pairs.append(np.unique(owner[: len(bucket)][inside].astype(np.int64) << BUCKET_BITS | bucket[inside]))
    found = np.unique(np.concatenate(pairs))
    return found >> BUCKET_BITS, found & ((1 << BUCKET_BITS) - 1)


def _totals(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The summed weights of each text; a few texts are opened at a time."""
    wanted, found = weights != 0, [np.zeros(0)]
    for at in range(0, len(texts), SLICE_ROWS):
        some = texts[at : at + SLICE_ROWS].to_pylist()
        owner, bucket = present(some, wanted)
        found.append(bias + np.bincount(owner, weights[bucket], len(some)))
    return np.concatenate(found)


def _chance(total: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # e to a large number is infinite, and the chance zero
        return 1 / (1 + np.exp(-total))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``label, text`` of the labelled rows to learn from."""
    chosen = labels.filter(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = cut_lineage(chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows))  # ids and labels only
    return cut_lineage(docs.join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_label").cast("int").alias("label"), "text"))


def log_count_ratios(sample: DataFrame) -> tuple[np.ndarray, float]:
    """The ratio of every bucket (zero for those left out), and the log odds of a label."""

    def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for part in parts:
            label = part.column(0).to_numpy()
            for at in range(0, len(label), SLICE_ROWS):
                owner, bucket = present(part.column(1)[at : at + SLICE_ROWS].to_pylist())
                for kind in (0, 1):
                    sums[kind] += np.bincount(bucket[label[at + owner] == kind], minlength=1 << BUCKET_BITS)
            rows += np.bincount(label, minlength=2)[:2]
        seen = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(sums[0, seen], rows[0])), pa.array(np.append(sums[1, seen], rows[1]))], ["bucket", "clean", "toxic"]
        )

    summed = sample.select("label", "text").mapInArrow(counts, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean"), F.sum("toxic"))
    table = np.zeros((2, (1 << BUCKET_BITS) + 1))
    for bucket, clean, toxic in summed.collect():  # at most one row for each bucket
        table[:, bucket] = clean, toxic
    per_bucket, rows = table[:, :-1], table[:, -1]
    shares = (per_bucket + SMOOTHING) / (rows[:, None] + 2 * SMOOTHING)
    ratio = np.log(shares[1]) - np.log(shares[0])
    ratio[(per_bucket.sum(axis=0) < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    if not rows.all():
        return np.zeros(1 << BUCKET_BITS), -np.inf if not rows[1] else np.inf
    return ratio, float(np.log(rows[1] / rows[0]))


def fit(sample: DataFrame, ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weight of every bucket and the intercept, by AdaGrad over the whole sample."""
    wanted = ratio != 0

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, SLICE_ROWS):
                some = part.slice(at, SLICE_ROWS)
                owner, bucket = present(some.column(2).to_pylist(), wanted)
                ends = np.searchsorted(owner, np.arange(some.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists], ["doc_id", "label", "buckets"])

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        if not rows.num_rows:
            return
        rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
        lists = rows["buckets"].combine_chunks()
        label = rows["label"].to_numpy().astype(float)
        bucket = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        used = np.flatnonzero(np.bincount(bucket, minlength=1 << BUCKET_BITS))
        place = np.zeros(1 << BUCKET_BITS, np.int32)
        place[used] = np.arange(len(used))
        bucket = place[bucket]
        value = (ratio[used] * SCALE)[bucket]
        weight, bias = np.zeros(len(used)), prior
        slow, slow_bias = np.full(len(used), 1e-6), 1e-6
        for _ in range(STEPS):
            score = bias + np.bincount(owner, value * weight[bucket], len(label))
            off = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label) / len(label)
            slope = np.bincount(bucket, value * off[owner], len(used)) + PENALTY * weight
            slow += slope * slope
            slow_bias += off.sum() ** 2
            weight -= RATE * slope / np.sqrt(slow)
            bias -= RATE * off.sum() / np.sqrt(slow_bias)
        strong = weight * ratio[used] * SCALE
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(strong, bias))], ["bucket", "weight"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(features, f"doc_id {kind}, label int, buckets array<int>").repartition(1).mapInArrow(learn, "bucket bigint, weight double")
    weights, bias = np.zeros(1 << BUCKET_BITS), prior
    for bucket, weight in found.collect():  # at most one row for each bucket
        if bucket < 0:
            bias = weight
        else:
            weights[bucket] = weight
    return weights, bias


def score_texts(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """``doc_id, score`` for every row."""
    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            total = _totals(part.column(1), weights, bias)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_chance(total))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from at most ``sample_rows`` labelled rows, never from held-out ids; null labels and
    ids are left out, repeated rows count again. Null texts count as empty. If no row or only
    one label can be learnt from, every score is that label's (0 without any). Other columns
    are ignored; an empty table gives an empty result.
    """
    weights, bias = train(docs, labels, sample_rows, id_col, text_col, label_id_col, label_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return score_texts(texts, weights, bias).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
) -> tuple[np.ndarray, float]:
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    sample = _sample(texts, labels.select(F.col(label_id_col).alias("_id"), F.col(label_col).alias("_label")), sample_rows)
    ratio, prior = log_count_ratios(sample)
    return fit(sample, ratio, prior) if np.isfinite(prior) else (ratio, prior)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    weights, bias = train(docs, labels, text_col=text_col, **options)
    at = docs.columns.index(text_col)

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.log(threshold / (1 - threshold))
        for part in parts:
            yield part.filter(pa.array(_totals(part.column(at), weights, bias) < edge))

    return docs.mapInArrow(keep, docs.schema)
