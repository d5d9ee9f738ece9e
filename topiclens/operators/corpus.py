"""Corpus indexing: bags, term statistics, vocabulary and indexed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens import spread
from topiclens.functions.scalars import tokens
from topiclens.spread import lookup_join, lookup_join_by_heat, number_rows


def tokenize_ws(df: DataFrame, text: str = "text", name: str = "term") -> DataFrame:
    """One row per whitespace token, other columns kept."""
    return df.withColumn(name, F.explode(tokens(text))).drop(text)


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    words = df.select(F.explode(tokens(text)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def bag_of_words(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, term, n)``: how often each token occurs in each document."""
    return tokenize_ws(docs.select(key, text), text).groupBy(key, "term").agg(F.count("*").alias("n"))


def bag_of_codes(codes: DataFrame, key: str = "image_id") -> DataFrame:
    """``(key, code, n)``: how many patches of an image carry each code."""
    return codes.groupBy(key, "code").agg(F.count("*").alias("n"))


def term_stats(bag: DataFrame, term: str = "term") -> DataFrame:
    """Document frequency and total frequency of every term."""
    return bag.groupBy(term).agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def corpus_totals(bag: DataFrame, key: str, term: str = "term") -> DataFrame:
    """Documents, distinct terms and tokens, each from one partially aggregated pass."""
    docs = bag.groupBy(key).agg(F.sum("n").alias("n_tokens"))
    per_doc = docs.select(F.lit(1).alias("n_docs"), F.lit(0).alias("n_terms"), "n_tokens")
    terms = bag.select(term).distinct()
    per_term = terms.select(
        F.lit(0).alias("n_docs"), F.lit(1).alias("n_terms"), F.lit(0).cast("long").alias("n_tokens")
    )
    both = per_doc.unionByName(per_term)
    return both.agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_terms", "n_tokens")))


def check_band(lo: float, hi: float | None) -> None:
    top = 1.0 if hi is None else hi
    if not (0.0 <= lo <= 1.0 and 0.0 <= top <= 1.0 and lo < top):
        raise ValueError("document-frequency bounds must satisfy 0 <= lo < hi <= 1")


def filter_document_frequency(
    stats: DataFrame, n_docs: int, lo: float = 0.0, hi: float | None = 1.0
) -> DataFrame:
    """Terms with ``lo * n_docs < df < hi * n_docs``; both ends exclusive.

    ``hi=1.0`` therefore drops a term found in every document; ``hi=None`` sets no
    upper bound.
    """
    check_band(lo, hi)
    kept = stats.filter(F.col("df") > lo * n_docs)
    return kept if hi is None else kept.filter(F.col("df") < hi * n_docs)


def index_terms(stats: DataFrame, term: str = "term") -> DataFrame:
    """Ids from 1 by falling document frequency, then total frequency, then term."""
    order = [F.desc("df"), F.desc("tf"), F.asc(term)]
    return number_rows(stats, order, "term_id").select("term_id", term, "df", "tf")


def index_titles(titles: DataFrame, title: str = "title") -> DataFrame:
    """Ids from 1 in title order."""
    return number_rows(titles.select(title).distinct(), [F.col(title)], "doc_no").select("doc_no", title)


def index_documents(
    bag: DataFrame,
    terms: DataFrame,
    titles: DataFrame,
    term: str = "term",
    title: str = "title",
    n_terms: int | None = None,
    n_titles: int | None = None,
) -> DataFrame:
    """``(doc_no, term_id, n)``; terms outside the vocabulary are dropped.

    Of a vocabulary too large to send, with ``df``, the frequent terms are sent all the same.
    """
    if n_terms is not None and n_terms > spread.BROADCAST_ROWS and "df" in terms.columns:
        known = lookup_join_by_heat(bag, terms.select(term, "term_id", "df"), [term], "df")
    else:
        known = lookup_join(bag, terms.select(term, "term_id"), [term], lookup_rows=n_terms)
    named = lookup_join(known, titles.select(title, "doc_no"), [title], lookup_rows=n_titles)
    return named.select("doc_no", "term_id", "n")


def drop_collapsed(bag: DataFrame, terms: DataFrame, key: str, term: str = "term", n_terms: int | None = None) -> DataFrame:
    """One row: documents seen, kept, and collapsed (no surviving term)."""
    marked = lookup_join(
        bag.select(key, term), terms.select(term).withColumn("kept", F.lit(1)), [term], "left", lookup_rows=n_terms
    )
    per_doc = marked.groupBy(key).agg(F.max(F.coalesce("kept", F.lit(0))).alias("kept"))
    return per_doc.agg(
        F.count("*").alias("n_docs"),
        F.sum("kept").alias("n_kept"),
        F.sum(1 - F.col("kept")).alias("n_collapsed"),
    )


def seed_words_to_ids(seeds: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """``(topic, term_id)`` for the seed words found in the vocabulary."""
    found = lookup_join(seeds, terms.select(term, "term_id"), [term])
    return found.select("topic", "term_id").distinct()


def unknown_seed_words(seeds: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    return seeds.join(terms.select(term), [term], "left_anti").select("topic", term).distinct()


def decode_labels(labels: DataFrame, terms: DataFrame, titles: DataFrame) -> DataFrame:
    """``(title, term, label)`` from ``(doc_no, term_id, label)``."""
    worded = lookup_join(labels, terms.select("term_id", "term"), ["term_id"])
    return lookup_join(worded, titles.select("doc_no", "title"), ["doc_no"]).select(
        "title", "term", "label"
    )
