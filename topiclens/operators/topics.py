"""Topic-model tables in long form: sufficient statistics, normalising, priors, top terms.

Shapes: phi ``(doc_no, term_id, n, log_phi ARRAY<DOUBLE>)``, statistics
``(topic, term_id, log_stat)``, beta ``(topic, term_id, log_beta)``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.functions.draws import start_log_beta
from topiclens.functions.scalars import log_add
from topiclens.functions.special import digamma
from topiclens.spread import lookup_join, top_per_group

LOG_FLOOR = math.log(1e-8)  # fixed value: log weight of an absent term
LOG_SEED = math.log(10.0)  # fixed value: prior weight of a seed word
LOG_OTHER = math.log(0.01)  # fixed value: prior weight of any other word


SPAN = 512.0  # exponents summed together: exp(512) times any number of rows is finite


def log_sum_exp(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """log of the summed exponentials per group, in one pass over the rows.

    Rows are summed by group and by span of the exponent, scaled to it: partial sums that can
    be merged, whatever the values. What is shuffled again is a row for each span of a group.
    Nulls are ignored; a group of nulls gives null, of minus infinity minus infinity, and NaN or
    infinity what they are.
    """
    v = F.col(value).cast("double")
    span = F.when(F.abs(v) < float("inf"), F.floor(v / SPAN))
    parts = df.groupBy(*keys, span.alias("_e")).agg(
        F.sum(F.when(F.abs(v) < float("inf"), F.exp(v - F.floor(v / SPAN) * SPAN))).alias("_s"), F.max(v).alias("_top")
    )
    merged = parts.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_e").isNotNull(), F.struct("_e", "_s"))).alias("_p"),  # one entry for each span
        F.max("_e").alias("_e"), F.max(F.when(F.col("_e").isNull(), F.col("_top"))).alias("_odd"),
    )
    total = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["_s"] * F.exp((p["_e"] - F.col("_e")) * SPAN))
    whole = F.col("_e") * SPAN + F.log(total)
    odd = F.isnan("_odd") | (F.col("_odd") == float("inf")) | F.col("_e").isNull()
    return merged.select(*keys, F.when(odd, F.col("_odd")).otherwise(whole).alias(name))


def beta_statistics(phi: DataFrame) -> DataFrame:
    """``(topic, term_id, log_stat)``: log sums of probability times count over documents."""
    weighted = phi.select(
        "term_id",
        F.posexplode(F.transform("log_phi", lambda p: p + F.log(F.col("n").cast("double")))).alias("k", "v"),
    ).select((F.col("k") + 1).alias("topic"), "term_id", "v")
    return log_sum_exp(weighted, ["topic", "term_id"], "v", "log_stat")


def topic_norms(stats: DataFrame, value: str = "log_stat") -> DataFrame:
    """``(topic, log_norm)``."""
    return log_sum_exp(stats, ["topic"], value, "log_norm")


def with_norms(stats: DataFrame) -> DataFrame:
    """Statistics joined with their topic's normaliser; one row for each topic is sent to all tasks."""
    return stats.join(F.broadcast(topic_norms(stats)), "topic")


def normalize_beta(stats: DataFrame, n_terms: int) -> DataFrame:
    """``(topic, term_id, log_beta)``: smoothed by the floor weight of ``n_terms`` terms."""
    norm = log_add(F.col("log_norm"), F.lit(LOG_FLOOR + math.log(n_terms)))
    value = log_add(F.col("log_stat") - norm, F.lit(LOG_FLOOR))
    return with_norms(stats).select("topic", "term_id", value.alias("log_beta"))


def fill_absent(beta: DataFrame, topics: int) -> DataFrame:
    """One row per term with all topics; a topic without the term gets the floor."""
    cells = [F.max(F.when(F.col("topic") == k, F.col("log_beta"))) for k in range(1, topics + 1)]
    return beta.groupBy("term_id").agg(
        F.array(*(F.coalesce(c, F.lit(LOG_FLOOR)) for c in cells)).alias("log_beta")
    )


def lookup_beta(doc_terms: DataFrame, beta_rows: DataFrame, topics: int, n_terms: int, seed: int = 0, beta_count: int | None = None) -> DataFrame:
    """Attach the row of log beta of each term; unseen terms get the hashed start values."""
    start = start_log_beta(topics, n_terms, seed)("term_id")
    joined = lookup_join(doc_terms, beta_rows, ["term_id"], "left", beta_count)
    return joined.withColumn("log_beta", F.coalesce("log_beta", start))


def alpha_statistics(gammas: DataFrame, gamma: str = "gamma") -> DataFrame:
    """``(topic, stat)``: sum over documents of digamma(gamma_k) - digamma(sum gamma)."""

    def partial(frames):
        for pdf in frames:
            if len(pdf):
                g = np.stack(pdf[gamma])
                s = (digamma(g) - digamma(g.sum(1))[:, None]).sum(0)
                yield pd.DataFrame({"topic": np.arange(1, len(s) + 1), "stat": s})

    parts = gammas.select(gamma).mapInPandas(partial, "topic INT, stat DOUBLE")
    return parts.groupBy("topic").agg(F.sum("stat").alias("stat"))


def corpus_log_likelihood(docs: DataFrame, value: str = "loglik") -> DataFrame:
    return docs.agg(F.sum(value).alias("loglik"), F.count("*").alias("n_docs"))


def informed_prior(stats: DataFrame, seeds: DataFrame) -> DataFrame:
    """Log-add the prior weight to every statistic; ``seeds`` is ``(topic, term_id)``."""
    marked = seeds.select("topic", "term_id").withColumn("seeded", F.lit(True))
    eta = F.when(F.col("seeded"), F.lit(LOG_SEED)).otherwise(F.lit(LOG_OTHER))
    joined = lookup_join(stats, marked.distinct(), ["topic", "term_id"], "left")
    return joined.select("topic", "term_id", log_add(F.col("log_stat"), eta).alias("log_stat"))


def top_terms(beta: DataFrame, terms: DataFrame, n: int = 10, value: str = "log_beta") -> DataFrame:
    """The ``n`` highest terms per topic with their words and ranks."""
    best = top_per_group(beta, ["topic"], [F.desc(value), F.asc("term_id")], n)
    return lookup_join(terms, best, ["term_id"]).select("topic", "rank", "term_id", "term", value)


def truncate_beta(stats: DataFrame, n: int = 10_000, value: str = "log_stat") -> DataFrame:
    """Keep the ``n`` best terms per topic and normalise over the kept ones only."""
    kept = top_per_group(stats, ["topic"], [F.desc(value), F.asc("term_id")], n).drop("rank")
    return lookup_join(kept, topic_norms(kept, value), ["topic"])


def sort_by_topic(beta: DataFrame) -> DataFrame:
    """Topic then term order; a topic may span partitions, so none has to hold it whole."""
    return beta.orderBy("topic", "term_id")
