"""Reproducible draws inside tasks: a value depends on its keys only, never on the task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def mix(*keys) -> np.ndarray:
    """64-bit mixing of integer arrays (the public splitmix finaliser)."""
    state = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for key in keys:
            z = np.asarray(key).astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + state
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            state = z ^ (z >> np.uint64(31))
    return state


def unit(*keys) -> np.ndarray:
    """Numbers in (0, 1)."""
    return (np.right_shift(mix(*keys), np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def start_rows(terms: np.ndarray, topics: int, n_terms: int, seed: int) -> np.ndarray:
    """Start weights 2 u / V + w of unseen terms, one row per term."""
    t, k = np.asarray(terms)[:, None], np.arange(1, topics + 1)[None, :]
    return 2.0 * unit(seed, 0, k, t) / n_terms + unit(seed, 1, k, t)


def start_log_beta(topics: int, n_terms: int, seed: int):
    """Column function: log start weights of a term id."""

    @F.pandas_udf("array<double>")
    def rows(term: pd.Series) -> pd.Series:
        return pd.Series(list(np.log(start_rows(term.to_numpy(), topics, n_terms, seed))))

    return rows
