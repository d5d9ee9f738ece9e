"""Digamma, trigamma and log-gamma on numpy arrays, and as Arrow-batched column functions.

Recurrence up to an argument where the asymptotic series is accurate to double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIFT = 8


def digamma(x):
    x = np.asarray(x, dtype=np.float64)
    low = sum(1.0 / (x + i) for i in range(_SHIFT))
    z = x + _SHIFT
    f = 1.0 / (z * z)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132 - f * 691 / 32760)))))
    return np.log(z) - 0.5 / z - series - low


def trigamma(x):
    x = np.asarray(x, dtype=np.float64)
    low = sum(1.0 / np.square(x + i) for i in range(_SHIFT))
    z = x + _SHIFT
    f = 1.0 / (z * z)
    series = (1 / z) * f * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * (5 / 66 - f * 691 / 2730)))))
    return 1 / z + 0.5 * f + series + low


def lgamma(x):
    x = np.asarray(x, dtype=np.float64)
    low = sum(np.log(x + i) for i in range(_SHIFT))
    z = x + _SHIFT
    f = 1.0 / (z * z)
    series = (1 / z) * (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f * (1 / 1680 - f * (1 / 1188 - f * 691 / 360360)))))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - low


@F.pandas_udf(T.DoubleType())
def digamma_col(x: pd.Series) -> pd.Series:
    return pd.Series(digamma(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def trigamma_col(x: pd.Series) -> pd.Series:
    return pd.Series(trigamma(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def lgamma_col(x: pd.Series) -> pd.Series:
    return pd.Series(lgamma(x.to_numpy()))
