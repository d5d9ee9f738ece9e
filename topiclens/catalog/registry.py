"""Registry of named queries; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclens.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its SQL twin if any."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, so all executors can reach it."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rnd(column, places: int = 6) -> Column:
    """Rounded value without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, places) + F.lit(0.0)


def sql_rnd(expression: str, places: int = 6) -> str:
    return f"(round({expression}, {places}) + 0.0)"


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, places) for c in columns})
