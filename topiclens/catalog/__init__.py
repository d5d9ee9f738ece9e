"""Registered queries and their SQL counterparts."""

from topiclens.catalog import (  # noqa: F401
    codebook_queries,
    corpus_queries,
    geometry_queries,
    image_queries,
    label_queries,
    pixel_queries,
    topic_queries,
)
from topiclens.catalog.registry import ORACLES, QUERIES  # noqa: F401
