"""Corpus indexing: from a bag to vocabulary, titles and indexed documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from topiclens.operators.corpus import (
    filter_document_frequency,
    index_documents,
    index_terms,
    index_titles,
    term_stats,
)
from topiclens.session import cut_lineage


@dataclass
class CorpusIndex:
    """The bag is computed once; each table is made on first use."""

    bag: DataFrame
    n_docs: int
    lo: float
    hi: float | None

    @cached_property
    def terms(self) -> DataFrame:
        """Term ids, cut from their lineage: they are joined and counted several times."""
        kept = filter_document_frequency(term_stats(self.bag), self.n_docs, self.lo, self.hi)
        return cut_lineage(index_terms(kept))

    @cached_property
    def titles(self) -> DataFrame:
        return cut_lineage(index_titles(self.bag))

    @cached_property
    def n_terms(self) -> int:
        return self.terms.count()

    @cached_property
    def documents(self) -> DataFrame:
        return index_documents(self.bag, self.terms, self.titles, n_terms=self.n_terms, n_titles=self.n_docs)


def index_corpus(bag: DataFrame, lo: float = 0.0, hi: float | None = 1.0) -> CorpusIndex:
    """Index ``(title, term, n)`` with a document-frequency band."""
    held = cut_lineage(bag)
    return CorpusIndex(held, held.select("title").distinct().count(), lo, hi)
