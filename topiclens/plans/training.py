"""Variational topic model: E-step, M-step, alpha update, training loop, held-out inference.

Documents are rows ``(doc_no, terms ARRAY<INT>, counts ARRAY<DOUBLE>, gamma ARRAY<DOUBLE>)``.
One E-step is one pass over the documents: tasks iterate every document to its posterior
and add up topic-term sums before anything is shuffled. The model (terms x topics) is sent
to the tasks while it has at most ``MODEL_CELLS`` numbers. Of a larger model a task reads, for each
batch of its documents, the rows of the batch's distinct terms from files in the shared folder; a
model beyond ``SIDE_MODELS`` times that comes to the batches by an exchange of these rows. Either
way a batch gets its rows once, and all passes run there.
Documents too wide for a task are cut by vocabulary instead: a block holds the model rows of its
terms and what the documents have of them; only posteriors travel (``wide_e_step``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topiclens.functions.special import digamma, lgamma, trigamma
from topiclens.functions.draws import start_log_beta, start_rows, unit
from topiclens.operators.topics import LOG_FLOOR, LOG_OTHER, LOG_SEED
from topiclens.session import cut_lineage, remove_round, write_round
from topiclens.sources.side import read_arrow, write_arrow
from topiclens.spread import lookup_join, top_per_group

INNER_ITER = 99  # fixed value: passes per document
MODEL_CELLS = 32_000_000
SIDE_MODELS = 16  # times MODEL_CELLS up to which tasks read a model for themselves
DENSE_IDS = 1 << 28  # term ids below which a mark for each finds those of a batch
MATRIX_ROWS = 16_384
BLOCK_ROWS = 32_768  # (document, term) rows iterated together, which stay in the cache
WIDE_TERMS = 1_000_000
FLUSH_CELLS = 8_000_000
BLOCK_CELLS = 8_000_000  # model numbers in a vocabulary block
SHARE_PAIRS = 1 << 16  # (document, term) pairs from which a core gets a vocabulary block of its own
LONG_RUN = 64  # terms of a document from which its share of a block is a matrix product
GAMMA_BYTES = 256 << 20  # posteriors of wide documents sent to all tasks; more are joined

RESULT = "kind STRING, id LONG, vec ARRAY<DOUBLE>, loglik DOUBLE, terms ARRAY<INT>, counts ARRAY<DOUBLE>, log_phi ARRAY<ARRAY<DOUBLE>>"
RESULT_ARROW = pa.schema(
    [
        ("kind", pa.string()),
        ("id", pa.int64()),
        ("vec", pa.list_(pa.float64())),
        ("loglik", pa.float64()),
        ("terms", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.float64())),
        ("log_phi", pa.list_(pa.list_(pa.float64()))),
    ]
)


@dataclass
class TopicModel:
    """alpha (K values), beta rows ``(term_id, log_beta ARRAY)``, documents with gamma; of
    documents too wide for a task the terms ``(doc_no, term_id, n)`` and ``(doc_no, gamma)``;
    the tables of its last round of training."""

    alpha: np.ndarray
    beta: DataFrame
    n_terms: int
    docs: DataFrame
    loglik: list[float]
    iteration: int
    wide: DataFrame | None = None
    wide_gamma: DataFrame | None = None
    tables: tuple[str, ...] = ()


def pack_documents(indexed: DataFrame) -> DataFrame:
    """One row per document from ``(doc_no, term_id, n)``.

    A document's list is as long as its distinct terms; see ``split_wide`` for documents
    whose list would not fit a task.
    """
    packed = indexed.groupBy("doc_no").agg(
        F.array_sort(F.collect_list(F.struct("term_id", "n"))).alias("entries")
    )
    return packed.select(
        "doc_no",
        F.col("entries.term_id").cast("array<int>").alias("terms"),
        F.col("entries.n").cast("array<double>").alias("counts"),
        F.lit(None).cast("array<double>").alias("gamma"),
    )


def split_wide(indexed: DataFrame, limit: int = WIDE_TERMS) -> tuple[DataFrame, DataFrame | None]:
    """Documents a task can hold, and the terms of wider ones (None when there are none)."""
    sizes = indexed.groupBy("doc_no").agg(F.count("*").alias("width")).filter(F.col("width") > limit)
    wide = cut_lineage(sizes.select("doc_no"))
    n_wide = wide.count()
    if n_wide == 0:
        return indexed, None
    normal = indexed.join(F.broadcast(wide) if n_wide <= 1_000_000 else wide, "doc_no", "left_anti")
    return normal, lookup_join(indexed, wide, ["doc_no"], lookup_rows=n_wide)


def start_alpha(topics: int, seed: int = 0) -> np.ndarray:
    """Uniform start values that depend on the seed only."""
    return unit(seed, np.arange(1, topics + 1))


def _alike(rows, starts, counts):
    """Documents in groups of like size (half as many terms again at most): their order, and of each
    group beta (topics by terms) and counts side by side, filled up with terms that do not occur."""
    sizes = np.diff(np.append(starts, len(counts)))
    group = np.ceil(np.log(np.maximum(sizes, 1)) / np.log(1.5)).astype(int)
    order = np.argsort(group, kind="stable")
    laid = []
    for docs in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(docs) == 1:  # a long one is not filled up
            own = slice(starts[docs[0]], starts[docs[0]] + sizes[docs[0]])
            laid.append((np.ascontiguousarray(rows[own].T)[None], counts[own][None]))
            continue
        at = np.arange(sizes[docs].max())
        there = at < sizes[docs][:, None]
        r, c = np.ones((*there.shape, rows.shape[1])), np.zeros(there.shape)
        own = (starts[docs][:, None] + at)[there]
        r[there], c[there] = rows[own], counts[own]
        laid.append((np.ascontiguousarray(r.transpose(0, 2, 1)), c))
    return order, laid


def _iterate(rows, doc_of, starts, counts, alpha, gamma, passes, tol):
    """Posterior of a block of documents; ``rows`` is beta (not log) per (document, term).

    A pass is two products of matrices for each group of documents of like size. With ``tol``
    each document stops when none of its values moves by as much, whatever the others in the
    block do; settled documents leave the block in groups.
    """
    last, before = gamma.copy(), gamma.copy()
    open_, laid = _alike(rows, starts, counts)
    gamma, frozen = gamma[open_], np.zeros(len(gamma), bool)
    for _ in range(passes):
        t = digamma(gamma)
        e = np.exp(t - t.max(1, keepdims=True))
        moved, at = np.empty_like(gamma), 0
        for r, c in laid:
            own = slice(at, at + len(c))
            norm = np.matmul(e[own, None, :], r)[:, 0]
            moved[own] = np.matmul(r, np.divide(c, norm, out=norm)[:, :, None])[:, :, 0]
            at += len(c)
        moved = alpha + e * moved
        before[open_[~frozen]], last[open_[~frozen]] = gamma[~frozen], moved[~frozen]
        if tol is not None:
            frozen |= np.abs(moved - gamma).max(1) < tol
            if frozen.all():
                break
            if frozen.mean() > 0.2:
                stay = ~frozen
                mine = np.split(stay, np.cumsum([len(c) for _, c in laid])[:-1])
                laid = [(r[some], c[some]) for (r, c), some in zip(laid, mine) if some.any()]
                open_, moved, frozen = open_[stay], moved[stay], frozen[stay]
        gamma = moved
    t = digamma(before)
    shift = t.max(1, keepdims=True)
    norm = np.einsum("nk,nk->n", rows, np.exp(t - shift)[doc_of])
    return last, t, np.log(norm) + shift[doc_of, 0]


def _blocks(sizes: np.ndarray):
    """Cut consecutive documents into blocks of about BLOCK_ROWS (document, term) rows."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BLOCK_ROWS:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _lists(offsets, values):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _frame(n, **columns):
    arrays = [columns.get(f.name) if columns.get(f.name) is not None else pa.nulls(n, f.type) for f in RESULT_ARROW]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, RESULT_ARROW)], schema=RESULT_ARROW)


class _TermSums:
    """Topic sums per term inside one task, handed on when they grow."""

    def __init__(self, topics):
        self.topics, self.terms, self.sums, self.cells = topics, [], [], 0

    def add(self, terms, weights):
        order = np.argsort(terms, kind="stable")
        found, first = np.unique(terms[order], return_index=True)
        self.terms.append(found)
        self.sums.append(np.add.reduceat(weights[order], first, axis=0))
        self.cells += self.sums[-1].size
        if self.cells > FLUSH_CELLS:
            self._merge()

    def _merge(self):
        terms, sums = np.concatenate(self.terms), np.concatenate(self.sums)
        self.terms, self.sums, self.cells = [], [], 0
        order = np.argsort(terms, kind="stable")
        found, first = np.unique(terms[order], return_index=True)
        self.terms = [found]
        self.sums = [np.add.reduceat(sums[order], first, axis=0)]

    def full(self):
        return bool(self.sums) and self.sums[0].size > FLUSH_CELLS

    def take(self):
        if not self.terms:
            return None
        self._merge()
        found, sums = self.terms[0], self.sums[0]
        self.terms, self.sums, self.cells = [], [], 0
        offsets = np.arange(0, sums.size + 1, self.topics, dtype=np.int32)
        return _frame(
            len(found),
            kind=pa.array(["beta"] * len(found)),
            id=pa.array(found.astype(np.int64)),
            vec=_lists(offsets, sums.ravel()),
        )


def _e_step_task(alpha, rows_of, passes, tol, random_start, want_phi, want_docs, want_sums):
    """Arrow-batch function of the E-step; ``rows_of(batch, terms)`` gives beta per row."""
    topics = len(alpha)
    prior = float(lgamma(alpha.sum()) - lgamma(alpha).sum())

    def run(batches):
        sums = _TermSums(topics)
        stat, loglik, n_docs = np.zeros(topics), 0.0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # documents of like size together: few groups to a block, and matrix products of many documents
            batch = batch.take(pa.array(np.argsort(np.asarray(batch.column("terms").value_lengths()), kind="stable")))
            term_col, count_col, gamma_col = (batch.column(c) for c in ("terms", "counts", "gamma"))
            sizes = np.asarray(term_col.value_lengths())
            terms = term_col.flatten().to_numpy()
            counts = count_col.flatten().to_numpy()
            ids = batch.column("doc_no").to_numpy()
            stored = None if random_start or gamma_col.null_count == len(gamma_col) else gamma_col.to_pylist()
            ends = np.cumsum(sizes)
            beta_rows = rows_of(batch, terms)
            for lo, hi in _blocks(sizes):
                begin, end = ends[lo] - sizes[lo], ends[hi - 1]
                t_blk, c_blk, rows = terms[begin:end], counts[begin:end], beta_rows(begin, end)
                starts = (ends[lo:hi] - sizes[lo:hi] - begin).astype(np.int64)
                doc_of = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                words = np.add.reduceat(c_blk, starts)
                gamma = alpha[None, :] + (words / topics)[:, None]
                if stored is not None:
                    for i in range(lo, hi):
                        if stored[i] is not None and len(stored[i]) == topics:
                            gamma[i - lo] = stored[i]
                gamma, t, log_norm = _iterate(rows, doc_of, starts, c_blk, alpha, gamma, passes, tol)
                phi = rows * np.exp(t[doc_of] - log_norm[:, None])
                if want_sums:
                    sums.add(t_blk, phi * c_blk[:, None])
                    if sums.full():
                        yield sums.take()
                l_phi = np.add.reduceat(c_blk * (log_norm - (phi * t[doc_of]).sum(1)), starts)
                total = gamma.sum(1)
                doc_ll = prior + lgamma(gamma).sum(1) - lgamma(total) + l_phi
                stat += (digamma(gamma) - digamma(total)[:, None]).sum(0)
                loglik += float(doc_ll.sum())
                n_docs += hi - lo
                if want_docs:
                    offs = np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int32)
                    g_offs = np.arange(0, gamma.size + 1, topics, dtype=np.int32)
                    log_phi = None
                    if want_phi:
                        with np.errstate(divide="ignore"):
                            lp = np.log(rows) + t[doc_of] - log_norm[:, None]
                        inner = _lists(np.arange(0, lp.size + 1, topics, dtype=np.int32), lp.ravel())
                        log_phi = pa.ListArray.from_arrays(pa.array(offs), inner)
                    yield _frame(
                        hi - lo,
                        kind=pa.array(["doc"] * (hi - lo)),
                        id=pa.array(ids[lo:hi]),
                        vec=_lists(g_offs, gamma.ravel()),
                        loglik=pa.array(doc_ll),
                        terms=_lists(offs, t_blk),
                        counts=_lists(offs, c_blk),
                        log_phi=log_phi,
                    )
        last = sums.take()
        if last is not None:
            yield last
        if n_docs:
            yield _frame(
                1,
                kind=pa.array(["alpha"]),
                id=pa.array([n_docs]),
                vec=_lists(np.array([0, topics], np.int32), stat),
                loglik=pa.array([loglik]),
            )

    return run


def e_step(
    docs: DataFrame,
    alpha: np.ndarray,
    beta: DataFrame,
    n_terms: int,
    inner_iter: int = INNER_ITER,
    tol: float | None = None,
    random_start: bool = False,
    want_phi: bool = False,
    want_docs: bool = True,
    want_sums: bool = True,
    seed: int = 0,
    model_cells: int = MODEL_CELLS,
) -> DataFrame:
    """One E-step. Rows tagged by ``kind``: ``doc`` (gamma, likelihood, phi on request),
    ``beta`` (per-task topic sums of a term) and ``alpha`` (per-task alpha statistics)."""
    flags = (inner_iter, tol, random_start, want_phi, want_docs, want_sums)
    return _e_step(docs, np.asarray(alpha, float), beta, n_terms, flags, seed, model_cells)[0]


def _e_step(
    docs: DataFrame, alpha: np.ndarray, beta: DataFrame, n_terms: int, flags: tuple, seed: int, model_cells: int = MODEL_CELLS
) -> tuple[DataFrame, str | None]:
    """``e_step``, and the path of the model files its tasks read, if they do."""
    topics = len(alpha)
    sc = docs.sparkSession.sparkContext
    rows = beta.limit(model_cells // topics + 1).count()
    if rows * topics <= model_cells:
        pairs = beta.toArrow()
        ids = pairs.column("term_id").to_numpy()
        order = np.argsort(ids)
        values = pairs.column("log_beta").combine_chunks().flatten().to_numpy().reshape(len(ids), topics)
        shared = sc.broadcast((ids[order], np.exp(values[order])))

        def from_broadcast(batch, terms):
            known, table = shared.value
            at = np.searchsorted(known, terms)
            at = np.minimum(at, max(len(known) - 1, 0))
            hit = known[at] == terms if len(known) else np.zeros(len(terms), bool)

            def rows(lo, hi):
                block = table[at[lo:hi]] if len(known) else np.zeros((hi - lo, topics))
                missing = ~hit[lo:hi]
                if missing.any():
                    block = block.copy()
                    block[missing] = start_rows(terms[lo:hi][missing], topics, n_terms, seed)
                return block

            return rows

        task = _e_step_task(alpha, from_broadcast, *flags)
        return docs.select("doc_no", "terms", "counts", "gamma").mapInArrow(task, RESULT), None

    entries = max(1, model_cells // topics)
    if beta.limit(SIDE_MODELS * entries + 1).count() <= SIDE_MODELS * entries:
        return _side_e_step(docs, alpha, beta, n_terms, flags, seed, entries)
    return _batched_e_step(docs, alpha, beta, n_terms, flags, seed, entries), None


def _runs(batches, entries: int):
    """Documents in batches of about ``entries`` (document, term) pairs."""
    held, pairs = [], 0
    for batch in batches:
        sizes = np.asarray(batch.column("terms").value_lengths())
        while len(sizes):
            n = min(len(sizes), int(np.searchsorted(np.cumsum(sizes), entries - pairs)) + 1)
            held.append(batch.slice(0, n))
            pairs += int(sizes[:n].sum())
            batch, sizes = batch.slice(n), sizes[n:]
            if pairs >= entries:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, pairs = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _model_rows(files: list[str], wanted: np.ndarray, topics: int) -> tuple[np.ndarray, np.ndarray]:
    """In a task: beta (not log) of the ``wanted`` terms (sorted), and which of them the model has."""
    rows, there = np.zeros((len(wanted), topics)), np.zeros(len(wanted), bool)
    top = int(wanted[-1])
    mark = None
    if wanted[0] >= 0 and top < DENSE_IDS:
        mark = np.zeros(top + 1, bool)
        mark[wanted] = True
    for batch in read_arrow(files):
        ids = batch.column("term_id").to_numpy()
        if mark is None:
            own = np.flatnonzero(np.isin(ids, wanted))
        else:
            own = np.flatnonzero((ids >= 0) & (ids <= top))
            own = own[mark[ids[own]]]
        if len(own):
            at = np.searchsorted(wanted, ids[own])
            rows[at] = np.exp(batch.column("log_beta").flatten().to_numpy().reshape(-1, topics)[own])
            there[at] = True
    return rows, there


def _side_e_step(
    docs: DataFrame, alpha: np.ndarray, beta: DataFrame, n_terms: int, flags: tuple, seed: int, entries: int
) -> tuple[DataFrame, str]:
    """The E-step of a model too large to send: its rows are written once, and tasks read them for every
    ``entries`` (document, term) pairs. Neither documents nor model rows are shuffled. Also gives the path of the files."""
    topics = len(alpha)
    path, files = write_arrow(beta.select(F.col("term_id").cast("int").alias("term_id"), "log_beta"))

    def rows_of(batch, terms):
        wanted = np.unique(terms)
        table, there = _model_rows(files, wanted, topics) if len(wanted) else (np.zeros((0, topics)), np.zeros(0, bool))

        def rows(lo, hi):
            at = np.searchsorted(wanted, terms[lo:hi])
            block, missing = table[at], ~there[at]
            if missing.any():
                block[missing] = start_rows(terms[lo:hi][missing], topics, n_terms, seed)
            return block

        return rows

    task = _e_step_task(alpha, rows_of, *flags)
    return docs.select("doc_no", "terms", "counts", "gamma").mapInArrow(lambda batches: task(_runs(batches, entries)), RESULT), path


def _batched_e_step(docs: DataFrame, alpha: np.ndarray, beta: DataFrame, n_terms: int, flags: tuple, seed: int, entries: int) -> DataFrame:
    """The E-step of a model too large to read for each batch: batches of about ``entries`` (document, term) pairs.

    A batch meets the model rows of its distinct terms, shuffled once for the whole E-step and
    not for each document that has the term; its passes need no exchange.
    """
    topics = len(alpha)
    total = docs.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    batches = max(1, math.ceil(total / entries))
    dealt = docs.select(F.pmod(F.xxhash64("doc_no"), F.lit(batches)).alias("batch"), "doc_no", "terms", "counts", "gamma")
    needed = dealt.select("batch", F.explode("terms").alias("term_id")).distinct()
    met = needed.join(beta.select(F.col("term_id").cast("int").alias("term_id"), "log_beta"), "term_id").select(
        *(F.col(c).alias(c) for c in ("batch", "term_id", "log_beta"))  # new column identities: both sides come from ``docs``
    )

    def run(documents: pa.Table, model: pa.Table) -> pa.Table:
        if documents.num_rows == 0:
            return RESULT_ARROW.empty_table()
        known = model.column("term_id").combine_chunks().to_numpy()
        order = np.argsort(known)
        known, values = known[order], model.column("log_beta").combine_chunks().flatten().to_numpy().reshape(-1, topics)[order]

        def rows_of(batch, terms):
            at = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
            hit = known[at] == terms if len(known) else np.zeros(len(terms), bool)

            def rows(lo, hi):
                block = np.empty((hi - lo, topics))
                own = hit[lo:hi]
                block[own] = np.exp(values[at[lo:hi][own]])
                block[~own] = start_rows(terms[lo:hi][~own], topics, n_terms, seed)
                return block

            return rows

        task = _e_step_task(alpha, rows_of, *flags)
        return pa.Table.from_batches(task(documents.select(["doc_no", "terms", "counts", "gamma"]).combine_chunks().to_batches()), RESULT_ARROW)

    return dealt.groupBy("batch").cogroup(met.groupBy("batch")).applyInArrow(run, RESULT)


def _best_in_task(topics: int, n: int):
    """Arrow-batch function: of the terms a task sees, each topic's ``n`` of the largest sums (lower ids on ties) as ``term_id, k, v``."""

    def best(ids, values):
        order = np.lexsort((ids, np.where(np.isnan(values), -np.inf, -values)))[:n]
        return ids[order], values[order]

    def run(batches):
        kept = [(np.zeros(0, np.int32), np.zeros(0))] * topics
        for batch in batches:
            ids, s = batch.column("term_id").to_numpy(), batch.column("s").flatten().to_numpy().reshape(-1, topics)
            for k, (own, values) in enumerate(kept):
                new = slice(None) if len(own) < n else ~(s[:, k] < values[-1])
                kept[k] = best(np.concatenate([own, ids[new]]), np.concatenate([values, s[new, k]]))
        for k, (own, values) in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), k, np.int32)), pa.array(values)], ["term_id", "k", "v"])

    return run


def m_step_beta(
    stepped: DataFrame, topics: int, seeds: DataFrame | None = None, truncate: int | None = None
) -> tuple[DataFrame, int]:
    """New beta rows and the new vocabulary size from the E-step output.

    Task sums are added per term, optionally joined with the seed prior, optionally cut to
    the best terms per topic, then normalised with the floor weight.
    """
    rows, n_terms, _ = _m_step(stepped, topics, seeds, truncate)
    return rows, n_terms


def _m_step(stepped: DataFrame, topics: int, seeds: DataFrame | None, truncate: int | None) -> tuple[DataFrame, int, str]:
    """``m_step_beta``, and the path of the table its rows are read from."""
    parts = stepped.filter("kind = 'beta'")
    if topics <= 128:
        sums = parts.groupBy("id").agg(F.array(*(F.sum(F.col("vec")[k]) for k in range(topics))).alias("s"))
    else:
        cells = parts.select("id", F.posexplode("vec").alias("k", "v")).groupBy("id", "k").agg(F.sum("v").alias("v"))
        sums = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("e"))
        sums = sums.select("id", F.col("e.v").alias("s"))
    sums = sums.select(F.col("id").cast("int").alias("term_id"), "s")
    if seeds is not None:
        marked = seeds.groupBy("term_id").agg(
            F.collect_set("topic").alias("seed_topics")
        )
        weight = lambda v, i: v + F.when(
            F.coalesce(F.array_contains("seed_topics", i + 1), F.lit(False)), math.exp(LOG_SEED)
        ).otherwise(math.exp(LOG_OTHER))
        sums = lookup_join(sums, marked.select(F.col("term_id").cast("int"), "seed_topics"), ["term_id"], "left")
        sums = sums.select("term_id", F.transform("s", weight).alias("s"))
    if truncate is not None:
        cells = sums.mapInArrow(_best_in_task(topics, truncate), "term_id INT, k INT, v DOUBLE")
        kept = top_per_group(cells, ["k"], [F.desc("v"), F.asc("term_id")], truncate)
        slots = [F.max(F.when(F.col("k") == k, F.col("v"))) for k in range(topics)]
        sums = kept.groupBy("term_id").agg(F.array(*(F.coalesce(s, F.lit(0.0)) for s in slots)).alias("s"))
    sums, path = write_round(sums)
    present = lambda k: F.sum((F.col("s")[k] > 0).cast("long")).alias(f"n{k}")
    totals = sums.agg(
        *(F.sum(F.col("s")[k]).alias(f"t{k}") for k in range(topics)), *(present(k) for k in range(topics))
    ).first()
    keys = sum(totals[f"n{k}"] or 0 for k in range(topics))
    n_terms = max(1, round(keys / topics))
    floor = math.exp(LOG_FLOOR)
    norms = F.array(*(F.lit(float(totals[f"t{k}"] or 0.0) + floor * n_terms) for k in range(topics)))
    rows = sums.select(
        "term_id", F.zip_with("s", norms, lambda s, z: F.log(s / z + F.lit(floor))).alias("log_beta")
    )
    return rows, n_terms, path


def update_alpha(
    alpha: np.ndarray, stats: np.ndarray, n_docs: int, max_steps: int = 1000, tol: float = 1e-6
) -> np.ndarray:
    """Newton steps for the K values of alpha (diagonal plus rank-one Hessian)."""
    alpha = np.array(alpha, float)
    decay = 0
    for _ in range(max_steps):
        total = alpha.sum()
        gradient = n_docs * (digamma(total) - digamma(alpha)) + stats
        diagonal = -n_docs * trigamma(alpha)
        rank_one = n_docs * trigamma(total)
        c = (gradient / diagonal).sum() / (1.0 / rank_one + (1.0 / diagonal).sum())
        direction = (gradient - c) / diagonal
        while decay <= 10 and (alpha <= 0.8**decay * direction).any():
            decay += 1
        if decay > 10:
            break
        step = 0.8**decay * direction
        moved = alpha - step
        small = np.abs(step / alpha).max() < tol
        alpha = moved
        if small:
            break
    return alpha


def update_alpha_symmetric(
    alpha: float, topics: int, stat_sum: float, n_docs: int, max_steps: int = 1000, tol: float = 1e-6
) -> float:
    """Newton in log space for one shared alpha."""
    log_a = math.log(alpha)
    for _ in range(max_steps):
        a = math.exp(log_a)
        first = n_docs * topics * float(digamma(topics * a) - digamma(a)) + stat_sum
        second = n_docs * (topics * topics * float(trigamma(topics * a)) - topics * float(trigamma(a)))
        step = first / (second * a + first)
        log_a -= step
        if abs(step) < tol:
            break
    return math.exp(log_a)


def alpha_summary(stepped: DataFrame, topics: int) -> tuple[np.ndarray, float, int]:
    """Alpha statistics, corpus likelihood and document count from the per-task rows."""
    row = stepped.filter("kind = 'alpha'").agg(
        F.sum("loglik").alias("ll"), F.sum("id").alias("d"), *(F.sum(F.col("vec")[k]).alias(f"s{k}") for k in range(topics))
    ).first()
    return np.array([row[f"s{k}"] for k in range(topics)]), row["ll"], row["d"]


def doc_rows(stepped: DataFrame) -> DataFrame:
    """Documents with their gamma, ready for the next round."""
    return stepped.filter("kind = 'doc' and terms is not null").select(
        F.col("id").alias("doc_no"), "terms", "counts", F.col("vec").alias("gamma")
    )


def wide_rows(stepped: DataFrame) -> DataFrame:
    """``(doc_no, gamma)`` of the wide documents."""
    return stepped.filter("kind = 'doc' and terms is null").select(F.col("id").alias("doc_no"), F.col("vec").alias("gamma"))


def phi_rows(stepped: DataFrame) -> DataFrame:
    """``(doc_no, term_id, n, log_phi)`` from an E-step run with ``want_phi``."""
    zipped = F.explode(F.arrays_zip("terms", "counts", "log_phi")).alias("e")
    return stepped.filter("kind in ('doc', 'phi') and terms is not null").select(F.col("id").alias("doc_no"), zipped).select(
        "doc_no", F.col("e.terms").alias("term_id"), F.col("e.counts").alias("n"), F.col("e.log_phi").alias("log_phi")
    )


def train_lda(
    docs: DataFrame,
    topics: int,
    n_terms: int,
    max_iter: int = 30,
    seed: int = 0,
    inner_iter: int = INNER_ITER,
    inner_tol: float | None = None,
    seeds: DataFrame | None = None,
    truncate: int | None = None,
    random_start: bool = False,
    update_prior: bool = True,
    tol: float = 1e-6,
    start: TopicModel | None = None,
    on_iteration=None,
    truncate_from: int = 5,
    wide: DataFrame | None = None,
    symmetric: bool = False,
) -> TopicModel:
    """Alternate E-step, beta and alpha until the likelihood settles.

    ``wide`` holds the terms of documents too wide for one task (see ``split_wide``); like the
    others they go on from their gamma of the round before. ``symmetric`` keeps one alpha for
    all topics.

    A round's output is written once, a folder for each kind of row, so that the few alpha
    rows and the term sums are read without the documents. Once a round is written, the tables of
    the one before are deleted; with ``on_iteration`` a round later, as the model handed to it can be
    read during the next round. Those of the last round stay for the model (``discard_model``).
    """
    spark = docs.sparkSession
    if start is None:
        alpha, wide_gamma = start_alpha(topics, seed), None
        if symmetric:
            alpha = np.full(topics, alpha.mean())
        beta = spark.createDataFrame([], "term_id INT, log_beta ARRAY<DOUBLE>")
        first, history = 0, []
    else:
        alpha, beta, n_terms, first = start.alpha, start.beta, start.n_terms, start.iteration
        wide, wide_gamma, history = start.wide if wide is None else wide, start.wide_gamma, list(start.loglik)
    previous = history[-1] if history else 0.0
    done, written, held = first, [], 1 if on_iteration is None else 2
    for i in range(first, max_iter):
        step, model_path = _e_step(docs, alpha, beta, n_terms, (inner_iter, inner_tol, random_start, False, not random_start, True), seed)
        if wide is not None:
            step = step.unionByName(wide_e_step(wide, alpha, beta, n_terms, inner_iter, seed, gamma=wide_gamma, tol=inner_tol))
        stepped, step_path = write_round(step, "kind")
        if model_path is not None:
            remove_round(spark, model_path)
        stats, loglik, n_docs = alpha_summary(stepped, topics)
        beta, n_terms, beta_path = _m_step(stepped, topics, seeds, truncate if i >= truncate_from else None)
        written.append((step_path, beta_path))
        for old in written[:-held]:
            for path in old:
                remove_round(spark, path)
        written = written[-held:]
        if update_prior and symmetric:
            alpha = np.full(topics, update_alpha_symmetric(float(alpha.mean()), topics, float(stats.sum()), n_docs))
        elif update_prior:
            alpha = update_alpha(alpha, stats, n_docs)
        if not random_start:
            docs = doc_rows(stepped)
            wide_gamma = None if wide is None else wide_rows(stepped)
        history.append(loglik)
        done = i + 1
        model = TopicModel(alpha, beta, n_terms, docs, list(history), done, wide, wide_gamma)
        if on_iteration is not None:
            on_iteration(model)
        if previous != 0.0 and abs((previous - loglik) / previous) <= tol:
            break
        previous = loglik
    return TopicModel(alpha, beta, n_terms, docs, history, done, wide, wide_gamma, written[-1] if written else ())


def discard_model(model: TopicModel) -> None:
    """Delete the tables that training wrote for ``model``, say after a snapshot: it can't be read any more."""
    for path in model.tables:
        remove_round(model.beta.sparkSession, path)


def infer_lda(
    docs: DataFrame, model: TopicModel, inner_iter: int = INNER_ITER, inner_tol: float | None = None, random_start: bool = True,
    wide: DataFrame | None = None,
) -> DataFrame:
    """Held-out documents: one E-step, no learning; gamma, phi and likelihood per document.

    Documents in ``wide`` get the same, their phi as rows of one term each (``phi_rows`` reads both).
    """
    found = e_step(
        docs, model.alpha, model.beta, model.n_terms, inner_iter, inner_tol, random_start, want_phi=True, want_sums=False
    )
    if wide is None:
        return found
    others = wide_e_step(wide, model.alpha, model.beta, model.n_terms, inner_iter, tol=inner_tol, want_phi=True)
    return found.unionByName(others.filter("kind <> 'beta'"))


def beta_long(beta: DataFrame) -> DataFrame:
    """Beta rows as ``(topic, term_id, log_beta)``."""
    return beta.select("term_id", F.posexplode("log_beta").alias("k", "log_beta")).select(
        (F.col("k") + 1).alias("topic"), "term_id", "log_beta"
    )


def save_model(model: TopicModel, path: str, phi: DataFrame | None = None) -> str:
    """Snapshot under ``path/iter=N`` as alpha, beta, gamma (and phi) tables."""
    spark: SparkSession = model.beta.sparkSession
    root = f"{path}/iter={model.iteration}"
    rows = [(k + 1, float(a), model.n_terms) for k, a in enumerate(model.alpha)]
    spark.createDataFrame(rows, "topic INT, alpha DOUBLE, n_terms LONG").write.mode("overwrite").parquet(f"{root}/alpha")
    beta_long(model.beta).write.mode("overwrite").parquet(f"{root}/beta")
    model.docs.write.mode("overwrite").parquet(f"{root}/gamma")
    spark.createDataFrame(list(enumerate(model.loglik)), "round INT, loglik DOUBLE").write.mode("overwrite").parquet(f"{root}/loglik")
    wide = model.wide if model.wide is not None else spark.createDataFrame([], "doc_no LONG, term_id LONG, n LONG")
    wide.select("doc_no", "term_id", "n").write.mode("overwrite").parquet(f"{root}/wide")
    gamma = model.wide_gamma if model.wide_gamma is not None else spark.createDataFrame([], "doc_no LONG, gamma ARRAY<DOUBLE>")
    gamma.write.mode("overwrite").parquet(f"{root}/wide_gamma")
    if phi is not None:
        phi.write.mode("overwrite").parquet(f"{root}/phi")
    return root


def load_model(spark: SparkSession, path: str, iteration: int) -> TopicModel:
    """Read a snapshot; alpha must hold exactly the topics 1..K."""
    root = f"{path}/iter={iteration}"
    rows = spark.read.parquet(f"{root}/alpha").orderBy("topic").collect()
    topics = len(rows)
    if [r["topic"] for r in rows] != list(range(1, topics + 1)):
        raise ValueError("alpha must hold every topic from 1 to K exactly once")
    long = spark.read.parquet(f"{root}/beta")
    cells = [F.max(F.when(F.col("topic") == k, F.col("log_beta"))) for k in range(1, topics + 1)]
    beta = long.groupBy("term_id").agg(F.array(*(F.coalesce(c, F.lit(LOG_FLOOR)) for c in cells)).alias("log_beta"))
    docs = spark.read.parquet(f"{root}/gamma")
    alpha = np.array([r["alpha"] for r in rows])
    history = [r["loglik"] for r in spark.read.parquet(f"{root}/loglik").orderBy("round").collect()]
    wide, gamma = (spark.read.parquet(f"{root}/{name}") for name in ("wide", "wide_gamma"))
    wide, gamma = (None if part.isEmpty() else part for part in (wide, gamma))
    return TopicModel(alpha, beta, rows[0]["n_terms"], docs, history, iteration, wide, gamma)


def resume_training(spark: SparkSession, path: str, iteration: int, max_iter: int, **options) -> TopicModel:
    """Go on from a snapshot with its stored gamma."""
    start = load_model(spark, path, iteration)
    return train_lda(start.docs, len(start.alpha), start.n_terms, max_iter, start=start, **options)


def wide_e_step(
    wide: DataFrame, alpha: np.ndarray, beta: DataFrame, n_terms: int, passes: int = INNER_ITER, seed: int = 0, cut_every: int = 10,
    gamma: DataFrame | None = None, tol: float | None = None, want_phi: bool = False, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """E-step for documents too wide for one task, from ``(doc_no, term_id, n)``.

    The vocabulary is cut into blocks; a block holds the model rows of its terms once and what
    the documents have of them, and is written once. A pass sends the posteriors to the blocks
    and adds up what comes back, K numbers for each document and block: terms and model rows do
    not move again. Rows are those of ``e_step`` without the term lists; phi comes as one
    ``phi`` row for each document and block. Starts from ``gamma`` where given, else from the word
    count. Lineage is cut, and with ``tol`` the documents none of whose values moved by as much
    are left out from then on, every ``cut_every`` passes.
    """
    alpha = np.asarray(alpha, float)
    blocks, n_docs, groups = _vocabulary_blocks(wide, len(alpha), beta, n_terms, seed, max(1, block_cells // len(alpha)))
    stored = gamma
    words = blocks.select(F.explode(F.arrays_zip("docs", "words")).alias("e")).groupBy(F.col("e.docs").alias("doc_no"))
    gamma = words.agg(F.sum("e.words").alias("words")).select(
        "doc_no", F.array(*(F.lit(float(a)) + F.col("words") / len(alpha) for a in alpha)).alias("gamma")
    )
    if stored is not None:
        kept = stored.select("doc_no", F.col("gamma").alias("_stored"))
        gamma = gamma.join(kept, "doc_no", "left").select("doc_no", F.coalesce("_stored", "gamma").alias("gamma"))
    gamma, settled = cut_lineage(gamma), None
    for i in range(1, passes):
        before, gamma = gamma, _add_up(_pass_blocks(blocks, gamma, n_docs, groups, len(alpha)).filter("kind = 'part'"), alpha)
        if i % cut_every == 0:
            gamma = cut_lineage(gamma)
            if tol is not None:
                moved = F.array_max(F.zip_with("gamma", "_before", lambda a, b: F.abs(a - b)))
                gamma = gamma.join(before.select("doc_no", F.col("gamma").alias("_before")), "doc_no").withColumn("_still", moved < tol)
                gamma = cut_lineage(gamma.select("doc_no", "gamma", "_still"))
                resting, gamma = gamma.filter("_still").drop("_still"), gamma.filter("not _still").drop("_still")
                settled = resting if settled is None else settled.unionByName(resting)
                if gamma.isEmpty():
                    break
    gamma = gamma if settled is None else gamma.unionByName(settled)
    final = cut_lineage(_pass_blocks(blocks, gamma, n_docs, groups, len(alpha), last=True, want_phi=want_phi))
    docs = _add_up(final.filter("kind = 'part'"), alpha, F.sum("loglik").alias("part_ll"))
    docs = cut_lineage(docs.select("doc_no", "gamma", _likelihood(alpha)("gamma", "part_ll").alias("loglik")))
    shape = lambda kind, ident, vec: docs.select(
        F.lit(kind).alias("kind"), ident.cast("long").alias("id"), vec.alias("vec"), F.col("loglik").cast("double"), F.lit(None).cast("array<int>").alias("terms"),
        F.lit(None).cast("array<double>").alias("counts"), F.lit(None).cast("array<array<double>>").alias("log_phi"),
    )
    return final.filter("kind <> 'part'").unionByName(shape("doc", F.col("doc_no"), F.col("gamma"))).unionByName(shape("alpha", F.lit(1), _alpha_stat("gamma")))


def _vocabulary_blocks(wide: DataFrame, topics: int, beta: DataFrame, n_terms: int, seed: int, entries: int) -> tuple[DataFrame, int, int]:
    """Blocks of about ``entries`` (document, term) pairs, the number of documents, and of their groups.

    A block is one row: its terms and their model weights, its documents and how many words each
    has in it, and the pairs as places in these two lists. Documents are dealt too, in groups of
    at most ``entries`` or so, should a term stand in more than a block can hold. Smaller data are cut
    into a few blocks for each core, and every block is a file, as each pass reads them anew. The pairs
    lie by document.
    """
    pairs = wide.select(F.col("doc_no").cast("long"), F.col("term_id").cast("int"), F.col("n").cast("double"))
    size = pairs.agg(F.count("*").alias("n"), F.countDistinct("doc_no").alias("docs")).first()
    cores = 2 * wide.sparkSession.sparkContext.defaultParallelism
    parts, groups = max(1, math.ceil(size["n"] / entries), min(cores, math.ceil(size["n"] / SHARE_PAIRS))), max(1, math.ceil(size["docs"] / entries))
    cut = F.pmod(F.xxhash64("term_id"), F.lit(parts)).alias("part")
    dealt = pairs.select(cut, F.pmod(F.xxhash64("doc_no"), F.lit(groups)).alias("group"), "doc_no", "term_id", "n")
    needed = dealt.select("part", "group", "term_id").distinct()
    model = needed.join(beta.select(F.col("term_id").cast("int").alias("term_id"), "log_beta"), "term_id").select(
        *(F.col(c).alias(c) for c in ("part", "group", "term_id", "log_beta"))  # new column identities: both sides come from ``wide``
    )
    shape = "part LONG, group LONG, terms ARRAY<INT>, model ARRAY<DOUBLE>, docs ARRAY<LONG>, words ARRAY<DOUBLE>, term_at ARRAY<INT>, doc_at ARRAY<INT>, n ARRAY<DOUBLE>"

    def build(key, own: pa.Table, rows: pa.Table) -> pa.Table:
        plain = lambda table, name: table.column(name).combine_chunks().to_numpy()
        terms, term_at = np.unique(plain(own, "term_id"), return_inverse=True)
        docs, doc_at = np.unique(plain(own, "doc_no"), return_inverse=True)
        order = np.lexsort((term_at, doc_at))
        term_at, doc_at, n = term_at[order], doc_at[order], plain(own, "n")[order]
        weights, known = start_rows(terms, topics, n_terms, seed), plain(rows, "term_id")
        if len(known):
            weights[np.searchsorted(terms, known)] = np.exp(rows.column("log_beta").combine_chunks().flatten().to_numpy().reshape(-1, topics))
        words = np.bincount(doc_at, n, len(docs))
        lists = [terms, weights.ravel(), docs, words, term_at.astype(np.int32), doc_at.astype(np.int32), n]
        names = ["terms", "model", "docs", "words", "term_at", "doc_at", "n"]
        head = {"part": pa.array([key[0].as_py()], pa.int64()), "group": pa.array([key[1].as_py()], pa.int64())}
        return pa.table({**head, **{k: _lists([0, len(v)], v) for k, v in zip(names, lists)}})

    keys = ["part", "group"]
    built = dealt.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInArrow(build, shape)
    return cut_lineage(built.repartitionByRange(parts * groups, *keys)), size["docs"], groups


def _pass_blocks(blocks: DataFrame, gamma: DataFrame, n_docs: int, groups: int, topics: int, last: bool = False, want_phi: bool = False) -> DataFrame:
    """One pass over all blocks: ``part`` rows, a document's share of its posterior from a block.

    The ``last`` pass also gives the likelihood's share, the topic sums of every term and, on
    request, phi. Documents without a posterior are passed over.
    """
    packed = gamma.groupBy(F.pmod(F.xxhash64("doc_no"), F.lit(groups)).alias("group")).agg(F.sort_array(F.collect_list(F.struct("doc_no", "gamma"))).alias("g"))
    packed = packed.select("group", F.col("g.doc_no").alias("known"), F.flatten("g.gamma").alias("gamma"))
    if n_docs * (topics + 1) * 8 <= GAMMA_BYTES:  # counted
        packed = F.broadcast(packed)
    columns = ["terms", "model", "docs", "term_at", "doc_at", "n", "known", "gamma"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                terms, model, docs, term_at, doc_at, n, known, own = (batch.column(c)[i].values.to_numpy() for c in columns)
                model, t = model.reshape(-1, topics), digamma(own.reshape(-1, topics))
                place = np.minimum(np.searchsorted(known, docs), len(known) - 1)
                there = known[place] == docs
                if not there.all():
                    mine = there[doc_at]
                    term_at, doc_at, n = term_at[mine], doc_at[mine], n[mine]
                if not len(n):
                    continue
                t = t[place]
                shift = t.max(1)
                e = np.exp(t - shift[:, None])
                gain, likelihood, sums = np.zeros(t.shape), np.zeros(len(docs)), np.zeros(model.shape)
                for at in range(0, len(n), MATRIX_ROWS):
                    term, doc, count = (v[at : at + MATRIX_ROWS] for v in (term_at, doc_at, n))
                    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    met = doc[first]
                    if not last and len(doc) >= LONG_RUN * len(met):
                        weights = model[term]
                        for d, start, end in zip(met, first, [*first[1:], len(doc)]):
                            own_rows = weights[start:end]
                            gain[d] += e[d] * ((count[start:end] / (own_rows @ e[d])) @ own_rows)
                        continue
                    phi = model[term] * e[doc]
                    norm = phi.sum(1)
                    phi /= norm[:, None]
                    gain[met] += np.add.reduceat(phi * count[:, None], first, axis=0)
                    if last:
                        likelihood += np.bincount(doc, count * (np.log(norm) + shift[doc] - (phi * t[doc]).sum(1)), len(docs))
                        np.add.at(sums, term, phi * count[:, None])
                        if want_phi:
                            ends = np.append(first, len(doc)).astype(np.int32)
                            flat = np.arange(0, phi.size + 1, topics, dtype=np.int32)
                            with np.errstate(divide="ignore"):
                                logs = pa.ListArray.from_arrays(pa.array(ends), _lists(flat, np.log(phi).ravel()))
                            yield _frame(
                                len(met), kind=pa.array(["phi"] * len(met)), id=pa.array(docs[met]), terms=_lists(ends, terms[term]),
                                counts=_lists(ends, count), log_phi=logs,
                            )
                rows = np.flatnonzero(there)
                wide = np.arange(0, len(rows) * topics + 1, topics, dtype=np.int32)
                yield _frame(
                    len(rows), kind=pa.array(["part"] * len(rows)), id=pa.array(docs[rows]), vec=_lists(wide, gain[rows].ravel()),
                    loglik=pa.array(likelihood[rows]),
                )
                if last:
                    flat = np.arange(0, sums.size + 1, topics, dtype=np.int32)
                    yield _frame(len(terms), kind=pa.array(["beta"] * len(terms)), id=pa.array(terms.astype(np.int64)), vec=_lists(flat, sums.ravel()))

    return blocks.join(packed, "group").select(*columns).mapInArrow(run, RESULT)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _alpha_stat(gamma: pd.Series) -> pd.Series:
    g = np.stack(gamma) if len(gamma) else np.ones((0, 1))
    return pd.Series(list(digamma(g) - digamma(g.sum(1))[:, None]))


def _likelihood(alpha: np.ndarray):
    prior = float(lgamma(alpha.sum()) - lgamma(alpha).sum())

    @F.pandas_udf(T.DoubleType())
    def whole(gamma: pd.Series, part: pd.Series) -> pd.Series:
        g = np.stack(gamma) if len(gamma) else np.ones((0, 1))
        return part + prior + lgamma(g).sum(1) - lgamma(g.sum(1))

    return whole


def _add_up(parts: DataFrame, alpha: np.ndarray, *extra) -> DataFrame:
    """Posterior of every document from the shares of its blocks: ``(doc_no, gamma)`` and ``extra`` sums."""
    sums = parts.groupBy(F.col("id").alias("doc_no")).agg(*(F.sum(F.col("vec")[k]).alias(f"g{k}") for k in range(len(alpha))), *extra)
    rest = [c for c in sums.columns if c != "doc_no" and not c.startswith("g")]
    return sums.select("doc_no", F.array(*(F.col(f"g{k}") + float(a) for k, a in enumerate(alpha))).alias("gamma"), *rest)
