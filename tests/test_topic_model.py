import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topiclens.functions.special import digamma, lgamma, trigamma
from topiclens.plans import training as M

TOPICS, TERMS = 3, 40


def reference_posterior(terms, counts, alpha, log_beta, passes):
    """One document in log space, straight from the update rules."""
    gamma = alpha + counts.sum() / len(alpha)
    for _ in range(passes):
        t = digamma(gamma)
        logits = log_beta[terms] + t
        log_phi = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
        gamma = np.exp(np.logaddexp(np.log(alpha), np.logaddexp.reduce(log_phi + np.log(counts)[:, None], axis=0)))
    phi = np.exp(log_phi)
    l_phi = (counts[:, None] * phi * (log_beta[terms] - log_phi)).sum()
    ll = math.lgamma(alpha.sum()) - sum(map(math.lgamma, alpha)) + sum(map(math.lgamma, gamma)) - math.lgamma(gamma.sum()) + l_phi
    return gamma, log_phi, ll


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    rows = [(d, int(t), int(rng.integers(1, 6))) for d in range(25) for t in rng.choice(TERMS, rng.integers(3, 15), replace=False) + 1]
    log_beta = np.log(rng.dirichlet(np.full(TERMS, 0.3), TOPICS).T + 1e-8)
    table = spark.createDataFrame([(i + 1, [float(v) for v in row]) for i, row in enumerate(log_beta)], "term_id INT, log_beta ARRAY<DOUBLE>")
    bag = spark.createDataFrame(rows, "doc_no LONG, term_id LONG, n LONG")
    return pd.DataFrame(rows, columns=["doc", "term", "n"]), bag, np.vstack([np.zeros(TOPICS), log_beta]), table


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 3.7, 50.0])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], atol=1e-12)
    h = 1e-4
    assert np.allclose(digamma(x[1:]), (lgamma(x[1:] + h * x[1:]) - lgamma(x[1:] - h * x[1:])) / (2 * h * x[1:]), rtol=1e-6)
    assert math.isclose(float(digamma(1.0)), -0.5772156649015329, abs_tol=1e-13)
    assert math.isclose(float(trigamma(1.0)), math.pi**2 / 6, abs_tol=1e-12)


@pytest.mark.parametrize("cells", [10**6, 1, 60])
def test_e_step_matches_brute_force(corpus, cells):
    """Both with the model sent to the tasks and with batches of documents that meet their terms' rows."""
    pdf, bag, log_beta, table = corpus
    alpha = np.array([0.2, 0.5, 1.1])
    out = M.e_step(M.pack_documents(bag), alpha, table, TERMS, want_phi=True, model_cells=cells)
    docs = out.filter("kind = 'doc'").toPandas().set_index("id")
    sums = np.zeros((TERMS + 1, TOPICS))
    stat = np.zeros(TOPICS)
    for doc, group in pdf.groupby("doc"):
        group = group.sort_values("term")
        terms, counts = group["term"].to_numpy(), group["n"].to_numpy(float)
        gamma, log_phi, ll = reference_posterior(terms, counts, alpha, log_beta, 99)
        assert np.allclose(docs.loc[doc, "vec"], gamma)
        assert math.isclose(docs.loc[doc, "loglik"], ll, rel_tol=1e-9)
        assert np.allclose(np.stack(docs.loc[doc, "log_phi"]), log_phi, atol=1e-7)
        assert math.isclose(sum(docs.loc[doc, "vec"]), alpha.sum() + counts.sum(), rel_tol=1e-9)
        np.add.at(sums, terms, np.exp(log_phi) * counts[:, None])
        stat += digamma(gamma) - digamma(gamma.sum())
    found = out.filter("kind = 'beta'").groupBy("id").agg(F.array(*(F.sum(F.col("vec")[k]) for k in range(TOPICS))).alias("s"))
    for row in found.collect():
        assert np.allclose(row["s"], sums[row["id"]])
    total, loglik, n_docs = M.alpha_summary(out, TOPICS)
    assert np.allclose(total, stat) and n_docs == 25
    beta, _ = M.m_step_beta(out, TOPICS)
    mass = np.array([np.exp(r["log_beta"]) for r in beta.collect()]).sum(0)
    assert np.allclose(mass, 1.0, atol=1e-5)


def test_wide_documents_agree(corpus):
    """Documents fitted by grouped sums give the same posterior, sums and statistics."""
    _, bag, _, table = corpus
    alpha = np.array([0.2, 0.5, 1.1])
    narrow = M.e_step(M.pack_documents(bag), alpha, table, TERMS, inner_iter=6)
    wide = M.wide_e_step(bag, alpha, table, TERMS, passes=6, cut_every=3)
    docs = [df.filter("kind = 'doc'").toPandas().set_index("id").sort_index() for df in (narrow, wide)]
    assert np.allclose(np.stack(docs[0]["vec"]), np.stack(docs[1]["vec"]))
    assert np.allclose(docs[0]["loglik"], docs[1]["loglik"])
    a, b = (M.alpha_summary(df, TOPICS) for df in (narrow, wide))
    assert np.allclose(a[0], b[0]) and math.isclose(a[1], b[1], rel_tol=1e-9) and a[2] == b[2]
    betas = [M.m_step_beta(df, TOPICS)[0].toPandas().set_index("term_id").sort_index()["log_beta"] for df in (narrow, wide)]
    assert np.allclose(np.stack(betas[0]), np.stack(betas[1]))


def test_small_data_are_cut_for_every_core(corpus, monkeypatch):
    """Several blocks though one could hold all, and documents with long runs of terms, give the same posterior."""
    monkeypatch.setattr(M, "SHARE_PAIRS", 50, raising=False)
    monkeypatch.setattr(M, "LONG_RUN", 2, raising=False)
    _, bag, _, table = corpus
    alpha = np.array([0.2, 0.5, 1.1])
    assert M._vocabulary_blocks(bag, 3, table, TERMS, 0, 10**6)[0].count() > 2
    narrow = M.e_step(M.pack_documents(bag), alpha, table, TERMS, inner_iter=3)
    wide = M.wide_e_step(bag, alpha, table, TERMS, passes=3)
    docs = [{r.id: r.vec for r in df.filter("kind = 'doc'").collect()} for df in (narrow, wide)]
    assert docs[0].keys() == docs[1].keys() and all(np.allclose(docs[0][d], docs[1][d]) for d in docs[0])


def test_vocabulary_blocks_agree(spark, corpus):
    """Several blocks of terms and groups of documents, unseen terms, stored posteriors, phi, and documents that settle."""
    _, bag, _, table = corpus
    alpha, part = np.array([0.2, 0.5, 1.1]), table.filter("term_id <= 30")
    stored = spark.createDataFrame([(d, [1.0 + d, 2.0, 3.0]) for d in range(0, 25, 2)], "doc_no LONG, gamma ARRAY<DOUBLE>")
    packed = M.pack_documents(bag).drop("gamma").join(stored, "doc_no", "left").select("doc_no", "terms", "counts", "gamma")
    narrow = M.e_step(packed, alpha, part, TERMS, inner_iter=5, want_phi=True, seed=4)
    wide = M.wide_e_step(bag, alpha, part, TERMS, passes=5, seed=4, cut_every=2, gamma=stored, want_phi=True, block_cells=30)
    docs = [{r.id: (r.vec, r.loglik) for r in df.filter("kind = 'doc'").collect()} for df in (narrow, wide)]
    assert docs[0].keys() == docs[1].keys() and all(np.allclose(docs[0][d][0], docs[1][d][0]) and math.isclose(docs[0][d][1], docs[1][d][1], rel_tol=1e-9) for d in docs[0])
    phis = [{(r.doc_no, r.term_id): (r.n, r.log_phi) for r in M.phi_rows(df).collect()} for df in (narrow, wide)]
    assert phis[0].keys() == phis[1].keys() and all(phis[0][k][0] == phis[1][k][0] and np.allclose(phis[0][k][1], phis[1][k][1]) for k in phis[0])
    ends = [M.wide_e_step(bag, alpha, part, TERMS, passes=60, seed=4, cut_every=20, tol=tol, block_cells=90).filter("kind = 'doc'") for tol in (None, 1e-4)]
    ends = [{r.id: r.vec for r in df.collect()} for df in ends]
    assert all(np.allclose(ends[0][d], ends[1][d], atol=0.02) for d in ends[0])


def test_documents_stop_on_their_own(corpus):
    """With a tolerance a document's posterior does not depend on the others in its block."""
    pdf, bag, _, table = corpus
    alpha = np.array([0.2, 0.5, 1.1])
    got = {}
    for cells in (10**6, 60):  # all documents in one block, and a few in each batch
        rows = M.e_step(M.pack_documents(bag), alpha, table, TERMS, tol=1e-3, model_cells=cells).filter("kind = 'doc'").collect()
        got[cells] = {r.id: r.vec for r in rows}
    assert all(np.allclose(got[60][d], got[10**6][d], rtol=1e-12) for d in range(25))
    full = {r.id: r.vec for r in M.e_step(M.pack_documents(bag), alpha, table, TERMS).filter("kind = 'doc'").collect()}
    assert 0 < max(np.abs(np.subtract(full[d], got[60][d])).max() for d in range(25)) < 0.1


def test_training_with_wide_documents(corpus):
    _, bag, _, _ = corpus
    normal, wide = M.split_wide(bag, limit=9)
    assert wide is not None and M.split_wide(bag, limit=100)[1] is None
    split = M.train_lda(M.pack_documents(normal), TOPICS, TERMS, max_iter=1, inner_iter=4, wide=wide)
    whole = M.train_lda(M.pack_documents(bag), TOPICS, TERMS, max_iter=1, inner_iter=4)
    assert np.allclose(split.alpha, whole.alpha) and math.isclose(split.loglik[0], whole.loglik[0], rel_tol=1e-9)


def test_alpha_update_reaches_a_stationary_point():
    rng = np.random.default_rng(0)
    gammas = rng.gamma(2.0, 3.0, (200, TOPICS)) + 0.5
    stats = (digamma(gammas) - digamma(gammas.sum(1))[:, None]).sum(0)
    alpha = M.update_alpha(np.full(TOPICS, 0.7), stats, 200)
    gradient = 200 * (digamma(alpha.sum()) - digamma(alpha)) + stats
    assert (alpha > 0).all() and np.abs(gradient).max() < 1e-3
    one = M.update_alpha_symmetric(0.7, TOPICS, float(stats.sum()), 200)
    assert abs(200 * TOPICS * float(digamma(TOPICS * one) - digamma(one)) + stats.sum()) < 1e-2


def test_training_raises_likelihood_and_resumes(spark, corpus, tmp_path):
    _, bag, _, _ = corpus
    docs = M.pack_documents(bag)
    seeds = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "topic INT, term_id LONG")
    model = M.train_lda(docs, TOPICS, TERMS, max_iter=4, seeds=seeds, update_prior=False)
    assert all(b >= a - 1.0 for a, b in zip(model.loglik[1:], model.loglik[2:]))
    M.save_model(model, str(tmp_path))
    again = M.load_model(spark, str(tmp_path), model.iteration)
    assert np.allclose(again.alpha, model.alpha) and again.n_terms == model.n_terms
    more = M.resume_training(spark, str(tmp_path), model.iteration, model.iteration + 1)
    assert more.iteration == model.iteration + 1


def test_resuming_with_wide_documents(spark, corpus, tmp_path):
    """Wide documents are saved, go on from their gamma, and get phi."""
    _, bag, *_ = corpus
    normal, wide = M.split_wide(bag, limit=9)
    docs = M.pack_documents(normal)
    whole = M.train_lda(docs, TOPICS, TERMS, max_iter=2, inner_iter=3, wide=wide)
    first = M.train_lda(docs, TOPICS, TERMS, max_iter=1, inner_iter=3, wide=wide)
    M.save_model(first, str(tmp_path))
    resumed = M.resume_training(spark, str(tmp_path), 1, 2, inner_iter=3)
    assert np.allclose(resumed.alpha, whole.alpha, rtol=1e-9) and np.allclose(resumed.loglik, whole.loglik, rtol=1e-9)
    narrow = M.train_lda(M.pack_documents(bag), TOPICS, TERMS, max_iter=2, inner_iter=3)
    assert np.allclose(narrow.alpha, whole.alpha, rtol=1e-6) and np.allclose(narrow.loglik, whole.loglik, rtol=1e-9)
    phi = M.phi_rows(M.infer_lda(docs, whole, inner_iter=3, wide=wide, random_start=False))
    pairs = {(r["doc_no"], r["term_id"]) for r in phi.collect()}
    assert pairs == {(r["doc_no"], r["term_id"]) for r in bag.collect()}


def test_documents_of_all_sizes_end_alike_alone_and_together():
    """Laid side by side by size, no document changes another's posterior or when it stops."""
    draw = np.random.default_rng(4)
    sizes = np.array([1, 1, 2, 3, 40, 41, 55, 7, 300, 40])
    starts, doc_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    rows, counts, alpha = draw.random((sizes.sum(), 4)) ** 4 + 1e-8, draw.integers(1, 9, sizes.sum()).astype(float), draw.random(4)
    gamma = alpha + (np.add.reduceat(counts, starts) / 4)[:, None]
    order, laid = M._alike(rows, starts, counts)
    assert sorted(order) == list(range(len(sizes))) and len(laid) < len(sizes) and sum(len(c) for _, c in laid) == len(sizes)
    for tol in (None, 1e-3):
        last, t, log_norm = M._iterate(rows, doc_of, starts, counts, alpha, gamma, 99, tol)
        for i, n in enumerate(sizes):
            own = slice(starts[i], starts[i] + n)
            g = before = gamma[i]
            for _ in range(99):
                e = np.exp(M.digamma(g))
                before, g = g, alpha + (rows[own] * e * (counts[own] / (rows[own] @ e))[:, None]).sum(0)
                if tol is not None and np.abs(g - before).max() < tol:
                    break
            assert np.allclose(last[i], g) and np.allclose(t[i], M.digamma(before))
            assert np.allclose(log_norm[own], np.log(rows[own] @ np.exp(M.digamma(before))))
