from topiclens.catalog import QUERIES
from topiclens.plans import training as M

SF_DIR = "/root/testdata/sf0.001"


def test_wide_documents_count(spark, monkeypatch):
    """Documents too wide for a task have a posterior and a likelihood like the others."""
    want = QUERIES["log_likelihood_passes"](spark, SF_DIR).first()
    split = M.split_wide
    monkeypatch.setattr(M, "split_wide", lambda indexed: split(indexed, 150))
    got = QUERIES["log_likelihood_passes"](spark, SF_DIR).first()
    assert got.n_docs == want.n_docs
    assert abs(got.loglik - want.loglik) <= 1e-6 * abs(want.loglik)
