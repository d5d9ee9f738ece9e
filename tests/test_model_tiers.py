"""Models sent to the tasks, read by them or exchanged."""

import numpy as np
from pyspark.sql import functions as F

from topiclens.plans import training as M
from topiclens.session import ensure_checkpoint_dir

TOPICS, TERMS = 3, 60


def corpus(spark):
    rows = [(d, t, 1 + (d * t) % 4) for d in range(1, 41) for t in range(1, TERMS + 1) if (d * 7 + t * 3) % 5 < 1 + d % 3]
    return M.pack_documents(spark.createDataFrame(rows, "doc_no LONG, term_id LONG, n LONG"))


def model(spark, scale=1):
    draw = np.random.default_rng(2)
    rows = [(t * scale, [float(v) for v in np.log(draw.random(TOPICS))]) for t in range(1, TERMS - 9)]  # the last terms are not in the model
    return spark.createDataFrame(rows, "term_id INT, log_beta ARRAY<DOUBLE>")


def stepped(spark, cells, beta, docs, **options):
    out = M.e_step(docs, [0.3, 0.2, 0.4], beta, TERMS, tol=1e-3, model_cells=cells, **options)
    docs = {r["id"]: (r["vec"], r["loglik"], dict(zip(r["terms"], r["counts"]))) for r in out.filter("kind = 'doc'").collect()}
    sums = M.m_step_beta(M.cut_lineage(out), TOPICS)[0].collect()
    return out, docs, {r["term_id"]: r["log_beta"] for r in sums}


def test_tiers_of_models_agree(spark):
    plans = []
    for scale in (1, 1 << 24):  # dense ids, and ids too far apart to mark each
        docs, beta = corpus(spark), model(spark, scale)
        docs = docs.withColumn("terms", F.transform("terms", lambda t: t * scale)) if scale > 1 else docs
        found = [stepped(spark, cells, beta, docs) for cells in (10**6, 30, 3)]
        plans += [("cogroup" in out._jdf.queryExecution().toString().lower()) for out, _, _ in found]
        for _, others, sums in found[1:]:
            assert others.keys() == found[0][1].keys() and sums.keys() == found[0][2].keys() and len(others) == 40
            for d, (gamma, loglik, terms) in others.items():
                assert np.allclose(gamma, found[0][1][d][0]) and np.isclose(loglik, found[0][1][d][1]) and terms == found[0][1][d][2]
            assert all(np.allclose(v, found[0][2][t]) for t, v in sums.items())
    assert plans == [False, False, True] * 2  # only the largest models are exchanged


def test_runs_hold_whole_documents(spark):
    batch = corpus(spark).select("doc_no", "terms", "counts", "gamma").toArrow().combine_chunks().to_batches()[0]
    runs = list(M._runs(iter([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)]), 50))
    assert [d for r in runs for d in r.column("doc_no").to_pylist()] == batch.column("doc_no").to_pylist()
    sizes = [np.asarray(r.column("terms").value_lengths()) for r in runs]
    assert all(s.sum() >= 50 and s[:-1].sum() < 50 for s in sizes[:-1]) and len(runs) > 5


def test_training_leaves_no_model_files(spark, monkeypatch):
    folder = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    listed = lambda: {f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    whole = M.train_lda(corpus(spark), TOPICS, TERMS, max_iter=4, inner_tol=1e-3, tol=0.0)
    before, step = listed(), M._e_step
    monkeypatch.setattr(M, "_e_step", lambda *args: step(*args, model_cells=30))
    read = M.train_lda(corpus(spark), TOPICS, TERMS, max_iter=4, inner_tol=1e-3, tol=0.0)
    assert np.allclose(read.alpha, whole.alpha) and np.allclose(read.loglik, whole.loglik)
    assert {n for n in listed() - before if n.startswith(("round-", "table-"))} == {p.rsplit("/", 1)[1] for p in read.tables}
