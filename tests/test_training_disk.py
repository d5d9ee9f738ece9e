"""Tables that a training leaves in the shared folder."""

import numpy as np

from topiclens.plans import training as M
from topiclens.session import ensure_checkpoint_dir


def round_folders(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return {f.getPath().getName() for f in files if f.getPath().getName().startswith(("round-", "table-"))}


def test_training_keeps_its_last_round(spark):
    rows = [(d, t, 1 + (d * t) % 3) for d in range(1, 13) for t in range(1, 20) if (d + t) % 3]
    docs = M.pack_documents(spark.createDataFrame(rows, "doc_no LONG, term_id LONG, n LONG"))
    before = round_folders(spark)
    seen = []
    options = {"max_iter": 4, "inner_iter": 5, "tol": 0.0}
    model = M.train_lda(docs, 3, 19, **options)
    left = round_folders(spark) - before
    assert left == {p.rsplit("/", 1)[1] for p in model.tables} and len(left) == 2
    want = sorted(map(str, model.docs.collect())), sorted(map(str, model.beta.collect()))
    # a model handed on can be read until the next round has ended
    late = []
    again = M.train_lda(docs, 3, 19, on_iteration=lambda m: (late.append(seen[-1].docs.count()) if seen else None, seen.append(m)), **options)
    assert late == [12, 12, 12] and np.allclose(again.alpha, model.alpha)
    assert (sorted(map(str, again.docs.collect())), sorted(map(str, again.beta.collect()))) == want
    M.discard_model(model)
    assert not left & round_folders(spark)
