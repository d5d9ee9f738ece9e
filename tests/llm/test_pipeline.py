import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
from test_similar_texts import exact
from tokenizers import Tokenizer

from topiclens.llm.mixing import mix
from topiclens.llm.toxicity import toxicity

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.predicted for r in toxicity(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()}

    clean = stages["toxicity"](spark, docs, SF_DIR)
    assert clean.schema == docs.schema
    rows = clean.collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, p in scores.items() if not p)

    single = stages["simhash_near_dedup"](spark, clean, SF_DIR)
    assert single.columns == docs.columns
    found = [rows[i].doc_id for i in exact([r.text for r in rows])]
    rows = single.collect()
    assert len(rows) == len(set(found)) < len(found)
    held = dict(zip((r.doc_id for r in clean.collect()), found))
    assert len({held[r.doc_id] for r in rows}) == len(rows)  # one document of each group stays

    unleaked = stages["benchmark_decontamination"](spark, single, SF_DIR)
    assert unleaked.columns == docs.columns
    items = pd.read_parquet(f"{SF_DIR}/benchmark.parquet")
    leaked = {d for d, _ in brute.leaks([(r.doc_id, r.text) for r in rows], list(zip(items.item_id.tolist(), items.text)))}
    assert leaked
    rows = unleaked.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in single.collect()} - leaked

    taken = stages["source_mixing"](spark, unleaked, SF_DIR)
    assert taken.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mix(unleaked).collect()}
    rows = taken.collect()
    assert Counter(r.doc_id for r in rows) == Counter({d: c for d, c in copies.items() if c})

    plain, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stages["token_files"](spark, taken, SF_DIR).collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect()) == want


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            if name != "token_files":
                assert docs.columns == columns
        docs.collect()
