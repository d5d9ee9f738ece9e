import random
import zlib

import numpy as np

from topiclens.llm import toxicity as tox
from topiclens.llm.queries import QUERIES


def corpus(n, seed=1):
    draw = random.Random(seed)
    plain = ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "magna", "quis", "nulla", "sed", "ante", "porta"]
    docs, labels = [], []
    for d in range(n):
        words = [draw.choice(plain) for _ in range(draw.randint(3, 80))]
        bad = d % 7 == 0
        for _ in range(3 * bad):
            words.insert(draw.randrange(len(words)), draw.choice(["blorky", "VEJUTE", "zzgrim"]))
        docs.append((d, " ".join(words)))
        labels.append((d, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1200)
    got = tox.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 1200
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert sum(r.predicted != (r.doc_id % 7 == 0) for r in got if r.held_out) <= 2


def plain_scores(docs, labels, threshold=0.3):
    """Counts, ratios and the fit with dictionaries, gram by gram and text by text."""
    import math

    word = 1 << 64

    def buckets(text):
        text, found = f" {(text or '').lower()} ", set()
        for n in tox.ORDERS:
            for at in range(len(text) - n + 1):
                h = 0
                for c in text[at : at + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % word
                found.add(((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % word) >> (64 - tox.BUCKET_BITS))
        return found

    holds = {d: buckets(t) for d, t in docs}
    sample = sorted((d, toxic) for d, _, toxic in labels if zlib.crc32(str(d).encode()) % 4 != 2)
    rows = [sum(t == kind for _, t in sample) for kind in (0, 1)]
    counts = {}
    for d, toxic in sample:
        for b in holds[d]:
            counts.setdefault(b, [0, 0])[toxic] += 1
    ratio = {}
    for b, (clean, bad) in counts.items():
        r = math.log((bad + 1) / (rows[1] + 2)) - math.log((clean + 1) / (rows[0] + 2))
        if clean + bad >= tox.LEAST_DOCS and abs(r) >= tox.LEAST_RATIO:
            ratio[b] = r
    weight, slow = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-6)
    bias, slow_bias = math.log(rows[1] / rows[0]), 1e-6
    value = lambda b: ratio[b] * tox.SCALE
    own = {d: [b for b in held if b in ratio] for d, held in holds.items()}
    for _ in range(tox.STEPS):
        off = {d: (1 / (1 + math.exp(-(bias + sum(value(b) * weight[b] for b in own[d])))) - toxic) / len(sample) for d, toxic in sample}
        slope = {b: tox.PENALTY * w for b, w in weight.items()}
        for d, o in off.items():
            for b in own[d]:
                slope[b] += value(b) * o
        for b, s in slope.items():
            slow[b] += s * s
            weight[b] -= tox.RATE * s / math.sqrt(slow[b])
        slow_bias += sum(off.values()) ** 2
        bias -= tox.RATE * sum(off.values()) / math.sqrt(slow_bias)
    return {d: 1 / (1 + math.exp(-(bias + sum(value(b) * weight[b] for b in own[d])))) for d, _ in docs}


def test_scores_equal_a_plain_version(spark):
    docs, labels = corpus(120, seed=9)
    docs += [(500, ""), (501, "Größe 語学 vejute blorky"), (502, None)]
    want = plain_scores(docs, labels)
    got = tox.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(300)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = (sorted(tox.toxicity(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, turned))
    assert one == two


def test_query_covers_every_document(spark):
    rows = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 200


def test_buckets_in_blocks_equal_one_block(monkeypatch):
    draw = random.Random(2)
    texts = ["".join(draw.choice("abä 語\n") for _ in range(draw.randint(0, 300))) for _ in range(20)] + [None, "", "x"]
    whole = tox.present(texts)
    monkeypatch.setattr(tox, "BLOCK_CHARS", 17)
    parts = tox.present(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    alone = [tox.present([t])[1].tolist() for t in texts]
    assert [whole[1][whole[0] == n].tolist() for n in range(len(texts))] == alone


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, None), (None, 0, 1), (99, 0, 1), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = tox.toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {(r.score, r.predicted) for r in tox.toxicity(odd_docs, none).collect()} == {(0.0, 0)}
    assert tox.toxicity(no_docs, labels).collect() == []
    assert tox.drop_toxic(odd_docs, none).count() == odd_docs.count() and tox.drop_toxic(odd_docs, none).columns == odd_docs.columns
    assert tox.drop_toxic(no_docs, labels).count() == 0
