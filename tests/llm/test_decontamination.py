import random

import brute
import pandas as pd

from topiclens.llm.decontamination import drop_leaks, find_leaks, weighted_simhash
from topiclens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def found(df):
    return {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs, items = (pd.read_parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.leaks(list(zip(docs.doc_id.tolist(), docs.text)), list(zip(items.item_id.tolist(), items.text)))
    assert want and found(QUERIES["op8_decontamination"](spark, SF_DIR)) == want


def test_edited_passages(spark):
    """Passages with words changed, dropped and added: every window at 0.8 or more is found."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 14, 20, 37, 37, 59, 120])] + [(90, ""), (91, None)]
    items.append((92, " ".join(["same"] * 20)))
    docs = []
    for d in range(120):
        own = (draw.choice(items)[1] or "").split()
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(own) + 1)
            own[at : at + draw.randint(0, 1)] = [word()] * draw.randint(0, 1)
        front, back = ([word() for _ in range(draw.randint(0, 30))] for _ in range(2))
        docs.append((d, " ".join(front + own + back).title()))
    docs.append((500, " ".join(["same"] * 300)))
    got = found(find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = brute.leaks(docs, items)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_periodic_texts(spark):
    """Few shingles that each stand often: one more or less leaves most bits alone."""
    items = [(n, " ".join(("a", "b")[i % 2] for i in range(n))) for n in range(13, 40, 2)] + [(100 + n, " ".join("xyz"[i % 3] for i in range(n))) for n in (17, 30)]
    docs = [(n, " ".join(("b", "a")[i % 2] for i in range(n))) for n in range(13, 40, 2)] + [(100, "z y x " * 4 + "y z x " * 9), (101, "x y z " * 20)]
    want = brute.leaks(docs, items)
    got = found(find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert len(want) > 40 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_fingerprint_of_a_long_repetitive_text(spark):
    rows = spark.createDataFrame([(1, "same", 700_000), (1, "other", 3), (2, "same", 1)], "id long, shingle string, n long")
    got = {r.id: r for r in weighted_simhash(rows, ["id"], "shingle", "n").collect()}
    assert got[1]._weight == 700_003 and got[2]._weight == 1


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "seven eight nine ten."), (2, "long " * 40), (3, None)], "item_id long, text string")
    got = found(find_leaks(odd_docs, items))
    assert set(got) == {(1, 1), (2, 1), (9, 2), (10, 2)}
    assert sorted(r.doc_id or 0 for r in drop_leaks(odd_docs, items).collect()) == [0, 3, 4, 5, 6, 7, 8, 8]
    assert find_leaks(no_docs, items).collect() == [] and drop_leaks(no_docs, items).collect() == []
    assert find_leaks(odd_docs, items.limit(0)).collect() == [] and drop_leaks(odd_docs, items.limit(0)).count() == odd_docs.count()
