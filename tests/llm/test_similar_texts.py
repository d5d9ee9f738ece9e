import random

import numpy as np
import pytest

from topiclens.llm import similar_texts
from topiclens.llm.simhash import majority, shingle_hashes
from topiclens.llm.similar_texts import drop_similar, similar_groups


def exact(rows, k=5, threshold=0.8):
    """Component number of each text over all pairs."""
    split = [(t or "").encode().lower().split() for t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)} for w in split]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root


def edited_texts():
    """Twenty texts of 200 words with copies of 1 to 6 changed words, similarity about 0.7 to 0.95."""
    draw, rows = random.Random(5), []
    for _ in range(20):
        words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        rows.append(" ".join(words))
        for edits in range(1, 7):
            copy = list(words)
            for at in draw.sample(range(200), edits):
                copy[at] = f"x{draw.randrange(10**6)}"
            rows.append(" ".join(copy))
    return rows


def test_edited_copies_are_found(spark, monkeypatch):
    rows = [*edited_texts(), None, "", "few words", "Few  Words"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for tile in (512, 3):
        monkeypatch.setattr(similar_texts, "TILE_NODES", tile)
        first = {r.component: None for r in similar_groups(docs).collect()}
        assert len(first) == len(set(exact(rows)))
        assert sorted(r.doc_id for r in drop_similar(docs).collect()) == sorted(set(exact(rows)))


def test_chained_bits_are_no_copy(spark):
    """Texts of one word each may have near fingerprints, but no shingle in common."""
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(200)], "doc_id long, text string")
    assert drop_similar(docs).count() == 200


def test_one_row_of_each_group_stays(spark):
    """Ids may be null or shared by different texts, and rows may repeat."""
    one, two, three = ("one text of its own here", "two texts of their own here", "three texts of their own here")
    rows = [(1, one), (None, one), (None, two), (2, three), (7, "seven"), (7, "a text that shares an id"), (3, "seven"), (2, three)]
    kept = drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, one), (None, two), (2, three), (3, "seven"), (7, "a text that shares an id")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_fingerprints_find_copies(spark, monkeypatch):
    """Without any band, copies meet by equal fingerprints and by the pivot tables' links; others do not link."""
    words = [f"w{n}" for n in range(2000)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(["less", *words]), " ".join(reversed(words)), "one", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    prints = [majority(shingle_hashes(t, 5)) for t in texts]
    assert all(0 < (prints[0] ^ p).bit_count() <= 4 for p in prints[1:3])
    monkeypatch.setattr(similar_texts, "band_keys", lambda shingles: np.random.default_rng(shingles[:4]).integers(0, 2**62, similar_texts.BANDS))
    groups = {}
    for r in similar_groups(docs).collect():
        groups.setdefault(r.component, []).append(r._id)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3], [4], [5]]


@pytest.mark.parametrize("sent", [250_000, 0])
def test_texts_stay_where_they_are(spark, monkeypatch, sent):
    monkeypatch.setattr(similar_texts, "SENT_ROWS", sent)
    same, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, same), (1, same), (None, same), (2, other), (2, other), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for some, want in ((docs, [(1, same), (2, other), (4, None)]), (docs.distinct(), [(1, same), (2, other), (4, None)])):
            found = drop_similar(some)
            assert sorted(found.collect()) == want
            assert ("SortMergeJoin" in found._jdf.queryExecution().toString()) == (sent == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
