import random

import brute
import numpy as np
import pandas as pd
import pytest

from topiclens.llm.components import connected_components
from topiclens.llm.queries import QUERIES
from topiclens.llm.simhash import _roots, near_links, simhash_groups

SF_DIR = "/root/testdata/sf0.001"


def expected(rows, k=4, radius=4):
    prints = [brute.simhash(t, k) for _, t in rows]
    found = brute.components([d for d, _ in rows], prints, radius)
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, found)), key=str)


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op1_simhash"](spark, SF_DIR).collect()), key=str)
    assert got == expected(list(zip(docs.doc_id.tolist(), docs.text)))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in simhash_groups(odd_docs).collect()), key=str) == expected(rows)
    assert simhash_groups(no_docs).collect() == []


@pytest.mark.parametrize("tile", [4, 2048])
def test_crowded_meeting_places(spark, tile):
    """A ball of near fingerprints and many others: components equal brute force, links stay few."""
    draw = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = near_links(spark.createDataFrame([(p,) for p in prints], "print long"), 4, tile)
    found = {r.node: r.component for r in connected_components(links).collect()}
    unsigned = [p & (2**64 - 1) for p in prints]
    want = brute.components(prints, unsigned, 4)
    assert [found.get(p, p) for p in prints] == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(500, i) for i in range(100, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 200)}, 500: 100}


def test_roots_keep_every_link():
    """A path hooks several rows of one tree in one round; none may leave the tree of its earlier links."""
    path = np.array([(1, 6), (2, 6), (2, 7), (3, 7), (3, 8), (4, 8), (4, 9), (5, 9), (5, 10), (0, 10)])
    assert _roots(11, path[:, 0], path[:, 1]).tolist() == [0] * 11
    draw = np.random.default_rng(1)
    for _ in range(200):
        i, j = draw.integers(0, 40, (2, 36))
        want = brute_roots(40, i, j)
        assert _roots(40, i, j).tolist() == want


def brute_roots(n, i, j):
    root = list(range(n))
    for a, b in zip(i, j):
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root
