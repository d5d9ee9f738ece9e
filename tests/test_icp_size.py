"""Pairs of a million points go through ``icp`` in a task."""

import numpy as np

from topiclens.operators import geometry as G
from topiclens.operators import matching


def test_places_count_once_and_neighbours_are_asked_together(monkeypatch):
    draw = np.random.default_rng(5)
    x, y = draw.integers(0, 12, 4000).astype(float), draw.integers(0, 9, 4000).astype(float)
    ids = draw.permutation(4000)
    kept, kx, ky = matching.distinct_places(ids, x, y)
    assert len(kept) == len({*zip(x, y)}) == len({*zip(kx, ky)}) and all(i == ids[(x == a) & (y == b)].min() for i, a, b in zip(kept, kx, ky))
    assert [len(v) for v in matching.distinct_places(ids[:0], x[:0], y[:0])] == [0, 0, 0]
    qx, qy = draw.random(3000) * 14 - 1, draw.integers(-1, 11, 3000) / 2
    want = [min(zip(np.sqrt((a - x) ** 2 + (b - y) ** 2), ids))[1] for a, b in zip(qx, qy)]
    monkeypatch.setattr(matching, "LOOKED_AT", 64)
    spread = []
    search = matching.Places._search
    monkeypatch.setattr(matching.Places, "_search", lambda self, x, y: (spread.append(np.ptp(x)), search(self, x, y))[1])
    assert (matching.Places(kept, kx, ky).nearest(qx, qy)[0] == want).all()
    many = matching.Places(np.arange(4000), draw.random(4000), draw.random(4000))
    spread.clear()
    many.nearest(draw.random(4000), draw.random(4000))
    assert np.mean(spread) < 0.3  # queries of one run lie side by side, not all over the place


def test_large_pairs_agree_with_rounds_over_the_cluster(spark, monkeypatch):
    assert G.ICP_ROWS > 1_100_000
    monkeypatch.setattr(G, "TERM_ROWS", 100)  # moments are added up in parts
    draw = np.random.default_rng(6)
    p, q = [], []
    for pair in (1, 2, None):
        x, y = draw.integers(0, 40, 250).astype(float), draw.integers(0, 40, 250) / 2
        p += [(pair, i if i != 9 else None, float(a), float(b) if i != 7 else None) for i, (a, b) in enumerate(zip(x, y))]
        q += [(pair, i, float(a) + 0.3, float(b) + 0.2 if i != 5 else float("nan")) for i, (a, b) in enumerate(zip(x, y))]
    p, q = (spark.createDataFrame(rows, f"pair_id LONG, {name} LONG, x DOUBLE, y DOUBLE") for rows, name in ((p, "query_id"), (q, "target_id")))
    shown = lambda found: (sorted((r["pair_id"], round(r["cos"], 6), round(r["tx"], 5), r["n"]) for r in found[0].collect()), sorted((r["pair_id"], r["query_id"], r["target_id"]) for r in found[1].collect()))
    assert shown(G.icp(p, q)) == shown(G.icp(p, q, rows=10))
