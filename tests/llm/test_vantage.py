import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiclens.llm.vantage import VantageTree, centroid_digest, cluster_vectors, largest_component


def brute(vectors, centroids):
    d = ((vectors[:, None] - centroids) ** 2).sum(2)
    return d.argmin(1), d.min(1), d


@pytest.mark.parametrize("k, leaf_size", [(1, 2), (2, 1), (8, 2), (300, 1), (300, 5)])
def test_search_equals_all_distances(k, leaf_size):
    draw = np.random.default_rng(k)
    for spread in (2, 1000):  # a coarse grid is full of ties and equal centroids
        centroids, vectors = draw.integers(-spread, spread, (k, 3)), draw.integers(-spread, spread, (500, 3))
        vectors[:k] = centroids[:500]
        number, squared, measured = VantageTree(centroids, leaf_size).nearest(vectors)
        want, least, _ = brute(vectors, centroids)
        assert number.tolist() == want.tolist() and squared.tolist() == least.tolist()
        assert measured <= 500 * k


def test_search_prunes_and_is_exact_at_the_limit():
    draw = np.random.default_rng(1)
    centroids = draw.integers(-10**6, 10**6, (400, 2))
    vectors = draw.integers(-10**6, 10**6, (2000, 2))
    tree = VantageTree(centroids)
    number, squared, measured = tree.nearest(vectors)
    assert measured < 2000 * 400 * 0.25 and squared.tolist() == brute(vectors, centroids)[1].tolist()
    far = largest_component(64)
    edge = np.array([[far] * 64, [-far] * 64, [far] * 63 + [far - 1]])
    number, squared, _ = VantageTree(edge, 1).nearest(edge)
    assert number.tolist() == [0, 1, 2] and not squared.any()
    _, squared, _ = VantageTree(edge[:1], 1).nearest(edge[1:2])
    assert int(squared[0]) == 64 * (2 * far) ** 2 < 2**63
    assert tree.nearest(vectors[:0])[0].tolist() == []


def lloyd(rows, k, rounds, seed=3):
    """Plain integers all the way."""
    rows = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in rows[:k]]

    def assigned():
        out = []
        for _, q in rows:
            away = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids]
            out.append((away.index(min(away)), min(away)))
        return out

    for _ in range(rounds):
        found = assigned()
        for c in range(len(centroids)):
            own = [q for (_, q), (at, _) in zip(rows, found) if at == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = assigned()
    inner = {c: sum(d for at, d in found if at == c) for c in range(len(centroids))}
    return sorted(((i, at, d, inner[at], sum(inner.values()), centroid_digest(centroids[at])) for (i, _), (at, d) in zip(rows, found)), key=str)


def got(frame):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, centroid_digest(r.centroid)) for r in frame.collect()), key=str)


def test_rounds_equal_plain_integers(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(0, 0.02, 4).tolist()) for i in range(60)] + [(7, [0.0] * 4), (7, [0.0] * 4), (None, [0.5] * 4), (None, [0.5] * 4)]
    rows += [(100 + i, [0.25] * 4) for i in range(30)]  # a group of copies; empty clusters come up
    odd = [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 5), (204, [1.0, None, 0.0, 0.0]), (205, [float("nan")] + [0.0] * 3), (206, [float("inf")] + [0.0] * 3), (207, [float("-inf")] * 4)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    table = table.withColumns({c: F.lit("clash") for c in ("_q", "cluster", "distance", "label", "inertia", "n")})
    plain = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in rows]
    for k, rounds in ((8, 10), (3, 0), (500, 2)):
        assert got(cluster_vectors(table, k=k, rounds=rounds, dim=4)) == lloyd(plain, k, rounds)
    assert cluster_vectors(table.limit(0), dim=4).collect() == [] == cluster_vectors(table, dim=9).collect()


def test_components_that_would_not_fit_are_an_error(spark):
    table = spark.createDataFrame([(1, [3e38] * 4)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="would not fit"):
        cluster_vectors(table, dim=4).collect()


def test_query_against_a_plain_version(spark):
    from topiclens.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    plain = [(r.vec_id, np.floor(1024 * np.array(r.embedding, float)).astype(int).tolist()) for r in rows]
    found = QUERIES["op13_vantage"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in found), key=str) == lloyd(plain, 8, 10)
