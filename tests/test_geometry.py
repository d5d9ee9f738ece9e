import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topiclens.operators import codebook, geometry, matching


def make_matches(spark, n=300, outliers=0.3, seed=4, noise=0.0):
    rng = np.random.default_rng(seed)
    frames = []
    for pair, angle in ((1, 0.3), (2, -1.1)):
        p = rng.random((n, 2)) * 100
        c, s = np.cos(angle), np.sin(angle)
        q = p @ np.array([[c, s], [-s, c]]) + [5.0, -3.0] + rng.normal(0, noise, (n, 2))
        q[: int(n * outliers)] = rng.random((int(n * outliers), 2)) * 100
        frames.append(pd.DataFrame({"pair_id": pair, "match_id": range(n), "x1": p[:, 0], "y1": p[:, 1], "x2": q[:, 0], "y2": q[:, 1]}))
    return spark.createDataFrame(pd.concat(frames))


@pytest.mark.parametrize("rows", [4096, 40])
def test_ransac_recovers_rotation(spark, rows):
    """Whole pairs in a block, and pairs split over several blocks."""
    best = geometry.ransac(make_matches(spark), 40, 0.1, 0.2, rows=rows).toPandas().set_index("pair_id")
    for pair, angle in ((1, 0.3), (2, -1.1)):
        assert np.allclose(best.loc[pair, ["cos", "sin", "tx", "ty"]], [np.cos(angle), np.sin(angle), 5.0, -3.0], atol=1e-6)
        assert best.loc[pair, "inliers"] >= 210


def test_hypotheses_are_scored_in_small_runs(spark):
    """A thousand models never meet all matches of a block in one array, and the best one is found."""
    from topiclens.operators.models import Rigid

    class Narrow(Rigid):
        def apply(self, p, x, y):
            if np.size(p["tx"]) * np.size(x) > 1 << 15 and isinstance(x, np.ndarray):
                raise ValueError("too many pairs at once")
            return super().apply(p, x, y)

    found = geometry.ransac(make_matches(spark, n=100), 1000, 0.1, 0.2, kind=Narrow()).collect()
    assert len(found) == 2 and all(r.inliers >= 70 for r in found)


def test_trim_keeps_inliers(spark):
    models, kept = geometry.trim_outliers(make_matches(spark, outliers=0.05), 4.0)
    assert models.count() == 2 and kept.groupBy("pair_id").count().toPandas()["count"].between(280, 290).all()


def plain_smoothness(rows, sigma, max_eps, max_trust):
    """The filter for one pair, candidate by candidate and list by list."""

    def fit(w, m):
        total = w.sum()
        a, b = (w[:, None] * m[:, :2]).sum(0) / total, (w[:, None] * m[:, 2:]).sum(0) / total
        u, v = m[:, :2] - a, m[:, 2:] - b
        angle = np.arctan2((w * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])).sum(), (w * (u * v).sum(1)).sum())
        c, s = np.cos(angle), np.sin(angle)
        return c, s, b[0] - c * a[0] + s * a[1], b[1] - s * a[0] - c * a[1]

    def errors(model, m):
        c, s, tx, ty = model
        return np.hypot(c * m[:, 0] - s * m[:, 1] + tx - m[:, 2], s * m[:, 0] + c * m[:, 1] + ty - m[:, 3])

    rows, passes = np.asarray(rows, float), 0
    while True:
        keep, passes = [], passes + 1
        m = rows[:, 1:]
        for i in range(len(m)):
            w = np.exp(-((m[:, :2] - m[i, :2]) ** 2).sum(1) / (2 * sigma * sigma))
            w[i] = 0
            held = np.arange(len(m))
            while True:
                model = fit(w[held], m[held])
                own = errors(model, m[held])
                left = held[own <= np.median(own) * max_trust]
                if len(left) == len(held):
                    break
                held = left
            own = errors(model, m)
            keep.append(own[i] <= max_eps and own[i] <= max_trust * (w * own).sum() / w.sum())
        if all(keep):
            return set(rows[:, 0].astype(int)), passes
        rows = rows[keep]


@pytest.mark.parametrize("rows", [4096, 25])
def test_smoothness_equals_a_plain_version(spark, rows):
    """Whole pairs in a task, and pairs over blocks, where medians come from histograms."""
    matches = make_matches(spark, n=300, outliers=0.1, noise=0.3)
    if rows == 25:
        matches = matches.filter("pair_id = 1")
    got = geometry.local_smoothness_filter(matches, 20.0, 15.0, 2.5, rows=rows).toPandas()
    frame, most = matches.toPandas(), 0
    for pair, own in frame.groupby("pair_id"):
        want, passes = plain_smoothness(own[["match_id", "x1", "y1", "x2", "y2"]].to_numpy(), 20.0, 15.0, 2.5)
        assert set(got[got.pair_id == pair].match_id) == want and 200 < len(want) < 290
        most = max(most, passes)
    assert most > 1


def test_smoothness_of_large_pairs_in_shares(spark, monkeypatch):
    """A pair of more than a block is fitted in tasks that hold it whole, each for some of its matches."""
    monkeypatch.setattr(geometry, "_medians", None)
    monkeypatch.setattr(geometry, "PART_CELLS", 20_000)
    monkeypatch.setattr(geometry, "TILE_ROWS", 100)
    matches = make_matches(spark, n=150, outliers=0.1, noise=0.3).cache()
    frame = matches.toPandas()
    for least in (1, 1024):
        monkeypatch.setattr(geometry, "ONE_BY_ONE", least)
        got = geometry.local_smoothness_filter(matches, 20.0, 15.0, 2.5).toPandas()
        for pair, own in frame.groupby("pair_id"):
            want, _ = plain_smoothness(own[["match_id", "x1", "y1", "x2", "y2"]].to_numpy(), 20.0, 15.0, 2.5)
            assert set(got[got.pair_id == pair].match_id) == want


def test_medians_from_histograms(spark):
    """Even and odd numbers, ties, zeros and values far apart, over blocks of seven."""
    rng = np.random.default_rng(2)
    model = geometry.model_of("translation")
    for x2 in (rng.normal(0, 1, 40), np.repeat([0.0, 1e-300, 5.0], 7), 10.0 ** rng.integers(-200, 200, 31), np.array([3.0, 1.0])):
        rows = [(1, i, 0.0, 0.0, float(v), 0.0) for i, v in enumerate(x2)]
        matches = spark.createDataFrame(rows, "pair_id long, match_id long, x1 double, y1 double, x2 double, y2 double")
        around = geometry._Surroundings(matches, geometry.pack_blocks(matches, ["pair_id"], ["match_id"], 7), 7, len(x2))
        own = matches.selectExpr("*", "cast(array() as array<double>) past", f"{len(x2)}L was", "1.0D cos", "0.0D sin", "match_id * 0.5D tx", "0.0D ty")
        got = {r.match_id: r["median"] for r in geometry._medians(around, own, model).collect()}
        for i in range(len(x2)):
            error = np.sqrt((i * 0.5 - x2) ** 2)
            assert got[i] == np.median(error), (x2, i)


def test_a_match_without_surroundings_empties_its_pair(spark):
    rows = [(p, i, float(i % 4), float(i // 4), float(i % 4) + 1, float(i // 4) + 0.01 * (i % 3)) for p in (1, 2) for i in range(12)] + [(2, 99, 1e6, 1e6, 0.0, 0.0)]
    matches = spark.createDataFrame(rows, "pair_id long, match_id long, x1 double, y1 double, x2 double, y2 double")
    for size in (4096, 5):
        kept = geometry.local_smoothness_filter(matches, 2.0, 1.0, 5.0, rows=size)
        assert [r.pair_id for r in kept.select("pair_id").distinct().collect()] == [1]
    assert geometry.local_smoothness_filter(matches.limit(0), 2.0, 1.0, 5.0).collect() == []


def similarity_model():
    """A model of the user's own: rotation, one scale and shift."""
    from topiclens.operators.models import Model

    class Similarity(Model):
        params = ("a", "b", "tx", "ty")
        min_matches = 2

        def moments(self, x1, y1, x2, y2):
            return {"x": x1, "y": y1, "u": x2, "v": y2, "dot": x1 * x2 + y1 * y2, "cross": x1 * y2 - y1 * x2, "own": x1 * x1 + y1 * y1}

        def _spread(self, m):
            return m["own"] - (m["x"] * m["x"] + m["y"] * m["y"]) / m["n"]

        def defined(self, m, f):
            return (m["n"] > 0) & (self._spread(m) > 1e-9)

        def fit(self, m, f):
            a = (m["dot"] - (m["x"] * m["u"] + m["y"] * m["v"]) / m["n"]) / self._spread(m)
            b = (m["cross"] - (m["x"] * m["v"] - m["y"] * m["u"]) / m["n"]) / self._spread(m)
            return {"a": a, "b": b, "tx": (m["u"] - a * m["x"] + b * m["y"]) / m["n"], "ty": (m["v"] - b * m["x"] - a * m["y"]) / m["n"]}

        def apply(self, p, x, y):
            return p["a"] * x - p["b"] * y + p["tx"], p["b"] * x + p["a"] * y + p["ty"]

        def inverse(self, p, x, y):
            size, dx, dy = p["a"] * p["a"] + p["b"] * p["b"], x - p["tx"], y - p["ty"]
            return (p["a"] * dx + p["b"] * dy) / size, (p["a"] * dy - p["b"] * dx) / size

    return Similarity()


def scaled_matches(spark, scale=1.7):
    rigid = make_matches(spark, outliers=0.0, noise=0.05)
    return rigid.withColumns({"x2": F.expr(f"case when match_id < 60 then y1 else x2 * {scale} end"), "y2": F.expr(f"case when match_id < 60 then x1 else y2 * {scale} end")})


def test_own_model_in_every_registration_operator(spark):
    kind, matches = similarity_model(), scaled_matches(spark).cache()
    size = lambda row: np.hypot(row.a, row.b)
    best = geometry.ransac(matches, 60, 1.0, 0.2, kind=kind)
    found = best.collect()
    assert len(found) == 2 and all(abs(size(r) - 1.7) < 0.01 and r.inliers == 240 for r in found)
    assert geometry.threshold_inliers(matches, best, 1.0, kind).count() == 480
    grown = geometry.ransac_grow_epsilon(matches, 0.5, 1.0, 0.2, kind=kind, iterations=40).collect()
    assert all(abs(size(r) - 1.7) < 0.01 for r in grown)
    models, kept = geometry.trim_outliers(matches.filter("match_id >= 50"), 4.0, kind)
    assert all(abs(size(r) - 1.7) < 0.05 for r in models.collect()) and 440 < kept.count() < 500
    models, _ = geometry.ransac_trim(matches, 60, 1.0, 0.2, kind=kind)
    assert all(abs(size(r) - 1.7) < 0.01 for r in models.collect())
    smooth = geometry.local_smoothness_filter(matches.filter("match_id >= 45"), 25.0, 20.0, 3.0, kind)
    assert smooth.filter("match_id >= 60").count() > 400 and smooth.filter("match_id < 60").count() < 10
    points = geometry.source_points(matches)
    there = geometry.apply_transform(points, best, kind=kind)
    back = geometry.apply_inverse(there, best, kind=kind).withColumnsRenamed({"x": "bx", "y": "by"})
    joined = back.join(points, ["pair_id", "match_id"])
    assert joined.filter("abs(x - bx) + abs(y - by) > 1e-9").count() == 0 and joined.count() == 600


def test_own_model_aligns_clouds(spark):
    rng = np.random.default_rng(8)
    p = rng.random((60, 2)) * 100
    q = p * 1.01 + [0.3, -0.2]
    frame = lambda key, pts: spark.createDataFrame(pd.DataFrame({"pair_id": 1, key: range(60), "x": pts[:, 0], "y": pts[:, 1]}))
    models, found = geometry.icp(frame("query_id", p), frame("target_id", q), similarity_model())
    row = models.first()
    assert np.allclose([row.a, row.b, row.tx, row.ty], [1.01, 0.0, 0.3, -0.2], atol=1e-6)


def test_sets_without_a_model_end_quietly(spark):
    rows = [(1, i, 2.0, 2.0, float(i), 1.0) for i in range(8)] + [(2, 0, 0.0, 0.0, 1.0, 1.0)]
    matches = spark.createDataFrame(rows, "pair_id long, match_id long, x1 double, y1 double, x2 double, y2 double")
    kind = similarity_model()
    assert geometry.ransac(matches, 20, 0.5, 0.1, kind=kind).collect() == []
    models, kept = geometry.trim_outliers(matches, 4.0, kind)
    assert models.collect() == [] and kept.collect() == []


def test_icp_aligns_shifted_points(spark):
    rng = np.random.default_rng(8)
    p = rng.random((60, 2)) * 100
    frame = lambda key, pts: spark.createDataFrame(pd.DataFrame({"pair_id": 1, key: range(60), "x": pts[:, 0], "y": pts[:, 1]}))
    models, found = geometry.icp(frame("query_id", p), frame("target_id", p + [0.8, -0.5]), "translation")
    row = models.first()
    assert np.allclose([row["tx"], row["ty"]], [0.8, -0.5], atol=1e-6)
    assert found.filter("query_id = target_id").count() == 60


def test_icp_in_tasks_equals_rounds_over_the_cluster(spark):
    """A pair whose rounds fit a task takes no more jobs for more rounds, and gives the same rows."""
    rng = np.random.default_rng(21)
    a = {1: rng.random((80, 2)) * 50, 2: rng.random((30, 2)) * 9}
    turned = lambda v, t: v @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + [0.7, -0.4]
    left, right = clouds(spark, a, {1: rng.permutation(turned(a[1], 0.05)), 2: turned(a[2], 0.3), 3: [(0, 0)]})
    left = left.union(left.filter("query_id = 3"))  # rows that come twice
    rows = lambda df, *by: [tuple(np.round([float(v) for v in r], 8)) for r in df.orderBy(*by).collect()]
    for kind in ("rigid", similarity_model()):
        one, other = geometry.icp(left, right, kind, max_rounds=3), geometry.icp(left, right, kind, max_rounds=3, rows=1)
        assert rows(one[0].select(sorted(one[0].columns)), "pair_id") == rows(other[0].select(sorted(one[0].columns)), "pair_id")
        assert rows(one[1], "pair_id", "query_id") == rows(other[1].select(one[1].columns), "pair_id", "query_id")


def test_nearest_places_beside_the_targets():
    """Queries far from all targets look at few leaves."""
    rng = np.random.default_rng(5)
    pts = rng.random((40_000, 2)) * [1, 5]
    places, looked = matching.Places(np.arange(40_000), *pts.T), []
    look = places._look
    places._look = lambda x, y, leaf: (looked.append(len(x)), look(x, y, leaf))[1]
    queries = rng.random((200, 2)) * [3, 9] - [1, 2]
    ids, x2, y2, d = places.nearest(*queries.T)
    far = np.sqrt(((queries[:, None] - pts) ** 2).sum(2))
    assert ids.tolist() == far.argmin(1).tolist() and np.array_equal(d, far.min(1))
    assert sum(looked) < 200 * 40


def clouds(spark, a, b):
    left = spark.createDataFrame([(p, i, float(x), float(y)) for p, pts in a.items() for i, (x, y) in enumerate(pts)], "pair_id long, query_id long, x double, y double")
    right = spark.createDataFrame([(p, len(pts) - i, float(x), float(y)) for p, pts in b.items() for i, (x, y) in enumerate(pts)], "pair_id long, target_id long, x double, y double")
    return left, right


@pytest.mark.parametrize("points", [4, 64])
def test_nearest_point_by_cells_equals_all_distances(spark, points):
    rng = np.random.default_rng(12)
    a, b = {}, {}
    a[1], b[1] = rng.random((300, 2)), rng.random((500, 2))
    crowd = np.concatenate([rng.random((200, 2)) * 1e6, 5.0 + rng.random((150, 2)) * 1e-6, np.full((150, 2), 7.5)])  # a third in a speck, a third at one place
    a[2], b[2] = rng.permutation(crowd)[:300], crowd
    a[3], b[3] = rng.integers(0, 6, (200, 2)), rng.integers(0, 6, (300, 2))  # ties everywhere
    a[4], b[4] = rng.random((20, 2)) * [1, 0], rng.random((90, 2)) * [1, 0]  # on a line
    a[5], b[5] = rng.random((5, 2)), rng.random((1, 2))
    a[6], b[7] = rng.random((3, 2)), rng.random((3, 2))  # nothing to meet
    left, right = clouds(spark, a, b)
    got = {(r.pair_id, r.query_id): (r.target_id, r.d, r.x2, r.y2) for r in matching._nearest_by_cells(left, right, points).collect()}
    assert {k[0] for k in got} == {1, 2, 3, 4, 5}
    for pair in range(1, 6):
        d = np.sqrt(((np.asarray(a[pair], float)[:, None] - np.asarray(b[pair], float)) ** 2).sum(2))
        for i, row in enumerate(d):
            last = len(row) - 1 - row[::-1].argmin()  # ids fall, so the lowest is last
            assert got[pair, i] == (len(row) - last, row[last], *map(float, b[pair][last]))
    small = matching.nearest_point(left, right)
    large = matching.nearest_point(left, right, rows=10)
    assert sorted(small.select("pair_id", "query_id", "target_id").collect()) == sorted(large.select("pair_id", "query_id", "target_id").collect())


def test_index_looks_at_few_cells(spark):
    """Cells per query do not grow with the points, also where a third lies in a speck."""
    rng = np.random.default_rng(3)
    for n in (1000, 8000):
        even = rng.random((n, 2))
        uneven = np.where(np.arange(n)[:, None] % 3 == 0, 0.3 + even * 1e-5, even)
        for pts in (even, uneven):
            left, right = clouds(spark, {1: rng.permutation(pts)[:500] + 1e-7}, {1: pts})
            cells = matching._cells(right, 16)
            assert cells.selectExpr("max(size(points))").first()[0] <= 16
            assert matching._near_cells(left, cells).count() < 500 * 8


def test_points_without_coordinates_take_no_part(spark):
    left = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, None, 0.0), (1, 3, float("nan"), 0.0)], "pair_id long, query_id long, x double, y double")
    right = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 3.0, 4.0), (1, 3, 0.0, float("nan"))], "pair_id long, target_id long, x double, y double")
    for rows in (4096, 1):
        assert [(r.query_id, r.target_id, r.d) for r in matching.nearest_point(left, right, rows=rows).collect()] == [(1, 2, 5.0)]
        assert matching.nearest_point(left, right.limit(0), rows=rows).collect() == []


@pytest.mark.parametrize("rows", [4096, 13])
def test_nearest_features_brute_force(spark, rows):
    rng = np.random.default_rng(6)
    a, b = rng.random((50, 8)), rng.random((70, 8))
    left = spark.createDataFrame([(1, i, 1.0, v.tolist()) for i, v in enumerate(a)], "pair_id LONG, query_id LONG, scale DOUBLE, desc ARRAY<DOUBLE>")
    right = spark.createDataFrame([(1, i, 1.0, v.tolist()) for i, v in enumerate(b)], "pair_id LONG, target_id LONG, scale DOUBLE, desc ARRAY<DOUBLE>")
    got = matching.nearest_features(left, right, rows=rows).toPandas().sort_values("query_id")
    d = np.sqrt(((a[:, None] - b) ** 2).sum(2))
    assert got["best_id"].tolist() == d.argmin(1).tolist()
    assert np.allclose(got[["d1", "d2"]], np.sort(d, 1)[:, :2])


def codebook_tables(spark, n, k, size=4, seed=7):
    rng = np.random.default_rng(seed)
    pts, centers = rng.random((n, size)), rng.random((k, size))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)], "vec_id LONG, desc ARRAY<DOUBLE>")
    c = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(centers)], "code INT, center ARRAY<DOUBLE>")
    return pts, centers, p, c


def test_large_codebooks_are_read_by_the_tasks(spark):
    """Kept whole, and in several files read again for each batch; the plan moves nothing."""
    pts, centers, p, c = codebook_tables(spark, 80, 9)
    d = ((pts[:, None] - centers) ** 2).sum(2)
    for table, cells in ((c, 10**6), (c.repartition(4), 8), (c.union(c.selectExpr("code + 9", "center")), 8)):
        found = codebook.assign_clusters(p, table, ["vec_id"], cells=cells)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
        rows = found.orderBy("vec_id").collect()
        assert [r["code"] for r in rows] == (d.argmin(1) + 1).tolist()  # of equal centres the lower code
        assert np.allclose([r["dist"] for r in rows], np.sqrt(d.min(1)))


def test_bounds_spare_distances_and_change_no_code(spark):
    pts, centers, p, c = codebook_tables(spark, 600, 12, 2)
    c = c.union(spark.createDataFrame([(13, [50.0, 50.0])], c.schema))  # never has a point
    measured = spark.sparkContext.accumulator(0)
    made = codebook.lloyd_codebook(p, c, ["vec_id"], max_iter=12, tol=0.0, measured=measured).orderBy("code").collect()
    plain = np.vstack([centers, [50.0, 50.0]])
    for _ in range(12):
        at = ((pts[:, None] - plain) ** 2).sum(2).argmin(1)
        plain = np.array([pts[at == j].mean(0) if (at == j).any() else plain[j] for j in range(13)])
    assert np.allclose([r["center"] for r in made], plain)
    assert 600 < measured.value < 600 * 12 * 0.7
    assert codebook.lloyd_codebook(p.limit(0), c, ["vec_id"], max_iter=3).count() == 13


def test_clusters_and_maps_above_the_list_size_come_in_parts(spark):
    rows = [(1, i, j, 1 + (i > 25)) for i in range(30) for j in range(4)]
    df = spark.createDataFrame(rows, "image_id INT, x INT, y INT, code INT")
    maps = codebook.collect_code_map(df, rows_per_map=20)
    assert maps.count() > 3 and codebook.explode_codes(maps).count() == 120
    members = codebook.cluster_members(df, codebook.member_name(), rows_per_list=20).toPandas()
    assert members["members"].str.len().sum() == 120 and set(members["n"]) == {104, 16}
