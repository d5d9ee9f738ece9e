import numpy as np
import pytest

from topiclens.functions.kernels import filter_lines, gaussian_1d
from topiclens.operators import pixels as P
from topiclens.operators.topics import log_sum_exp


def images(spark, shapes=((23, 9), (1, 5), (7, 1), (16, 16), (3, 40))):
    rng = np.random.default_rng(4)
    made = {i: rng.normal(0, 1, shape) for i, shape in enumerate(shapes)}
    rows = [(i, x, y, float(a[y, x])) for i, a in made.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return made, spark.createDataFrame(rows, "image_id long, x int, y int, v double").repartition(3)


def arrays(df, column="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.y, r.x] = r[column]
    shape = {i: (max(y for y, _ in c) + 1, max(x for _, x in c) + 1) for i, c in out.items()}
    assert all(len(c) == shape[i][0] * shape[i][1] for i, c in out.items())
    return {i: np.array([[c[y, x] for x in range(shape[i][1])] for y in range(shape[i][0])]) for i, c in out.items()}


def whole(images_, kernel):
    return {i: kernel(a) for i, a in images_.items()}


def blurred(edge, k):
    return lambda a: filter_lines(filter_lines(a, k, edge).T, k, edge).T


CASES = {
    "mirror": (lambda p, n: P.separable_convolve(p, gaussian_1d(1.1), lines=n), blurred("mirror", gaussian_1d(1.1))),
    "inner": (lambda p, n: P.gaussian_blur_mirror(p, 0.8, lines=n), blurred("inner", gaussian_1d(0.8))),
    "renorm": (lambda p, n: P.gaussian_blur(p, 1.3, lines=n), blurred("renorm", gaussian_1d(1.3))),
    "down": (lambda p, n: P.convolve_axis(p, [0.2, 0.5, 0.3], "y", "zero", lines=n), lambda a: filter_lines(a.T, np.array([0.2, 0.5, 0.3]), "zero").T),
}


@pytest.mark.parametrize("name", list(CASES))
@pytest.mark.parametrize("lines", [1, 64])
def test_strips_equal_whole_images(spark, name, lines):
    made, table = images(spark)
    on_strips, plain = CASES[name]
    got, want = arrays(on_strips(table, lines)), whole(made, plain)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


@pytest.mark.parametrize("operator", [
    lambda p, n: P.laplace(p, 2, lines=n), lambda p, n: P.gaussian_blur_ramp_x(p, 0.5, 2.0, lines=n), lambda p, n: P.jitter_resample(p, "y", 3, lines=n),
    lambda p, n: P.jitter_resample(p, "x", 3, lines=n), lambda p, n: P.upsample2(p, lines=n), lambda p, n: P.pixel_gradients(p, lines=n).withColumnRenamed("direction", "v"),
])
def test_strips_of_any_height_agree(spark, operator):
    _, table = images(spark)
    first, other = arrays(operator(table, 1)), arrays(operator(table, 64))
    assert all(np.allclose(first[i], other[i]) for i in first)


def test_upsample_shapes(spark):
    made, table = images(spark)
    got = arrays(P.upsample2(table, lines=2))
    for i, a in made.items():
        assert got[i].shape == (2 * a.shape[0] - 1, 2 * a.shape[1] - 1)
        assert np.allclose(got[i][::2, ::2], a) and np.allclose(got[i][1::2, 1::2], (a[:-1, :-1] + a[1:, 1:]) / 2)


def test_one_exchange_before_the_output(spark):
    _, table = images(spark)
    for made in (P.pixel_gradients(table), P.laplace(table), P.gaussian_blur(table, 1.0), P.gaussian_blur_ramp_x(table, 0.5, 1.0), P.jitter_resample(table, "y"), P.upsample2(table)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(image_id") == 1 == plan.count("Exchange hashpartitioning"), plan


def test_log_sums_in_one_pass(spark):
    inf, nan = float("inf"), float("nan")
    groups = {
        "wide": [2000.0, 1999.0, -2000.0], "low": [-2000.0, -2000.5, -3000.0], "edge": [511.9, 512.0, 1024.0 - 1e-9], "none": [-inf, -inf], "some": [-inf, 1.5],
        "top": [inf, 3.0], "odd": [nan, 1.0], "null": [None, None], "half": [None, 4.0], "one": [-1e6],
    }
    table = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    sums = log_sum_exp(table, ["k"], "v", "total")
    got = {r.k: r.total for r in sums.collect()}
    for k, vs in groups.items():
        known = np.array([v for v in vs if v is not None])
        want = np.logaddexp.reduce(known) if len(known) else None
        assert got[k] is None if want is None else np.isclose(got[k], want, rtol=1e-14, equal_nan=True), k
    plan = log_sum_exp(table, ["k"], "v", "total")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan
