import numpy as np
import pytest

from topiclens.functions.kernels import blur, filter_lines, gaussian_1d, gradients, mirror
from topiclens.operators import images as I
from topiclens.sinks.images import bitmap_bytes, encode_bitmaps, write_files
from topiclens.sources import files as R


def slow_descriptor(mag, ang, x, y, sigma, theta, n=4, bins=8):
    hist = np.zeros((n, n, bins))
    h, w = mag.shape
    for yi in range(4 * n):
        for xi in range(4 * n):
            ys, xs = (yi - 2 * n + 0.5) * sigma, (xi - 2 * n + 0.5) * sigma
            r = int(np.floor(np.cos(theta) * ys + np.sin(theta) * xs + y + 0.5))
            c = int(np.floor(np.cos(theta) * xs - np.sin(theta) * ys + x + 0.5))
            r, c = int(mirror(np.array(r), h)), int(mirror(np.array(c), w))
            weight = mag[r, c] * np.exp(-((yi - 2 * n + 0.5) ** 2 + (xi - 2 * n + 0.5) ** 2) / (8 * n * n))
            place = (ang[r, c] - theta + np.pi) / (2 * np.pi / bins)
            low = int(place)
            hist[yi // 4, xi // 4, low % bins] += weight * (1 - (place - low))
            hist[yi // 4, xi // 4, (low + 1) % bins] += weight * (place - low)
    flat = hist[::-1, ::-1, ::-1].ravel()
    return np.minimum(1, flat / np.sqrt((flat**2).sum()))


@pytest.fixture(scope="module")
def picture():
    rng = np.random.default_rng(5)
    return blur(rng.random((70, 90)), 1.5)


def test_descriptors_match_brute_force(picture):
    mag, ang = gradients(picture)
    got = I.descriptors(mag, ang, [4, 30, 88], [4, 60, 1], 1.6, [0.0, 0.4, -1.2])
    for d, x, y, t in zip(got, (4, 30, 88), (4, 60, 1), (0.0, 0.4, -1.2)):
        assert np.allclose(d, slow_descriptor(mag, ang, x, y, 1.6, t))


def test_flat_region_gives_uniform_descriptor():
    zeros = np.zeros((20, 20))
    assert np.allclose(I.descriptors(zeros, zeros, 10, 10, 1.6), 1 / np.sqrt(128))


def test_filter_edges():
    line, kernel = np.arange(6.0)[None, :], gaussian_1d(1.0)
    for edge in ("mirror", "inner", "renorm"):
        assert np.allclose(filter_lines(np.ones((1, 6)), kernel, edge), 1.0)
    padded = np.pad(line[0], 3, mode="symmetric")
    assert np.allclose(filter_lines(line, kernel, "mirror")[0], np.convolve(padded, kernel, "valid"))


def test_extrema_and_location():
    y, x = np.mgrid[0:30, 0:30]
    stack = np.stack([(1 - 0.2 * (i - 2.1) ** 2) * np.exp(-((x - 14.3) ** 2 + (y - 12.2) ** 2) / 18.0) for i in range(5)])
    found = [I.locate(stack, *map(int, e)) for e in I.extrema(stack)]
    best = [f for f in found if f is not None]
    assert len(best) == 1 and np.allclose(best[0], (14.3, 12.2, 2.1), atol=0.15)


def test_dense_grid_and_keypoints(spark, picture):
    df = spark.createDataFrame([(1, 90, 70, picture.ravel().tolist()), (2, 3, 3, [0.0])], "image_id INT, width INT, height INT, data ARRAY<DOUBLE>")
    dense = I.dense_features(df).toPandas()
    assert len(dense) == 11 * 9 and set(dense["image_id"]) == {1}  # 4, 12 .. 84 by 4, 12 .. 68
    assert [r["image_id"] for r in I.failed_images(df).collect()] == [2]
    points = I.keypoint_features(df, min_side=32).toPandas()
    assert ((points["x"] >= 0) & (points["x"] < 90) & (points["y"] >= 0) & (points["y"] < 70)).all()


def test_bitmaps_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 24, (5, 7)), rng.integers(0, 1 << 24, (4, 4))
    images = spark.createDataFrame(
        [(1, 7, 5, a.ravel().tolist()), (2, 4, 4, b.ravel().tolist())], "image_id INT, width INT, height INT, data ARRAY<INT>"
    )
    folder = str(tmp_path / "bmp")
    write_files(encode_bitmaps(images), folder)
    manifest = R.build_manifest(spark, folder, "part-*")
    from pyspark.sql import functions as F

    name = lambda p: F.regexp_extract(p, "image_id=(\\d+)", 1)
    rgb = {r["image_id"]: r for r in I.decoded_rgb(R.decode_images(spark, folder), manifest, name).collect()}
    assert rgb[1]["data"] == a.ravel().tolist() and (rgb[2]["width"], rgb[2]["height"]) == (4, 4)
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "good.bmp").write_bytes(bitmap_bytes(a))
    (tmp_path / "mixed" / "bad.bmp").write_bytes(b"not an image")
    bad = R.bad_images(spark, str(tmp_path / "mixed")).collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("bad.bmp")
    assert R.decode_images(spark, str(tmp_path / "mixed")).count() == 1


def test_features_leave_a_task_in_portions(spark, monkeypatch):
    """A task holds the rows of a few images, not of all it reads."""
    frame = spark.createDataFrame([(i, 40, 40, [float((i * j) % 7) for j in range(1600)]) for i in range(12)], "image_id INT, width INT, height INT, data ARRAY<DOUBLE>")
    held = {}

    class Caught:
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            held["run"] = run

    monkeypatch.setattr(I, "OUTPUT_BYTES", 50_000)
    levels = lambda image: [(k, image.ravel()) for k in range(3)]
    I.extract_features(Caught(), levels, "image_id INT, level INT, data ARRAY<DOUBLE>")
    parts = list(held["run"](iter([frame.toPandas()])))
    assert len(parts) == 6 and max(map(len, parts)) == 6
    assert sorted(zip(*(c for c in (sum((p[n].tolist() for p in parts), []) for n in ("image_id", "level"))))) == [(i, k) for i in range(12) for k in range(3)]
