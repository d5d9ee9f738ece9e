"""Faults found in use: each test is the smallest input that showed one."""

import numpy as np
import pandas as pd

from topiclens import spread
from topiclens.operators import geometry as G
from topiclens.operators import images as I
from topiclens.sinks.images import write_files
from topiclens.sources import files as R


def one_match(spark):
    return spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], "pair_id LONG, match_id LONG, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")


def test_no_hypothesis_gives_no_row(spark):
    assert G.ransac(one_match(spark), 10, 1.0, 0.1).collect() == []
    assert G.ransac_grow_epsilon(one_match(spark), 1.0, 3.0, 0.1, iterations=10).collect() == []
    assert G.ransac(one_match(spark).limit(0), 10, 1.0, 0.1).collect() == []


def test_files_keep_their_bytes(spark, tmp_path):
    rows = [("a", b"abc"), ("b", b""), ("c", bytes(range(256)) * 5), ("d", None)]
    assert write_files(spark.createDataFrame(rows, "name STRING, content BINARY"), str(tmp_path / "out"), "name") == 4
    back = {r["path"].rpartition("=")[2]: bytes(r["content"]) for r in R.read_whole_files(spark, str(tmp_path / "out"), "part-*").collect()}
    assert back == {k: v for k, v in rows if v}  # the reader lists no empty files
    assert {f.name: f.stat().st_size for f in (tmp_path / "out").iterdir()} == {f"part-name={k}": len(v or b"") for k, v in rows}


def test_equal_base_names_stay_apart(spark):
    manifest = spark.createDataFrame([(1, "file:/d/a/x.bmp"), (2, "file:/d/b/x.bmp")], R.MANIFEST)
    images = spark.createDataFrame([("file:///d/a/x.bmp", 4, 5), ("file:///d/b/x.bmp", 6, 7)], "path STRING, width INT, height INT")
    got = R.image_sizes(manifest, images).select("image_id", "width", "height").collect()
    assert sorted(map(tuple, got)) == [(1, 4, 5), (2, 6, 7)]


def test_an_image_gives_all_rows_or_none(spark):
    def kernel(image):
        yield (1.0,)
        if image[0, 0] < 0:
            raise ValueError("negative")
        yield (2.0,)

    images = spark.createDataFrame(
        [(1, 1, 1, [3.0]), (2, 1, 1, [-3.0]), (3, 2, 2, [1.0]), (4, 1, 1, None)], "image_id INT, width INT, height INT, data ARRAY<DOUBLE>"
    )
    rows = I.extract_features(images, kernel, "image_id INT, v DOUBLE").collect()
    assert sorted(map(tuple, rows)) == [(1, 1.0), (1, 2.0)]
    failed = {r["image_id"]: r["reason"] for r in I.failed_images(images, kernel).collect()}
    assert failed == {2: "ValueError: negative", 3: "1 pixels for 2 x 2", 4: "no pixels"}


def test_median_leaves_out_nulls_either_way(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, None), (2, None)], "k INT, v DOUBLE")
    for small in (1, 100):
        assert [tuple(r) for r in spread.group_median(df, ["k"], "v", small=small).collect()] == [(1, 2.0)]


def test_icp_tells_unsettled_pairs(spark):
    draw = np.random.default_rng(1)
    p = draw.uniform(0, 9, (12, 2))
    frame = lambda ident, xy: spark.createDataFrame(pd.DataFrame({"pair_id": 1, ident: range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
    clouds = frame("query_id", p), frame("target_id", p + [1.5, -1.0])
    assert [r["settled"] for r in G.icp(*clouds, "translation")[0].collect()] == [True]
    assert [r["settled"] for r in G.icp(*clouds, "translation", max_rounds=1)[0].collect()] == [False]


def test_sized_manifest_and_record_file(spark, tmp_path):
    from topiclens.sources.tables import read_record_file

    (tmp_path / "sized.tsv").write_text("1\ta/x.bmp\t4\t5\n2\tb/x.bmp\t6\t7\n")
    sized = R.read_sized_manifest(spark, str(tmp_path / "sized.tsv")).collect()
    assert [tuple(r) for r in sized] == [(1, "a/x.bmp", 4, 5), (2, "b/x.bmp", 6, 7)]
    spark.sparkContext.parallelize([(1, "one"), (2, "two")], 1).saveAsSequenceFile(str(tmp_path / "records"))
    back = read_record_file(spark, str(tmp_path / "records"), "k INT, v STRING").collect()
    assert sorted(map(tuple, back)) == [(1, "one"), (2, "two")]
