import numpy as np
from pyspark.sql import functions as F

from topiclens.operators.labels import _runs, join_truth, paint_patches


def painted(patches, sizes, step):
    """Square after square in order of ordinal and label."""
    out = {(i, x, y): 0 for i, w, h in sizes for x in range(w) for y in range(h)}
    known = [p for p in patches if p[3] is not None and p[4] is not None]
    for i, px, py, label, _ in sorted(known, key=lambda p: (p[4], p[3])):
        for x in range(px - step // 2, px + step // 2 + 1):
            for y in range(py - step // 2, py + step // 2 + 1):
                if (i, x, y) in out:
                    out[i, x, y] = label
    return out


def tables(spark, patches, sizes):
    return (
        spark.createDataFrame(patches, "image_id long, x int, y int, label int, ordinal long"),
        spark.createDataFrame(sizes, "image_id long, width int, height int"),
    )


def test_spans_equal_painted_squares(spark):
    """Overlaps, squares over every edge and outside, ties, repeated places, missing values, images without patches."""
    draw = np.random.default_rng(6)
    sizes = [(1, 20, 14), (2, 3, 30), (3, 1, 1), (4, 9, 9), (5, 0, 4)]
    patches = [(int(draw.integers(1, 7)), int(draw.integers(-6, 26)), int(draw.integers(-6, 32)), int(draw.integers(1, 9)), int(draw.integers(0, 40))) for _ in range(400)]
    patches += [(1, 5, 5, n % 7 + 1, 50) for n in range(300)] + [(1, 8, 8, None, 99), (1, 8, 8, 3, None)]
    patches = [p for p in patches if p[0] != 4]
    p, s = tables(spark, patches, sizes)
    for step in (8, 3, 0):
        got = {(r.image_id, r.x, r.y): r.label for r in paint_patches(p, s, step).collect()}
        assert got == painted(patches, sizes, step)
    none = paint_patches(p.limit(0), s).collect()
    assert len(none) == 20 * 14 + 90 + 1 + 81 and {r.label for r in none} == {0}
    assert paint_patches(p, s.limit(0)).collect() == []


def test_lines_travel_and_not_pixels(spark):
    p, s = tables(spark, [(1, 4 + 8 * (n % 5), 4 + 8 * (n // 5), 1 + n % 3, n) for n in range(20)], [(1, 40, 32)])
    made = paint_patches(p, s)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan  # patches by place, spans by line
    assert made.filter(F.col("label") > 0).count() == 40 * 32 and plan.count("Generate") == 2


def test_truth_is_joined_by_lines(spark):
    """Runs of pixels are what is shuffled; pixels in any order, repeated, unmatched or without a place join as rows do."""
    draw = np.random.default_rng(3)
    rows = lambda n: [(int(draw.integers(1, 4)), int(draw.integers(0, 9)), int(draw.integers(0, 5)), int(draw.integers(0, 6))) for _ in range(n)]
    left, right = [*rows(300), (None, 1, 1, 1), (1, None, 1, 1), (1, 2, 2, None)], [*rows(200), (None, 1, 1, 1), (1, 1, None, 1), (1, 2, 2, None)]
    p = spark.createDataFrame(left, "image_id long, x int, y int, label int").repartition(3)
    t = spark.createDataFrame(right, "image_id long, x int, y int, truth int").repartition(2)
    got = join_truth(p, t)
    want = [(*a, b[3]) for a in left for b in right if None not in a[:3] and a[:3] == b[:3]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == ["image_id", "x", "y", "label", "truth"]
    line = spark.range(4000, numPartitions=1).selectExpr("id div 1000 as image_id", "cast(id % 40 as int) x", "cast(id % 1000 div 40 as int) y", "1 label")
    runs = _runs(line, "label", "_p")
    assert runs.count() == 4 * 25
    assert join_truth(line, line.withColumnRenamed("label", "truth")).count() == 4000
