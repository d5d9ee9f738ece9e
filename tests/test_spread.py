import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topiclens import spread


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(3000), "k": np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 9, 3000)), "v": rng.integers(0, 50, 3000) / 4})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_number_rows_is_dense_and_ordered(skewed):
    pdf, df = skewed
    got = spread.number_rows(df, [F.desc("v"), F.asc("id")], "no").toPandas().sort_values("no")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert got["no"].tolist() == list(range(1, 3001))
    assert got["id"].tolist() == want["id"].tolist()


def test_running_total(skewed):
    pdf, df = skewed
    got = spread.running_total(df, [F.col("v"), F.col("id")], F.col("k"), "before").toPandas().sort_values(["v", "id"])
    want = pdf.sort_values(["v", "id"])["k"].cumsum().shift(fill_value=0)
    assert got["before"].tolist() == want.tolist()


@pytest.mark.parametrize("small", [10**6, 10])
def test_group_median_both_ways(skewed, small):
    pdf, df = skewed
    got = spread.group_median(df, ["k"], "v", small=small).toPandas().set_index("k")["median"].sort_index()
    assert np.allclose(got, pdf.groupby("k")["v"].median())


def test_lookup_join_salted_equals_broadcast(spark, skewed):
    _, df = skewed
    names = spark.createDataFrame([(k, f"n{k}") for k in range(6)], "k LONG, name STRING")
    salted = spread.lookup_join(df, names, ["k"], "left").orderBy("id").toPandas()
    known = spread.lookup_join(df, names, ["k"], "left", lookup_rows=6).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(salted[known.columns], known)


def test_top_per_group(skewed):
    pdf, df = skewed
    got = spread.top_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 4).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(4)
    assert sorted(got["id"]) == sorted(want["id"])


@pytest.mark.parametrize("rows", [10**6, 50])
def test_tile_join_pairs_everything_once(skewed, rows):
    pdf, df = skewed
    right = df.select("k", F.col("id").alias("rid"), F.col("v").alias("w"))

    def kernel(a, b):
        return a[["k", "id"]].assign(s=float(b["w"].sum()), n=len(b))

    parts = spread.tile_join(df, right, ["k"], ["id"], ["rid"], kernel, "k LONG, id LONG, s DOUBLE, n LONG", rows)
    got = parts.groupBy("k", "id").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas().sort_values("id")
    size, total = pdf.groupby("k")["v"].count(), pdf.groupby("k")["v"].sum()
    assert got["n"].tolist() == size[got["k"]].tolist()
    assert np.allclose(got["s"], total[got["k"]])


def test_pack_blocks_keeps_all_rows(skewed):
    pdf, df = skewed
    packed = spread.pack_blocks(df, ["k"], ["id"], rows=100).toPandas()
    assert sorted(np.concatenate(packed["id"].to_list())) == pdf["id"].tolist()
    assert packed.groupby("k").size()[0] > 10


def test_copies_of_a_lookup_are_counted_by_the_planner(spark):
    """A lookup of 5 MB may be broadcast, its 16 copies of 80 MB may not."""
    facts, lookup = spark.range(5).withColumn("k", F.col("id") % 3), spark.range(300_000).withColumnRenamed("id", "k")
    joined = spread.lookup_join(facts, lookup.withColumn("v", F.col("k") + 1), ["k"], "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.k, r.v) for r in joined.collect()) == [(i, i % 3, i % 3 + 1) for i in range(5)]
