"""Truncation to each topic's best terms is done in the tasks first."""

from pyspark.sql import functions as F

from topiclens import spread
from topiclens.plans import training as M

TOPICS = 3


def test_truncation_in_tasks_keeps_the_best(spark):
    """Few distinct values, so that ties at the cut go by term id, over many tasks and batches."""
    rows = [(t, [float((t * (k + 3)) % 11) for k in range(TOPICS)]) for t in range(1, 501)]
    sums = spark.createDataFrame(rows, "term_id INT, s ARRAY<DOUBLE>").repartition(7, "term_id")
    best = sums.mapInArrow(M._best_in_task(TOPICS, 20), "term_id INT, k INT, v DOUBLE")
    assert best.count() <= 7 * 20 * TOPICS < 500 * TOPICS
    order = [F.desc("v"), F.asc("term_id")]
    want = spread.top_per_group(sums.select("term_id", F.posexplode("s").alias("k", "v")), ["k"], order, 20)
    assert sorted(map(tuple, spread.top_per_group(best, ["k"], order, 20).select("k", "term_id", "v").collect())) == sorted(map(tuple, want.select("k", "term_id", "v").collect()))
