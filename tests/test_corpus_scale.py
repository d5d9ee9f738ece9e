"""Vocabularies too large to send, repeated titles, and how often the bag is made."""

import pytest
from pyspark.sql import functions as F

from topiclens import spread
from topiclens.catalog import QUERIES, standins
from topiclens.operators.corpus import bag_of_words, index_documents, index_terms, index_titles, term_stats


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_large_vocabulary_is_not_copied(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i % 40), f"the of w{i % 7} rare{i}") for i in range(200)] + [(None, "the x")], "title STRING, text STRING")
    bag = bag_of_words(docs, "title")
    terms, titles = index_terms(term_stats(bag)), index_titles(bag)
    want = sorted(index_documents(bag, terms, titles, n_terms=terms.count(), n_titles=41).collect())
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 20)
    found = index_documents(bag, terms, titles, n_terms=terms.count(), n_titles=20)
    assert sorted(found.collect()) == want and len(want) == 40 * 2 + 200 + 200  # a null title has no number
    assert "_salt" not in plan_of(found)


def test_join_by_heat_keeps_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 2)
    facts = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 9), ("c", 10), (None, 11)], "k STRING, f LONG")
    lookup = spark.createDataFrame([("a", 1, 9), ("a", 2, 1), ("b", 3, 1), ("b", 4, 1), (None, 5, 1), ("z", 6, None)], "k STRING, v LONG, n LONG")
    found = spread.lookup_join_by_heat(facts, lookup, ["k"], "n")
    assert sorted(found.collect()) == sorted(facts.join(lookup.drop("n"), ["k"]).collect()) and found.columns == ["k", "f", "v"]


@pytest.mark.parametrize("most", [1000, 1])
def test_bag_counts_repeated_titles_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(standins, "TITLE_ROWS", most)
    d = written(spark, tmp_path, [(1, "a b a"), (1, "a c"), (None, "a"), (None, "a"), (2, None), (3, " ")])
    found = standins.bag(spark, d)
    assert sorted(found.collect(), key=str) == sorted([("1", "a", 3), ("1", "b", 1), ("1", "c", 1), (None, "a", 2)], key=str)
    if most > 1:  # whole texts are dealt out, and no pairs after them
        assert plan_of(found).split("(1)")[0].count("Exchange") == 1


def test_bag_is_made_once(spark, tmp_path, monkeypatch):
    d = written(spark, tmp_path, [(i, f"w{i % 5} w{i % 3} x{i}") for i in range(40)])
    made = []
    monkeypatch.setattr("topiclens.catalog.corpus_queries.bag", lambda *a: made.append(0) or counted(standins.bag(*a), rows))
    for name in ("document_frequency_band", "collapsed_documents"):
        rows = spark.sparkContext.accumulator(0)
        want = {"document_frequency_band": 45, "collapsed_documents": 1}[name]
        assert len(QUERIES[name](spark, d).collect()) == want
        assert rows.value == sum(len({f"w{i % 5}", f"w{i % 3}", f"x{i}"}) for i in range(40))


def counted(bag, rows):
    def run(parts):
        for part in parts:
            rows.add(part.num_rows)
            yield part

    return bag.mapInArrow(run, bag.schema).select(*(F.col(c) for c in bag.columns))
