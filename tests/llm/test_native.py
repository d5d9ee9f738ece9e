"""Mixing, exact dedup, line dedup and license scan: SQL twins, odd rows, weak hashes."""

import glob
import hashlib
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_queries import compare  # noqa: E402

from topiclens.llm.decontamination import find_leaks  # noqa: E402
from topiclens.llm.exact_dedup import chunks, exact_dedup  # noqa: E402
from topiclens.llm.licenses import Template, license_scan  # noqa: E402
from topiclens.llm.line_dedup import drop_lines, keep_bitmaps  # noqa: E402
from topiclens.llm.mixing import mix, mixed  # noqa: E402
from topiclens.llm.queries import ORACLES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ok, note = compare(spark, db, name, SF_DIR)
    assert ok, note


def test_native_plans_have_no_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    leaks = find_leaks(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
    for made in (mix(docs), exact_dedup(docs), drop_lines(docs), license_scan(docs), leaks):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("identify", [F.xxhash64, lambda c: F.length(c).cast("long")])
def test_exact_dedup_with_odd_rows_and_weak_identifiers(spark, odd_docs, no_docs, identify):
    texts = [(100 + i, ("Sentence number %d. " % (i % 4)) * 200) for i in range(12)] + [(200 + i, "ab"[i % 2] * 700) for i in range(4)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = docs.collect()
    got = exact_dedup(docs, identify=identify).collect()
    of = lambda r: r.text or ""
    want = []
    for r in rows:
        same = [s.doc_id for s in rows if of(s) == of(r)]
        keep = max((d for d in same if d is not None), default=None)
        want.append((r.doc_id, keep, len(same), r.doc_id == keep, hashlib.sha256(of(r).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup(no_docs).collect() == []


def test_chunks_join_to_the_text_and_realign(spark):
    text = "".join("Sentence %d is here. " % i for i in range(500)) + "x" * 20_000 + "\nend 😀"
    docs = spark.createDataFrame([(text,), ("Put in front. " + text,), ("",)], "t string")
    one, two, none = (r[0] for r in docs.select(chunks(F.col("t"))).collect())
    assert "".join(one) == text and "".join(two) == "Put in front. " + text and none == []
    assert len(set(one) & set(two)) > 10 and max(map(len, one)) <= 8192


def test_mix_with_odd_rows(spark, odd_docs, no_docs):
    got = mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    total = sum(r.size for r in got)
    sources = {}
    for row, r in zip(sorted(odd_docs.collect(), key=str), sorted(got, key=str)):
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
    assert mix(odd_docs).exceptAll(spark.createDataFrame(got, mix(odd_docs).schema)).count() == 0  # reruns agree
    assert mix(no_docs).collect() == [] and mixed(no_docs).collect() == []
    assert mixed(odd_docs).count() == sum(r.copies for r in got)
    assert total == sum(len((r.text or "").encode().split()) for r in odd_docs.collect()) and not sources


def test_mix_without_ids(spark):
    """A third of all rows has no id: they are told apart by their texts, so each target is met to half a document."""
    rows = [(None if n % 3 == 0 else n, "w " * (n % 7 + 1) + str(n), f"s{n % 4}") for n in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix(docs)
    got = {r.source_size: r.target for r in plan.select("source_size", "target").distinct().collect()}
    taken = {r.source_size: r.t for r in plan.groupBy("source_size").agg(F.sum("taken").alias("t")).collect()}
    assert len(got) == len({sum(len(t.split()) for _, t, s in rows if s == f"s{k}") for k in range(4)})
    several = {size: sum(size == sum(len(t.split()) for _, t, s in rows if s == f"s{k}") for k in range(4)) for size in got}
    assert all(abs(taken[size] - got[size] * several[size]) <= 4 * several[size] for size in got)
    assert mixed(docs).count() == plan.agg(F.sum("copies")).first()[0]


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.pmod(F.hash("id"), F.lit(40))).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).alias("source"),
    )
    sums = mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    assert all(abs(r.t - r.g) <= 20 for r in sums.collect())


def plain_lines(rows, least, first):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    docs, seen = {}, {}
    for n, (d, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            if key(line):
                docs.setdefault(key(line), set()).add((d, t))
                seen.setdefault(key(line), (n, i))
    out = []
    for n, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        keep = [x for i, x in enumerate(lines) if len(docs.get(key(x), ())) < least or (first and seen[key(x)] == (n, i))]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("first", [False, True])
def test_line_dedup(spark, first):
    rows = [(d, "\n".join([f"own {d}", " Shared\t", "often" if d % 2 else "seldom %d" % (d // 3), "", "\x0bSHARED"] * (1 + d % 30))) for d in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "Ärger\n" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, drop_lines(docs, 10, keep_first=first).collect()), key=str)
    assert got == plain_lines(rows, 10, first)
    widest = max(keep_bitmaps(docs, 10).collect(), key=lambda r: len(r.cleared))
    assert len(widest.cleared) <= 150 // 64 + 1


def test_line_dedup_with_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, drop_lines(odd_docs, 2).collect()), key=str)
    assert got == plain_lines(rows, 2, False)
    assert drop_lines(no_docs).collect() == []


def test_license_scan(spark, odd_docs, no_docs):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files"
    rows = [
        (1, "x under the MIT license; Under-the-mit LICENSE", (2, 1, 5, "mit", "mit", 1.0)),
        (2, mit, (0, None, None, "", "mit", 20 / 29)),
        (3, "Apache License, Version 2.0 or CC BY-NC 4.0", (2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 1.0)),
        (4, "This work is licensed under the GNU General Public License, version 3.", (0, None, None, "", "gpl-3", 1.0)),
        (5, "under the mit\x00licence free of charge", (0, None, None, "", "", 0.0)),
        (6, "cc by nc " * 3000, (3000, 0, 8997, "cc-by-nc", "cc-by-nc", 1.0)),
        (7, "underé the mit license", (0, None, None, "", "", 0.0)),
    ]
    got = license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).drop("n_words").collect()
    assert {tuple(r) for r in got} == {(d, *want) for d, _, want in rows}
    assert {r.n_base for r in license_scan(odd_docs).collect()} == {0} and license_scan(odd_docs).count() == odd_docs.count()
    assert license_scan(no_docs).collect() == []
    assert Template("x", "a b c b c d", ("b c d",)).key_spans() == [(3, ["b", "c", "d"])]
