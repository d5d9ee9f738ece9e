import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from topiclens.llm.merkle import folded, leaf_digest, merkle_manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in COLUMNS)))


def tree(leaves, fanout=8):
    """Root, and of every leaf its siblings level by level, as (left, right)."""
    paths, nodes = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for i, (_, below) in enumerate(run):
                for j in below:
                    paths[j].append(("".join(d for d, _ in run[:i]), "".join(d for d, _ in run[i + 1 :])))
            above.append((h("".join(d for d, _ in run)), [j for _, below in run for j in below]))
        nodes = above
    return nodes[0][0], paths


def plain(rows, fanout=8):
    """(id, leaf, subroot, root, proof) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)) for r in groups[g]))
        made[g] = own, *tree([d for *_, d in own], fanout)
    root, over = tree([made[g][1] for g in order], fanout)
    out = []
    for g, up in zip(order, over):
        own, subroot, paths = made[g]
        out += [(i if there else None, d, subroot, root, tuple(p + up)) for (there, i, d), p in zip(own, paths)]
    return sorted(out, key=str)


def got(manifest):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in manifest.collect()), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [r.asDict() for r in odd_docs.collect()]
    assert got(merkle_manifest(odd_docs)) == plain(rows)
    empty = merkle_manifest(no_docs, carry=["text"])
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof", "text"]


@pytest.mark.parametrize("fanout, height", [(8, 4), (2, 1), (2, 3), (3, 2), (8, 1)])
def test_trees_over_many_subtrees(spark, fanout, height):
    """Sizes around every power, in several rounds of subtrees; many groups."""
    sizes = {None: 1, "": 2, "a": 7, "b": 8, "c": 9, "ä": 64, "z": 65, "\U0001f600": 130, **{f"g{i:03d}": 1 + i % 3 for i in range(20)}}
    rows = [(n * 1000 + i, f"text {i}", g, "s", i) for n, (g, size) in enumerate(sizes.items()) for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    made = merkle_manifest(docs, fanout=fanout, height=height)
    assert got(made) == plain([r.asDict() for r in docs.collect()], fanout)


def test_one_group_and_one_row(spark):
    one = spark.createDataFrame([(5, "t", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle_manifest(one).collect()
    assert row.leaf == row.subroot == row.root == leaf({"doc_id": 5, "text": "t", "lang": "en", "source": None, "n_chars": None}) and row.proof == []


def test_proofs_reject_what_was_changed(spark, odd_docs):
    changed = odd_docs.withColumn("other", leaf_digest(*(F.concat("text", F.lit("!")) if c == "text" else F.col(c) for c in COLUMNS)))
    made = merkle_manifest(changed, carry=["other", "text"]).withColumn("same", folded(F.col("leaf"), F.col("proof"))).withColumn("fold", folded(F.col("other"), F.col("proof")))
    for r in made.collect():
        assert r.same == r.root and (r.fold == r.root) == (r.text is None)


def test_query_against_a_plain_version(spark):
    """Tampered texts: null stays null, and a text without capitals is not changed."""
    from topiclens.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r[0]: r for r in plain([r.asDict() for r in docs])}
    rows = QUERIES["op12_merkle"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs) and {r.verified for r in rows} == {True, False}
    texts = {r.doc_id: r for r in docs}
    for r in rows:
        _, own, subroot, root, proof = want[r.doc_id]
        fields = texts[r.doc_id].asDict()
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and fields["text"] is not None:
            fields["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in fields["text"])
        fold = leaf(fields)
        for a, b in proof:
            fold = h(a + fold + b)
        assert (r.leaf, r.subroot, r.root, r.folded_root, r.verified) == (own, subroot, root, fold, fold == root)
        assert r.proof_sha256 == h("".join(a + b for a, b in proof))
