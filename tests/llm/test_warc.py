import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from topiclens.llm import warc
from topiclens.llm.token_files import file_system
from topiclens.llm.warc import chunked, dechunked, http_payload, parse_record, read_warc, reassembled, write_warc

ODD = [
    (1, "http://a/x y", "é" * 700), (2, "http://b/", "é" * 700), (3, None, "é" * 700), (None, "http://n/", "é" * 700), (4, "http://c/\r\nX: y", None), (5, "", ""),
    (6, "http://d/", "a" * 999), (7, "http://d/", "a" * 999), (8, "http://e/", "b" * 1000), (8, "http://e/", "b" * 1000), (9, "http://e/", "b" * 1000),
    (10, "http://f/", "".join(chr(33 + i % 90) for i in range(100_000))), (None, None, None), (11, "http://ü.example/ß?q=語", "0\r\n\r\n"),
]


def plain(rows, limit=1000):
    """(id, bytes, digest, type, refers) of every row."""
    out, by = [], {}
    data = [(i, (t or "").encode()) for i, _, t in rows]
    for i, b in data:
        by.setdefault(b, []).append(i)
    for i, b in data:
        most = max((x for x in by[b] if x is not None), default=None)
        other = len(b) >= limit and most is not None and most != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", most if other else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    made = spark.createDataFrame(ODD, "page_id long, url string, html string")
    return made.withColumns({c: F.lit("clash") for c in ("_id", "_url", "_payload", "_kept", "_same", "_n", "path", "status", "payload")})


def back(manifest):
    rows = read_warc(manifest).collect()
    assert all(r.status == "ok" for r in rows), [r.status for r in rows]
    return rows


@pytest.mark.parametrize("segment, file", [(1 << 14, 1 << 27), (700, 3000), (1 << 30, 1)])
def test_written_and_read_back(spark, pages, segment, file):
    manifest = write_warc(pages, segment_bytes=segment, file_bytes=file)
    assert (manifest.count() > 10) == (file < 1 << 27)
    rows = back(manifest.orderBy(F.desc("path")))
    number = lambda v: None if v is None else int(v)
    assert sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows), key=str) == plain(ODD)
    texts = {(number(r.page_id), bytes(r.payload)) for r in rows if r.record_type == "response"}
    assert texts == {(i, b) for (i, _, t) in ODD for b in [(t or "").encode()] if (i, len(b), hashlib.sha1(b).hexdigest(), "response", None) in plain(ODD)}
    assert all(r.payload is None for r in rows if r.record_type == "revisit")
    uris = {number(r.page_id): r.target_uri for r in rows}
    assert uris[1] == "http://a/x%20y" and uris[4] == "http://c/%0D%0AX:%20y" and uris[3] is None
    assert read_warc(manifest, with_payload=False).filter("payload is not null").count() == 0


def test_empty_table_and_text_ids(spark, pages):
    assert read_warc(write_warc(pages.limit(0))).collect() == []
    named = spark.createDataFrame([("a b", "u", "x" * 2000), ("b: c", "u", "x" * 2000)], "page_id string, url string, html string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in back(write_warc(named))} == {("a b", "revisit", "b: c"), ("b: c", "response", None)}


def rewritten(spark, manifest, change):
    """The archives again, each record passed through ``change`` (None: left out)."""
    paths = []
    for r in manifest.collect():
        store, name = file_system(r.path)
        with store.open_input_stream(name, compression=None) as source:
            records = [x for x in map(change, warc._members(source)) if x]
        with store.open_output_stream(name + ".new", compression=None) as sink:
            for x in records:
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                sink.write(packer.compress(x) + packer.flush())
        paths.append((r.path + ".new",))
    return spark.createDataFrame(paths, "path string")


def test_faults_are_named(spark):
    rows = [(1, "http://a/", "word " * 2000), (2, "http://b/", "short text")]
    manifest = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), segment_bytes=1000)

    def states(change):
        return {r.page_id: (r.status, r.payload_bytes) for r in read_warc(rewritten(spark, manifest, change)).collect()}

    field = lambda x, name: parse_record(x)[0].get(name)
    whole = ("ok", 10)
    assert states(lambda x: x) == {"1": ("ok", 10_000), "2": whole}
    assert states(lambda x: x if field(x, "warc-segment-number") != "4" else None) == {"1": ("segment missing", None), "2": whole}
    assert states(lambda x: x if not field(x, "warc-segment-total-length") else None) == {"1": ("segment missing", None), "2": whole}
    assert states(lambda x: x if field(x, "warc-segment-number") != "1" else None) == {None: ("segment missing", None), "2": whole}
    assert states(lambda x: x.replace(b"Segment-Total-Length: 10", b"Segment-Total-Length: 99")) == {"1": ("length differs", None), "2": whole}
    assert states(lambda x: x.replace(b"word word", b"word Word", 1)) == {"1": ("digest differs", None), "2": whole}
    assert states(lambda x: x.replace(b"\r\n1000\r\n", b"\r\n100z\r\n")) == {"1": ("framing broken", None), "2": whole}
    twice = rewritten(spark, manifest, lambda x: x)
    assert {r.page_id: r.status for r in read_warc(twice.union(twice).filter(F.lit(True))).dropDuplicates(["page_id"]).collect()} == {"1": "ok", "2": "ok"}


def test_chunk_framing():
    draw = random.Random(4)
    for n in (0, 1, 9, 10, 11, 1000):
        payload = draw.randbytes(n)
        for size in (1, 10, 4096):
            assert dechunked(chunked(payload, size)) == payload
    assert dechunked(b"3;name=value\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: x\r\nOther: y\r\n\r\n") == b"abc0123456789"
    for broken in (b"", b"3\r\nabc\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"x\r\n\r\n", b"-1\r\n\r\n", b"0\r\n", b"0\r\n\r\nmore", b"+3\r\nabc\r\n0\r\n\r\n", b"ff\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            dechunked(broken)
    assert http_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab") == b"ab" == http_payload(b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nab")
    with pytest.raises(ValueError):
        http_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nab")


def test_segments_in_any_order():
    parts = [{"number": i + 1, "total": 9 if i == 2 else None, "block": b} for i, b in enumerate((b"abc", b"def", b"ghi"))]
    assert reassembled(parts[::-1]) == reassembled(parts + parts[:1]) == b"abcdefghi"
    with pytest.raises(ValueError, match="length"):
        reassembled([*parts, {"number": 1, "total": None, "block": b"abd"}])
    with pytest.raises(ValueError):
        list(warc._members(io.BytesIO(zlib.compress(b"x" * 1000, wbits=31)[:-9])))
