"""WARC archives with segmented records: written by the tasks, reassembled by origin.

A page is a `response` record: an HTTP message whose body travels in chunks. A block longer
than the segment size is cut: the first segment keeps the record's headers, the others are
`continuation` records that name the first one's id (their origin) and their number, and the
last one states the total length. Segments may lie in different files.

Reading parses each file where it lies. Records that are whole are decoded there; only
segments are shuffled, by the id of their origin, put in order, checked for gaps and for the
stated length, joined and decoded. Each record carries gzip framing of its own, as is usual.

Files are written under a name of the task's own attempt; only names that finished tasks
report are in the manifest, so a task lost half-way leaves a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.llm.token_files import file_system
from topiclens.session import cut_lineage, ensure_checkpoint_dir

REVISIT_BYTES = 1000
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 1 << 14, 1 << 12, 1 << 27
READ_BYTES, BATCH_BYTES = 1 << 20, 1 << 22
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OK, MISSING, LENGTH, FRAMING, DIGEST = "ok", "segment missing", "length differs", "framing broken", "digest differs"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
RECORD = "record_id string, record_type string, page_id string, target_uri string, refers_to string, digest string, length bigint"
PARSED = f"{RECORD}, number int, total bigint, block binary"
DECODED = "record_id string, record_type string, page_id string, target_uri string, refers_to string, payload binary, payload_bytes bigint, payload_digest string, status string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("no chunk size")
        size, at = int(digits, 16), end + 2
        if size == 0:
            break
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end")
        parts.append(body[at : at + size])
        at += size + 2
    while (end := body.find(b"\r\n", at)) > at:  # trailer fields
        at = end + 2
    if end < 0 or end + 2 != len(body):
        raise ValueError("no end of the trailer")
    return b"".join(parts)


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no end of the header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return dechunked(body)
    if b"content-length" in fields and int(fields[b"content-length"]) != len(body):
        raise ValueError("body length differs")
    return body


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, segment_bytes: int, date: str) -> Iterator[bytes]:
    """The records of a page: one revisit, one response, or a response and its continuations."""
    record_id = f"<urn:uuid:{uuid.uuid4()}>"
    shown = lambda text: None if text is None else quote(text, safe="%!#$&'()*+,/:;=?@[]~")
    fields = [
        ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", shown(url)),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", _sha1(payload)),
        ("X-Page-ID", None if page_id is None else quote(page_id, safe="")), ("X-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", quote(refers_to, safe=""))], HEAD + b"\r\n")
        return
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *fields], block)
        return
    yield _record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = len(block) if at + segment_bytes >= len(block) else None
        own = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", record_id)]
        yield _record([("WARC-Type", "continuation"), *own, ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", last)], block[at : at + segment_bytes])


def write_warc(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None,
    revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record for each row; returns the manifest ``path, n_records, n_bytes``.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, those with the largest id
    are written in full, the others as revisits of it; rows that repeat id and payload are
    alike. Payloads are equal when their SHA-256 is. A null payload counts as empty; null ids
    are below all others (a group without any id is written in full); a null or blank url is
    carried as it is. Ids of any type; other columns are ignored. An empty table gives no file.
    """
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("_payload"))
    large = F.octet_length("_payload") >= revisit_bytes
    alike = rows.filter(large).withColumn("_same", F.sha2("_payload", 256))
    kept = alike.groupBy("_same").agg(F.max("_id").alias("_kept"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # the table's measured size decides on a broadcast; else skewed payloads are split at run time
    placed = alike.join(cut_lineage(kept), "_same", "left").select("_id", "_url", "_payload", "_kept")
    placed = placed.unionByName(rows.filter(~large).withColumn("_kept", F.lit(None).cast(rows.schema["_id"].dataType)))
    revisits = F.col("_kept").isNotNull() & ~F.col("_kept").eqNullSafe(F.col("_id"))
    ready = placed.select(F.col("_id").cast("string"), "_url", "_payload", F.when(revisits, F.col("_kept").cast("string")).alias("_of"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, done = None, []

        def close() -> None:
            sink.close()
            done.append((f"{folder}/{name}", n_records, n_bytes))

        for part in parts:
            for row in zip(*(column.to_pylist() for column in part.columns)):
                for record in page_records(*row, segment_bytes, date):
                    if sink is None:
                        store, base = file_system(folder)
                        store.create_dir(base, recursive=True)
                        name, n_records, n_bytes = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    sink.write(member)
                    n_records, n_bytes = n_records + 1, n_bytes + len(member)
                    if n_bytes >= file_bytes:  # the next segment may lie in the next file
                        close()
                        sink = None
        if sink is not None:
            close()
        if done:
            paths, records, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_records", "n_bytes"])

    return cut_lineage(ready.mapInArrow(write, MANIFEST))


def _members(source) -> Iterator[bytes]:
    """The records of an archive, each unpacked from its own gzip member."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := source.read(READ_BYTES):
        while data:
            parts.append(unpacker.decompress(data))
            if not unpacker.eof:
                break
            yield b"".join(parts)
            data, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("archive ends inside a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not blank or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record does not end at its length")
    return fields, rest[:length]


def _parse(segments: bool):
    """Rows of PARSED from paths: the records that are segments, or those that are whole."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in PARSED.split(", ")]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, PARSED.split(", "))])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        number = lambda value: None if value is None else int(value)
        text = lambda value: None if value is None else unquote(value)
        for part in parts:
            for path in part.column(0).to_pylist():
                store, name = file_system(path)
                with store.open_input_stream(name, compression=None) as source:
                    for record in _members(source):
                        fields, block = parse_record(record)
                        get = fields.get
                        kind, at = get("warc-type"), number(get("warc-segment-number"))
                        if kind not in ("response", "revisit", "continuation") or (at is not None) != segments:
                            continue
                        own = kind != "continuation"
                        rows.append((
                            get("warc-record-id") if own else get("warc-segment-origin-id"), kind if own else None, text(get("x-page-id")), get("warc-target-uri"),
                            text(get("x-refers-to-page-id")), get("warc-payload-digest"), number(get("x-payload-length")), at, number(get("warc-segment-total-length")), block,
                        ))
                        held += len(block)
                        if held >= BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()

    return parse


def reassembled(segments: list[dict]) -> bytes:
    """The block of a record from its segments in any order; equal segments count once."""
    by_number: dict[int, tuple[bytes, int | None]] = {}
    for s in segments:
        if by_number.setdefault(s["number"], (s["block"], s["total"])) != (s["block"], s["total"]):
            raise ValueError(LENGTH)
    n = max(by_number)
    if set(by_number) != set(range(1, n + 1)) or by_number[n][1] is None:
        raise ValueError(MISSING)
    block = b"".join(by_number[i][0] for i in range(1, n + 1))
    if len(block) != by_number[n][1]:
        raise ValueError(LENGTH)
    return block


def _decode(with_payload: bool):
    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for row in part.to_pylist():
                payload, status, length, digest = None, OK, row["length"], row["digest"]
                digest = digest and base64.b32decode(digest.partition(":")[2]).hex()
                try:
                    whole = row["segments"][0]["number"] is None
                    block = row["segments"][0]["block"] if whole else reassembled(row["segments"])
                    if row["record_type"] is None:
                        raise ValueError(MISSING)
                    if row["record_type"] == "response":
                        try:
                            payload = http_payload(block)
                        except ValueError:
                            raise ValueError(FRAMING) from None
                        if digest is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(DIGEST)
                        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                except ValueError as fault:
                    payload, status = None, str(fault)
                out.append((
                    row["record_id"], row["record_type"], row["page_id"], row["target_uri"], row["refers_to"], payload if with_payload else None,
                    length if status == OK else None, digest if status == OK else None, status,
                ))
            if out:
                columns = [*([pa.string()] * 5), pa.binary(), pa.int64(), pa.string(), pa.string()]
                names = [field.split()[0] for field in DECODED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), columns)], names)

    return decode


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every response and revisit of the archives whose ``path`` is given, one row each:
    ``record_id, record_type, page_id, target_uri, refers_to, payload, payload_bytes,
    payload_digest, status``.

    ``payload_digest`` is the bare hex SHA-1, of a revisit that of the payload it stands for;
    a revisit has no payload of its own. ``status`` is ``ok``, or says why the record has none:
    a segment is missing (its first one: then the record is named by the id its segments give),
    lengths differ from the stated total, the framing is broken, or the digest differs. Records
    of other kinds are passed over; a file that is no archive is an error. A record is held
    whole in one task, as its row was when it was written.
    """
    paths = files.select("path").repartition(max(1, files.count()))
    one = F.struct("number", "total", "block")
    head = [field.split()[0] for field in RECORD.split(", ")]
    whole = paths.mapInArrow(_parse(False), PARSED).select(*head, F.array(one).alias("segments"))
    cut = paths.mapInArrow(_parse(True), PARSED).groupBy("record_id").agg(
        *(F.max(c).alias(c) for c in head[1:]), F.collect_list(one).alias("segments")  # only first segments have a head
    )
    return whole.unionByName(cut).mapInArrow(_decode(with_payload), DECODED)
