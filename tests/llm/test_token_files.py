import io
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topiclens.llm.queries import QUERIES
from topiclens.llm.token_files import TokenFileReader, TokenFileWriter, WordEncoder, encodes_by_words, read_token_files, write_token_files

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, path=PATH):
    plain, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_direct_encoding(spark):
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet").sort_values("doc_id")
    got = sorted(tuple(r) for r in QUERIES["op6_token_files"](spark, SF_DIR).collect())
    assert got == expected(list(zip(docs.doc_id.tolist(), docs.text)))


def test_odd_rows(spark, odd_docs, no_docs):
    got = read_token_files(write_token_files(odd_docs, PATH)).collect()
    ids = sorted((r.doc_id for r in odd_docs.collect()), key=lambda d: (d is not None, d))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == ids
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    assert [tuple(r) for r in got] == expected([(d, text[d]) for d in ids])
    assert read_token_files(write_token_files(no_docs, PATH)).collect() == []


def test_tokenizer_of_another_kind(spark, odd_docs):
    """A tokenizer that takes other steps is asked text by text."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert encodes_by_words(PATH) and not encodes_by_words(other)
    rows = [(i, t) for i, t in enumerate(["Hello World, it is 2024.", "  two  blanks ", "", None, "Ärger\n語学 <|endoftext|>", *(r.text for r in odd_docs.collect())])]
    got = read_token_files(write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), other)).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, other)


def test_word_encoder_on_hard_texts():
    plain, own = Tokenizer.from_file(PATH), WordEncoder(PATH)
    draw = random.Random(5)
    bits = ["it's", "'re", "I'LL", "3.14", "...", "a,b", "Ünï", "é", " ́", " ", "　", "\x85", "\x1c", "\xa0", "\xad", "語学", "<|startoftext|>", "<|endoftext|>", "<|", "İ", "ΣΑΣ", "\r\n", "\t", "  ", "", "x.", "Word,", "WORD.,", "😀", "'", ".'s", "\x00", "²³", "½", "ŒUVRE", "ſ", "ŉ", "Ÿ", "ªº", "Straße", "ǅ", "Ⱥ"]
    texts = ["".join(draw.choice(bits) + draw.choice(["", " ", "\n"]) for _ in range(draw.randint(0, 12))) for _ in range(600)]
    texts += [f"a{c}b {c} {c}{c}z" for c in map(chr, range(0x180))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.encode([]) == []


def test_random_access_and_checksums():
    sink, draw = io.BytesIO(), np.random.default_rng(1)
    writer = TokenFileWriter(sink, frame_ids=100)
    docs = {i: draw.integers(0, 2**32, n, dtype=np.uint32) for i, n in [(3, 5), (None, 0), (7, 1234), (9, 100), (11, 1)]}
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.close()
    raw = sink.getvalue()
    reader = TokenFileReader(io.BytesIO(raw), len(raw))
    for i in (11, 7, None, 3, 9):
        assert reader.document(i).tolist() == docs[i].tolist()
    assert len(reader.packed) == 14 and reader.raw.max() == 400
    broken = bytearray(raw)
    broken[20] ^= 1
    with pytest.raises((ValueError, Exception)):
        TokenFileReader(io.BytesIO(bytes(broken)), len(raw)).document(3)
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as stream:  # any zstd reader skips the extra frames
        assert stream.read() == b"".join(np.asarray(d, "<u4").tobytes() for d in docs.values())
