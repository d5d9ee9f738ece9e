import random
from hashlib import sha256

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topiclens.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["<|im_end|>", "<|im_start|>", "<|", "<", "|", "\\", "<\\|", "<\\\\|im_end|>", "\n", "assistant\n", "<|endoftext|>", "é語😀", "", " ", "\x00", "&lt;"]


def test_turns_come_back():
    draw = random.Random(4)
    for _ in range(500):
        role, text = ("".join(draw.choice(NASTY) for _ in range(draw.randint(0, 5))) for _ in range(2))
        assert chat.parse_turn(chat.format_turn(role, text)) == (role, text)
        ids, first, last = chat.encode_turn("assistant", text, PATH)
        assert chat.decode(ids, PATH) == chat.format_turn("assistant", text)
        assert chat.unescape(chat.decode(ids[first:last], PATH)) == text
        ids, first, last = chat.encode_turn(role, text, PATH)
        assert chat.decode(ids, PATH) == chat.format_turn(role, text) and first == last


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encoder, draw = chat.PieceEncoder(path), random.Random(8)
    assert encoder.cuts == (name == "byte_bpe_50k.json")
    signs = [*NASTY, "It's", " we'LL", "'re", "  ", " \n ", "\t", "\r\n", "1234", " 5\u00b2", "caf\u00e9", " \u0178\u00aa", "\u00a0", "\u00ad", "\u0085", "\u2003", "!?", " ...", "\u0130", "e\u0301"]
    for _ in range(4000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 9)))
        assert encoder.ids(text) == library.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def packed(spark):
    draw = random.Random(9)
    opens = [("system", "Be brief."), ("user", "Hello <|im_end|>")]
    rows = []
    for c in range(60):
        turns = opens[: draw.randint(0, 2)] + [(draw.choice(["user", "assistant", None]), draw.choice(["yes", "no", None, "a longer answer", "<|"])) for _ in range(draw.randint(1, 4))]
        rows += [(c, t, role, text, "clash", 1) for t, (role, text) in enumerate(turns)]
    rows += [(None, None, "user", "no ids", "x", 0), (None, 1, "assistant", "fine", "x", 0), (70, 1, "user", "twice", "x", 0), (70, 1, "user", "twice", "x", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf string, tokens int")
    return rows, *chat.pack_conversations(frame, PATH)


def by_conversation(rows):
    found = {}
    for c, t, role, text, *_ in rows:
        found.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in found.items()}


def test_each_prefix_once_and_in_order(packed):
    rows, sequence, _ = packed
    turns = by_conversation(rows)
    prefixes = {tuple(t[: i + 1]) for t in turns.values() for i in range(len(t))}
    nodes = sorted(sequence.collect(), key=lambda n: n.start)
    assert len(nodes) == len(prefixes)
    assert [n.start for n in nodes] == [sum(len(m.tokens) for m in nodes[:i]) for i in range(len(nodes))]
    trees = [n.tree for n in nodes]
    assert len(set(trees)) == sum(a != b for a, b in zip(trees, [None, *trees]))  # depth first: a tree lies together


def test_attention_and_positions_equal_the_conversation(packed):
    rows, sequence, conversations = packed
    nodes = sorted(sequence.collect(), key=lambda n: n.start)
    stream = [i for n in nodes for i in n.tokens]
    at = {n.start: n for n in nodes}
    turns = by_conversation(rows)
    for c in conversations.collect():
        seen = []
        for start, (role, text) in zip(c.starts, turns[c.conv_id], strict=True):
            node = at[start]
            assert [i for a in node.attends for i in stream[a["from"] : a["to"]]] == seen
            assert node.position == len(seen)
            seen += node.tokens
            assert node.tokens == chat.encode_turn(role, text, PATH)[0]


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(*chat.pack_conversations(none, PATH), PATH).collect() == []


def test_vocabulary_leaves_the_marks_free():
    assert Tokenizer.from_file(PATH).get_vocab_size(with_added_tokens=True) <= chat.START_ID


def test_a_long_conversation_read_back(spark):
    """20,000 turns, and others that begin with some of them."""
    long = [("user" if n % 2 else "assistant", f"turn {n} <|im_end|>") for n in range(20_000)]
    held = {1: long, 2: long[:500] + [("assistant", "another end")], 3: long[:1], 4: long}
    rows = [(c, t, role, text) for c, turns in held.items() for t, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    sequence, conversations = chat.pack_conversations(frame, PATH)
    assert sequence.count() == 20_001
    for r in chat.read_conversations(sequence, conversations, PATH).collect():
        turns = held.pop(r.conv_id)
        learnt = "".join(text for role, text in turns if role == "assistant")
        assert r.turns_sha256 == sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(learnt), sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.format_turn(*t)) for t in turns)
    assert not held
