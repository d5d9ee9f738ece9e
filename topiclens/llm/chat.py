"""Chat formatting as a packed prefix tree.

Conversations that begin with the same turns share them: a node is a distinct prefix, named by
the chained hash of its turns. Nodes are laid out depth first, each once, in one long token
sequence; a node has the position ids it would have in its own conversation and the intervals
of the sequence that it may attend to (its ancestors), so training on the packed sequence
equals training on every conversation apart.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.llm.token_files import BYTES, LATIN, LETTERS, NUMBERS
from topiclens.session import cut_lineage
from topiclens.spread import number_rows, running_total

START, END = "<|im_start|>", "<|im_end|>"
#: Ids of the marks, after the 50,257 of the vocabulary; no text encodes to them.
START_ID, END_ID = 50257, 50258
LEARNT = "assistant"
#: Hex digits of a prefix's name.
NAME = 32
CACHED_PIECES, HELD_IDS = 500_000, 1 << 18
#: What ``PieceEncoder`` cuts by itself; fixed values, as the tokenizer's file writes them.
BYTE_STEPS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^ \t\n\r{LETTERS}{NUMBERS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
NOT_CUT = re.compile(rf"[^ \t\n\r{re.escape(''.join(LATIN))}]")


def escape(text: str) -> str:
    """Puts a backslash into every ``<|`` (one more where some stand already)."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse_turn(formatted: str) -> tuple[str, str]:
    header, _, text = formatted[len(START) : -len(END) - 1].partition("\n")
    if formatted != f"{START}{header}\n{text}{END}\n" or START in text or END in text:
        raise ValueError("not one formatted turn")
    return unescape_role(header), unescape(text)


class PieceEncoder:
    """Encodes texts with a tokenizer of the library. Where its file asks for just ``BYTE_STEPS``, texts of Latin
    characters are cut here and the ids of the last ``CACHED_PIECES`` or so pieces kept; the model never joins pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        plain = all(token["special"] for token in steps.get("added_tokens") or [])
        self.cuts = plain and steps["model"]["type"] == "BPE" and not steps["model"].get("dropout") and all(steps.get(k) == v for k, v in BYTE_STEPS.items())
        self.pieces: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        if not self.cuts or NOT_CUT.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out = []
        for piece in PIECE.findall(text):
            found = self.pieces.get(piece)
            if found is None:
                found = self.learn(piece)
            out += found
        return out

    def learn(self, piece: str) -> list[int]:
        found = [token.id for token in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTES))]
        if len(self.pieces) >= CACHED_PIECES:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = found
        return found


@cache
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_turn(role: str, text: str, path: str) -> tuple[list[int], int, int]:
    """Ids of a turn and the span of ids under the loss mask (empty unless it is learnt)."""
    ids = _encoder(path).ids
    head, body = [START_ID, *ids(escape_role(role) + "\n")], ids(escape(text))
    return [*head, *body, END_ID, *ids("\n")], len(head), len(head) + (len(body) if role == LEARNT else 0)


def decode(ids: Sequence[int], path: str) -> str:
    ids, out, at = np.asarray(ids, dtype=np.int64), [], 0
    marks = np.flatnonzero((ids == START_ID) | (ids == END_ID)).tolist()
    for mark in [*marks, len(ids)]:
        if mark > at:
            out.append(_encoder(path).tokenizer.decode(ids[at:mark].tolist(), skip_special_tokens=False))
        if mark < len(ids):
            out.append(START if ids[mark] == START_ID else END)
        at = mark + 1
    return "".join(out)


def _paths(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order and the name of every prefix."""
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            named = []
            for turns in part.column(1).to_pylist():
                name, names = b"", []
                for t in turns:
                    role = t["role"].encode()
                    name = hashlib.sha256(name + len(role).to_bytes(8, "big") + role + t["text"].encode()).digest()
                    names.append(name.hex()[:NAME])
                named.append(names)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.list_(pa.string())), part.column(1)], ["conv_id", "names", "turns"])

    turn_kind = listed.schema["turns"].dataType.simpleString()
    return listed.mapInArrow(batches, f"conv_id {kind}, names array<string>, turns {turn_kind}")


def _encode(owners: DataFrame, tokenizer: str) -> DataFrame:
    """The turns of each leaf that it does not share with the leaf before, as token rows."""
    kind = pa.schema(
        [("rank", pa.int64()), ("depth", pa.int32()), ("node", pa.string()), ("tree", pa.string()), ("tokens", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("n_tokens", pa.int32())]
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in parts:
            for rank, before, names, turns in zip(*(part.column(c) for c in range(4))):
                before, names, turns = before.as_py() or [], names.as_py(), turns.as_py()
                shared = next((n for n, (a, b) in enumerate(zip(before, names)) if a != b), min(len(before), len(names)))
                for depth in range(shared, len(turns)):
                    ids, first, last = encode_turn(turns[depth]["role"], turns[depth]["text"], tokenizer)
                    rows.append((rank.as_py(), depth, names[depth], names[0], ids, first, last, len(ids)))
                    held += len(ids)
                    if held >= HELD_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return owners.mapInArrow(batches, "rank bigint, depth int, node string, tree string, tokens array<int>, loss_from int, loss_to int, n_tokens int")


def _layout(spans: DataFrame) -> DataFrame:
    """For each node, at the first leaf below it: position of its first token, and intervals."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rank, listed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows, intervals, position = [], [], 0
                for s in sorted(listed, key=lambda s: s["depth"]):
                    if s["rank"] == rank:
                        rows.append({"node": s["node"], "position": position, "attends": [{"from": a, "to": b} for a, b in intervals]})
                    start, end = s["start"], s["start"] + s["n_tokens"]
                    if intervals and intervals[-1][1] == start:
                        intervals[-1] = (intervals[-1][0], end)
                    else:
                        intervals.append((start, end))
                    position += s["n_tokens"]
                if rows:
                    kind = pa.schema([("node", pa.string()), ("position", pa.int64()), ("attends", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return spans.select("rank", "spans").mapInArrow(batches, "node string, position bigint, attends array<struct<from:bigint,to:bigint>>")


def pack_conversations(turns: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The packed sequence and the conversations that read from it, both written.

    ``turns`` has ``conv_id, turn, role, text``; rows are put in order of turn, role and text
    (null turns first; null roles and texts are empty), each row one turn; other columns are
    ignored. A conversation is held by one task; those with equal turns are laid out once.

    Sequence: ``tree`` (its first turn's name), ``start`` (of the node in the sequence), ``tokens``,
    ``position`` (id of its first token; the others follow), ``attends`` (intervals of earlier
    tokens it sees whole, besides its own up to each token), ``loss_from, loss_to`` (span of its
    tokens under the loss mask). Conversations: ``conv_id, leaf, starts`` (of their nodes).
    """
    clean = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    paths = cut_lineage(_paths(clean).withColumn("leaf", F.element_at("names", -1)))
    distinct = paths.groupBy("leaf").agg(F.min("conv_id").alias("_first"), F.first("names").alias("_names"))  # a leaf's name stands for its path
    leaves = cut_lineage(number_rows(distinct, [F.col("_names")], "rank"))
    # sorted by path, a leaf shares with all earlier leaves what it shares with the one before
    before = leaves.select((F.col("rank") + 1).alias("rank"), F.col("_names").alias("_before"))
    owners = leaves.join(before, "rank", "left").select("rank", "_before", F.col("leaf").alias("_leaf"), "_first")
    owners = paths.join(owners, (F.col("leaf") == F.col("_leaf")) & F.col("conv_id").eqNullSafe(F.col("_first")))
    encoded = cut_lineage(_encode(owners.select("rank", "_before", "names", "turns"), tokenizer))

    sized = encoded.select("node", "rank", "depth", "n_tokens")
    placed = cut_lineage(running_total(sized, [F.col("rank"), F.col("depth")], F.col("n_tokens"), "start"))
    steps = leaves.select("leaf", F.col("rank").alias("_leaf_rank"), F.explode("_names").alias("node")).join(placed, "node")
    spans = steps.groupBy("leaf", F.col("_leaf_rank").alias("rank")).agg(F.collect_list(F.struct("depth", "node", "rank", "start", "n_tokens")).alias("spans"))
    spans = cut_lineage(spans)
    laid = placed.select("node", "start").join(_layout(spans), "node")
    sequence = encoded.drop("rank", "depth", "n_tokens").join(laid, "node").drop("node")
    sequence = cut_lineage(sequence.repartitionByRange("start").sortWithinPartitions("start"))
    starts = spans.select("leaf", F.transform(F.sort_array("spans"), lambda s: s["start"]).alias("starts"))
    return sequence, cut_lineage(paths.select("conv_id", "leaf").join(starts, "leaf"))


def _read_nodes(sequence: DataFrame, tokenizer: str) -> DataFrame:
    """``start, turn, learnt, chars``: the turn of every node, its text under the loss mask and its formatted length."""
    kind = pa.schema([("start", pa.int64()), ("turn", pa.string()), ("learnt", pa.string()), ("chars", pa.int64())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tokens, rows = part.column(1), []
            offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            for n, first, last in zip(range(part.num_rows), part.column(2).to_pylist(), part.column(3).to_pylist()):
                own = flat[offsets[n] : offsets[n + 1]]
                masked = decode(own[first:last], tokenizer)
                formatted = decode(own[:first], tokenizer) + masked + decode(own[last:], tokenizer)
                role, text = parse_turn(formatted)
                rows.append((f"{role}\n{text}\n", unescape(masked), len(formatted)))
            turn, learnt, chars = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (turn, learnt, chars), kind.types[1:])], schema=kind)

    return sequence.select("start", "tokens", "loss_from", "loss_to").mapInArrow(batches, "start bigint, turn string, learnt string, chars bigint")


def read_conversations(sequence: DataFrame, conversations: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, decoded from the sequence.

    A node is decoded once, however many conversations it begins."""
    wanted = conversations.dropDuplicates(["leaf"]).select("leaf", F.posexplode("starts").alias("at", "start"))
    held = wanted.join(_read_nodes(sequence, tokenizer), "start").groupBy("leaf")
    held = held.agg(F.sort_array(F.collect_list(F.struct("at", "turn", "learnt", "chars"))).alias("nodes"))
    digest = lambda field: F.sha2(F.array_join(F.col(f"nodes.{field}"), ""), 256)
    total = lambda of: F.aggregate("nodes", F.lit(0).cast("long"), lambda all, n: all + of(n).cast("long"))
    read = held.select(
        "leaf", F.size("nodes").cast("long").alias("n_turns"), digest("turn").alias("turns_sha256"), total(lambda n: F.length(n["learnt"])).alias("loss_chars"),
        digest("learnt").alias("loss_sha256"), total(lambda n: n["chars"]).alias("formatted_chars"),
    )
    return conversations.select("conv_id", "leaf").join(cut_lineage(read), "leaf").drop("leaf")
