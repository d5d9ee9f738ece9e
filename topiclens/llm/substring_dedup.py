"""Substring dedup with suffix automata of reference shards.

A window of words is repeated if its words also start anywhere else. Windows are routed to
shards by content: each belongs to the smallest hash of the ``GRAM``-word runs inside it, its
anchor, so equal windows meet, and neighbouring windows with one anchor form a segment. Only
segments whose anchor stands more than once go on, each different one once with its number of
places. A segment that stands more than once is repeated as a whole. The others are judged where
their anchor has another segment: these are the reference, a task builds suffix automata over
shards of them that count the places of every window, streams the segments standing once through
for their matching statistics, and returns a bit for each window. A reference shard is sent where
its anchor's rows are, not to every task, as the reference grows with the corpus; its size is
bounded. The bits go back to all places, and documents lose the words under repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclens.llm.common import whole
from topiclens.session import cut_lineage

GRAM = 8
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 50_000
#: Of anchors with more different segments, every window is judged by itself.
CROWDED = 4096
KNOWN_WORDS = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _WordHashes()


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: at ASCII blanks only


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on, joined from runs of 1, 2, 4, ... words."""
    done, power, at = None, words, 0
    size = 1
    while length:
        if length & 1:
            if done is None:
                done = power
            else:
                n = len(words) - at - size + 1
                done = _mix(done[: max(0, n)] * ODD + power[at : at + max(0, n)])
            at += size
        length >>= 1
        if length:
            n = max(0, len(words) - 2 * size + 1)
            power = _mix(power[:n] * ODD + power[size : size + n] + np.uint64(size))
            size *= 2
    return done[: max(0, len(words) - at + 1)]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of ``width`` values from each place on."""
    place = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        size += step
    return place


def segments(hashes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """``anchor, first window, number of windows, content hash`` of each segment.

    ``ends`` says for every word where its document ends."""
    if len(hashes) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    grams = run_hashes(hashes, gram)
    least = sliding_argmin(grams, window - gram + 1)
    starts = np.arange(len(least))
    inside = np.flatnonzero(starts + window <= ends[: len(least)])
    if not len(inside):
        return segments(hashes[:0], ends, window, gram)
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (least[inside[1:]] != least[inside[:-1]]) | (np.diff(inside) > 1)
    first = inside[fresh]
    many = np.diff(np.append(np.flatnonzero(fresh), len(inside)))
    powers = np.full(len(hashes) + 1, ODD)
    powers[0] = 1
    inverses = np.full(len(hashes) + 1, INVERSE)
    inverses[0] = 1
    powers, inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes) * powers[:-1])])
    content = (sums[first + many + window - 1] - sums[first]) * inverses[first]
    content = _mix(content + (least[first] - first).astype(np.uint64) * np.uint64(64) + many.astype(np.uint64))
    return grams[least[first]].view(np.int64), first, many, content.view(np.int64)


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, _print, anchor, content, first, many``: the segments of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row = 0
            texts = part.column(2)
            while row < part.num_rows:
                begin, held, sizes = row, [], []
                while row < part.num_rows and sum(sizes) < BLOCK_WORDS:
                    held.append(word_hashes(split_words(texts[row].as_py())))
                    sizes.append(len(held[-1]))
                    row += 1
                ends = np.cumsum(sizes)
                anchor, first, many, content = segments(np.concatenate(held), np.repeat(ends, sizes), window, gram)
                owner = np.searchsorted(ends, first, "right")
                at = pa.array(begin + owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(anchor), pa.array(content), pa.array((first - (ends - sizes)[owner]).astype(np.int32)), pa.array(many.astype(np.int32))],
                    ["doc_id", "_print", "anchor", "content", "first", "many"],
                )

    return docs.mapInArrow(batches, f"doc_id {kind}, _print bigint, anchor bigint, content bigint, first int, many int")


def _with_lists(docs: DataFrame, rows: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Documents with the list ``_rows`` of their rows' ``columns``."""
    lists = rows.groupBy(F.col("doc_id").alias("_id"), F.col("_print").alias("_of")).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    lists = cut_lineage(lists).hint("shuffle_hash")
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_of")), how)
    return joined.select("doc_id", "_print", "text", "_rows")


def _single_windows(contents: DataFrame, window: int) -> DataFrame:
    """``anchor, content, bit, places, words``: the windows of segments, each by itself."""
    parts = F.split("words", " ")
    cut = F.transform(F.sequence(F.lit(0), F.size("_w") - window), lambda i: F.struct(i.alias("bit"), F.array_join(F.slice("_w", i + 1, window), " ").alias("words")))
    opened = contents.select("anchor", "content", "places", parts.alias("_w")).select("anchor", "content", "places", F.size("_w").alias("_n"), F.explode(cut).alias("_one"))
    return opened.select("anchor", "content", "_one.bit", "places", "_one.words")


def _contents(held: DataFrame, window: int) -> DataFrame:
    """``anchor, content, places, crowded, words``: the words of the segments listed with a document."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                own = split_words(part.column(2)[row].as_py())
                listed = part.column(3)[row].as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array([r["anchor"] for r in listed], pa.int64()),
                        "content": pa.array([r["content"] for r in listed], pa.int64()),
                        "places": pa.array([r["places"] for r in listed], pa.int64()),
                        "crowded": pa.array([r["crowded"] for r in listed], pa.bool_()),
                        "words": pa.array([b" ".join(own[r["first"] : r["first"] + r["many"] + window - 1]).decode() for r in listed]),
                    }
                )

    return held.mapInArrow(batches, "anchor bigint, content bigint, places bigint, crowded boolean, words string")


class SuffixAutomaton:
    """Of several word sequences, with the number of places where each state's words end.

    A sequence of weight ``n`` counts ``n`` times at every place from ``since`` on: the windows
    that end before belong to another segment.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list, n: int, since: int) -> None:
        nexts, links, lengths, counts = self.next, self.link, self.length, self.count
        last = 0
        for place, word in enumerate(words):
            at = nexts[last].get(word)
            if at is not None and lengths[at] == lengths[last] + 1:
                last = at
            else:
                if at is None:
                    new = len(nexts)
                    nexts.append({})
                    lengths.append(lengths[last] + 1)
                    links.append(0)
                    counts.append(0)
                    state = last
                    while state >= 0 and word not in nexts[state]:
                        nexts[state][word] = new
                        state = links[state]
                    if state >= 0:
                        old = nexts[state][word]
                        links[new] = old if lengths[old] == lengths[state] + 1 else self._split(state, word, old)
                    last = new
                else:
                    last = self._split(last, word, at)
            if place >= since:
                counts[last] += n

    def _split(self, state: int, word, old: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[old]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[old])
        self.count.append(0)
        self.link[old] = copy
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def total(self) -> None:
        """Adds up the counts along the suffix links, longest first."""
        for state in np.argsort(self.length, kind="stable")[::-1].tolist():
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def statistics(self, words: list, window: int) -> Iterator[tuple[int, int]]:
        """(place, places of the ``window`` words that end there) where they stand in the reference."""
        state = length = 0
        nexts, links, lengths = self.next, self.link, self.length
        for place, word in enumerate(words):
            while state and word not in nexts[state]:
                state = links[state]
                length = lengths[state]
            if word in nexts[state]:
                state = nexts[state][word]
                length += 1
            while state and lengths[links[state]] >= window:
                state = links[state]
                length = lengths[state]
            if length >= window:
                yield place, self.count[state]


def _shard_bits(rows: list[tuple], window: int) -> pa.RecordBatch:
    """Bits of the segments to judge; the others only count as reference."""
    reference, numbers = SuffixAutomaton(), {}
    split = [[numbers.setdefault(word, len(numbers)) for word in row[3].split(" ")] for row in rows]
    for row, words in zip(rows, split):
        reference.add(words, row[2], window - 1)
    reference.total()
    judged = [i for i, row in enumerate(rows) if row[4]]
    bits = [sum(1 << (place - window + 1) for place, n in reference.statistics(split[i], window) if n > 1) for i in judged]
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[i][0] for i in judged], pa.int64()), pa.array([rows[i][1] for i in judged], pa.int64()), pa.array(bits, pa.int64())],
        ["anchor", "content", "bits"],
    )


def repeated_bits(contents: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``anchor, content, bits`` of the segments to ``judge``: a bit for each window, set if it is repeated."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in range(5))):
                if size >= shard_words and row[0] != held[-1][0]:  # an anchor's segments stay together
                    yield _shard_bits(held, window)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(" ") + 1
        if held:
            yield _shard_bits(held, window)

    placed = contents.select("anchor", "content", "places", "words", "judge").repartition("anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(batches, "anchor bigint, content bigint, bits bigint")


def _kept(held: DataFrame, window: int) -> DataFrame:
    kind = held.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(3)
            listed = np.asarray(lists.value_lengths().fill_null(0))
            ends, rows = np.cumsum(listed), lists.flatten()
            firsts, bits = rows.field("first").to_numpy().astype(np.int64), rows.field("bits").to_numpy()
            texts, row = part.column(2), 0
            total, removed, kept = [], [], []
            while row < part.num_rows:
                begin, split, sizes = row, [], []
                while row < part.num_rows and sum(sizes) < BLOCK_WORDS:
                    split.append(split_words(texts[row].as_py()))
                    sizes.append(len(split[-1]))
                    row += 1
                some = slice(int(ends[begin] - listed[begin]), int(ends[row - 1]))
                base = np.cumsum(sizes) - sizes
                flags = np.unpackbits(np.ascontiguousarray(bits[some], "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, bit = np.nonzero(flags)
                starts = (np.repeat(base, listed[begin:row]) + firsts[some])[at] + bit
                n = int(sum(sizes))
                gone = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1))[:n] > 0
                for own, first in zip(split, base.tolist()):
                    mine = gone[first : first + len(own)]
                    lost = int(mine.sum())
                    total.append(len(own))
                    removed.append(lost)
                    kept.append(b" ".join([own[i] for i in np.flatnonzero(~mine).tolist()] if lost else own).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return held.mapInArrow(batches, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")


def substring_dedup(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, crowded: int = CROWDED,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs``.

    Words are cut at ASCII blanks, unchanged; a word goes if a ``window`` over it is repeated
    anywhere (all places go, the first one too). Kept words are joined by one space. Null counts
    as empty, shorter texts stay. Rows that repeat id and text count as different places. Other
    columns are ignored; an empty table gives an empty result. ``window`` is 63 + ``gram`` at most.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("_print"), "text")
    anchors = cut_lineage(_anchors(texts, window, gram))
    repeated = cut_lineage(anchors.groupBy("anchor").count().filter("count > 1").select("anchor"))
    # the same plan at every size, so that small inputs tell the cost of large ones
    found = cut_lineage(anchors.join(repeated.hint("shuffle_hash"), "anchor", "left_semi"))

    def different(rows: DataFrame) -> DataFrame:
        one = F.min(F.struct("doc_id", "_print", "first", "many")).alias("_one")
        return rows.groupBy("anchor", "content").agg(F.count("*").alias("places"), one).select("anchor", "content", "places", "_one.*")

    reference = cut_lineage(different(found))
    whole_bits = reference.filter("places > 1").select("anchor", "content", F.expr("shiftleft(1L, many) - 1").alias("bits"))
    # the others are compared where their anchor has another segment
    several = cut_lineage(reference.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1"))
    crowds = bool(several.filter(F.col("_n") > crowded).limit(1).count())
    marked = reference.join(several.hint("shuffle_hash"), "anchor").withColumn("crowded", F.col("_n") > crowded)
    contents = _contents(_with_lists(texts, marked, ["anchor", "content", "places", "crowded", "first", "many"]), window)
    judge = (F.col("places") == 1).alias("judge")
    if crowds:  # equal windows of crowded anchors are summed where they lie, then judged one by one
        contents = cut_lineage(contents)
        alone = cut_lineage(_single_windows(contents.filter("crowded"), window))
        summed = alone.groupBy("words").agg(F.sum("places").alias("places")).filter("places > 1")
        summed = summed.select(F.xxhash64("words").alias("anchor"), F.xxhash64("words").alias("content"), "places", "words", F.lit(True).alias("judge"))
        contents = contents.filter("not crowded").select("anchor", "content", "places", "words", judge).unionByName(summed)
    else:
        contents = contents.select("anchor", "content", "places", "words", judge)
    judged = repeated_bits(contents, window).filter("bits <> 0")
    if crowds:
        judged = cut_lineage(judged)
        windows = judged.select(F.col("anchor").alias("_window")).distinct()
        back = alone.withColumn("_window", F.xxhash64("words")).join(windows, "_window").groupBy("anchor", "content")
        judged = judged.unionByName(back.agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    bits = cut_lineage(whole_bits.unionByName(judged).groupBy("anchor", "content").agg(F.bit_or("bits").alias("bits")))
    places = found.join(bits.hint("shuffle_hash"), ["anchor", "content"])
    return _kept(_with_lists(texts, places, ["first", "bits"], "left"), window)
