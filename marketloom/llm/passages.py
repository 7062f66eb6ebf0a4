"""Repeated passages of words, removed by matching statistics against suffix automata of reference shards.

A window of ``length`` words is removed where the same words also start earlier. To know it, each window would have to
meet all others of its content; passages are dealt into shards so that it does:

* Anchors. Of the grams of ``gram`` words in a window the one with the smallest hash (the leftmost of equal ones) is its
  anchor. It depends on the window's words only, and neighbouring windows share it: about one position in eight is an
  anchor. Anchors that occur once drop out with their windows.
* Surroundings. All windows of an anchor's occurrence, end to end, are its surroundings. Of equal surroundings only the
  first in the order of documents can be new; the others are removed without another look. This is an aggregation that
  combines in the tasks, so a passage that a third of all documents copy whole never meets in one place.
* Shards. The first of each distinct surroundings, as a sequence of word hashes, goes to the shard of its anchor, in the
  order of documents. A shard's task streams its sequences: each runs through the suffix automaton of the sequences
  before it, which gives at each word the longest match that ends there; windows whose match is ``length`` words or
  longer start earlier elsewhere. Then the automaton is extended by the sequence. One automaton lives for one anchor.
* Crowded anchors, with more than ``crowd`` distinct surroundings (a common line between different neighbours), are dealt
  by the window instead: a window's first place is a minimum by its hash, again combined in the tasks.

An automaton of a whole reference shard is not sent to all executors: every document would have to be matched with every
shard, work that grows with the square of the corpus. Here a sequence meets only the automaton that can know its windows.

Rows are known by a hash of their file and place (see ``common.numbered``). Word, anchor and surroundings hashes have 64
bits; a false match has odds of pairs / 2^64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, shared_dir, small_batches, written
from .tokens import U, Piece, mixed, pieces, powers, ranges, signed

SEED, PLACE_BITS = 13, 26
SPAN = "uid long, start long, end long"


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the smallest (by its upper bits, then the leftmost)."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    out = []
    # places are numbered within blocks, so that a place and the upper bits of a hash fit one integer
    step = (1 << PLACE_BITS) - width
    for at in range(0, len(values) - width + 1, step):
        part = values[at : at + step + width - 1]
        key = (part >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        out.append((key & U((1 << PLACE_BITS) - 1)).astype(np.int64) + at)
    return np.concatenate(out)


def word_sums(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their running sums (for hashes of word ranges), and per text the index of its first word."""
    starts, ends, borders = p.words()
    h = ranges(p.sums(seed=SEED), starts, ends)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h) + 1)[0][: len(h)], out=sums[1:])
    return h, sums, borders


def anchors(p: Piece, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per run of windows with one anchor: anchor and surroundings hash, the first and last window's start, the text."""
    h, sums, borders = word_sums(p)
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    at = np.arange(len(h) - gram + 1)
    hashes = ranges(sums, at, at + gram)
    place = lowest(hashes, length - gram + 1)
    start = np.flatnonzero(np.arange(len(place)) + length <= np.repeat(borders[1:], np.diff(borders))[: len(place)])
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    a = place[start]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(a)) - 1
    lo, hi, a = start[head], start[last], a[head]
    around = mixed(ranges(sums, lo, hi + length) + ((a - lo) * 65537 + (hi - lo)).astype(np.uint64))
    return hashes[a], around, lo, hi, np.searchsorted(borders, lo, side="right") - 1


def _anchored(length: int, gram: int) -> object:
    """(uid, id, text) -> (anchor, around, uid, id, place); a place is 256 times the first window's start, and the number of further windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for p in pieces(batch.column(2)):
                anchor, around, lo, hi, text = anchors(p, length, gram)
                if len(anchor):
                    borders = p.words()[2]
                    own = text + p.first
                    place = (lo - borders[text]) * 256 + (hi - lo)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(signed(around)), pa.array(uid[own]), batch.column(1).take(pa.array(own)), pa.array(place)], ["anchor", "around", "uid", "id", "place"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [squeeze.compress(x.as_buffer()) if x.is_valid else None for x in batch.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["uid", "id", "packed"])


def _unpacked(column: pa.Array, size: int = 1 << 20) -> Iterator[Piece]:
    """Packed texts in pieces of about ``size`` bytes."""
    loosen = zstandard.ZstdDecompressor()
    held, total, first = [], 0, 0
    for i, x in enumerate(column):
        held.append(loosen.decompress(x.as_py()) if x.is_valid else b"")
        total += len(held[-1])
        if total >= size or i + 1 == len(column):
            yield Piece(first, i + 1, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in held])]).astype(np.int64))
            held, total, first = [], 0, i + 1


def _sequences(length: int) -> object:
    """(uid, id, packed, marks) -> (key, uid, id, place, words): the surroundings of each mark as word hashes under its anchor; for a crowded mark a row for each window under the window's hash, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, marks = batch.column(0).to_numpy(), batch.column(3)
            for p in _unpacked(batch.column(2)):
                h, sums, borders = word_sums(p)
                part = marks.slice(p.first, p.last - p.first)
                flat = part.flatten()
                text = np.repeat(np.arange(p.last - p.first), np.diff(part.offsets.to_numpy()))
                anchor, place, crowded = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                lo, more = place // 256 + borders[text], place % 256
                plain, many = np.flatnonzero(~crowded), np.flatnonzero(crowded)
                raw = h.tobytes()
                words = [raw[8 * a : 8 * b] for a, b in zip(lo[plain].tolist(), (lo + more + length)[plain].tolist(), strict=True)]
                n = more[many] + 1
                row = np.repeat(many, n)
                start = np.repeat(lo[many] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                key = np.concatenate([anchor[plain], signed(ranges(sums, start, start + length))])
                own = np.concatenate([text[plain], text[row]]) + p.first
                places = np.concatenate([place[plain], (start - borders[text[row]]) * 256])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(uid[own]), batch.column(1).take(pa.array(own)), pa.array(places), pa.array(words + [None] * len(row), pa.binary())], ["key", "uid", "id", "place", "words"]
                )

    return run


class Automaton:
    """The suffix automaton of several sequences: it knows every run of their words, and no other."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def matches(self, words: list[int]) -> list[int]:
        """For each word the length of the longest known run that ends with it."""
        state = known = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                known = self.length[state]
            to = self.next[state].get(w)
            if to is not None:
                state, known = to, known + 1
            out.append(known)
        return out

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, w: int, to: int) -> int:
        """The state for the runs that end with ``w`` after those of ``state``, apart from longer ones that share ``to``."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while state >= 0 and self.next[state].get(w) == to:
            self.next[state][w] = copy
            state = self.link[state]
        return copy

    def extend(self, words: list[int]) -> None:
        last = 0
        for w in words:
            to = self.next[last].get(w)
            if to is not None:
                last = self._split(last, w, to)
                continue
            new, state = self._state(self.length[last] + 1, 0, {}), last
            while state >= 0 and w not in self.next[state]:
                self.next[state][w] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, w, self.next[state][w])
            last = new


def _streamed(length: int) -> object:
    """(key, uid, place, words), each key's rows together and in order -> spans of windows that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, waiting = None, None, None
        for batch in batches:
            spans: list[tuple[int, int, int]] = []
            for k, uid, place, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = np.frombuffer(raw, np.int64).tolist()
                if k != key:
                    key, shard, waiting = k, None, words
                    continue
                shard = shard or Automaton()
                if waiting is not None:
                    shard.extend(waiting)
                at = shard.matches(words)
                waiting = None if at[-1] == len(words) else words
                first = None
                for e in range(length - 1, len(words) + 1):
                    if e < len(words) and at[e] >= length:
                        first = e if first is None else first
                    elif first is not None:
                        spans.append((uid, place // 256 + first - length + 1, place // 256 + e))
                        first = None
            columns = list(zip(*spans, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "start", "end"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, id, packed, spans of words) -> (id, n_words, n_removed, kept_sha256, spans)."""
    for batch in batches:
        spans, n_words, n_removed, digests = batch.column(3), [], [], []
        for p in _unpacked(batch.column(2)):
            starts, ends, borders = p.words()
            part = spans.slice(p.first, p.last - p.first)
            flat = part.flatten()
            text = np.repeat(np.arange(p.last - p.first), pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy())
            change = np.zeros(len(starts) + 1, np.int64)
            if len(text):
                np.add.at(change, flat.field(0).to_numpy() + borders[text], 1)
                np.add.at(change, flat.field(1).to_numpy() + borders[text], -1)
            kept = np.cumsum(change)[:-1] == 0
            # bytes of kept words, and the one white space byte behind each
            inside = np.zeros(len(p.data) + 1, np.int8)
            border = np.repeat(p.offsets[1:], np.diff(borders))
            np.add.at(inside, starts[kept], 1)
            np.add.at(inside, np.minimum(ends + 1, border)[kept], -1)
            out = np.cumsum(inside[:-1]).astype(bool)
            data = p.data.copy()
            data[ends[ends < border]] = 32
            lost = np.concatenate([[0], np.cumsum(~kept)])
            for k in range(p.last - p.first):
                a, b = p.offsets[k], p.offsets[k + 1]
                digests.append(hashlib.sha256(data[a:b][out[a:b]].tobytes().removesuffix(b" ")).hexdigest())
            n_words += np.diff(borders).tolist()
            n_removed += (lost[borders[1:]] - lost[borders[:-1]]).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), spans], ["id", "n_words", "n_removed", "kept_sha256", "spans"])


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, gram: int = 6, crowd: int = 1000) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, spans (array of first word and word after the last, not merged).

    Every word covered by a window of ``length`` consecutive words that also starts earlier, in a row with a smaller id or
    at an earlier word of the same row, is removed; windows never cross rows. Null and empty texts have no words and keep
    the digest of nothing. Null ids come last; rows that share an id are ordered by a fixed number of their own, so of
    repeated rows one stays. An empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= gram < length or length - gram > 200:
        raise ValueError("gram must be shorter than length, by 200 words at most")
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    name = "uid"
    while name in docs.columns:
        name += "_"
    base = numbered(docs, name).select(F.col(name).alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = base.mapInArrow(_anchored(length, gram), f"anchor long, around long, uid long, id {id_type}, place long")
    repeated = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    active = written(found.join(repeated, "anchor", "left_semi"))

    def order(place: str = "place") -> object:
        return F.struct(F.col("id").isNull().alias("none"), "id", "uid", F.col(place).alias("place"))

    def span(windows: str, place: str = "place") -> list:
        return ["uid", F.expr(f"{place} div 256").alias("start"), F.expr(f"{place} div 256 + {windows} + {length}").alias("end")]

    firsts = written(active.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(order()).alias("first")))
    later = (F.col("uid") != F.col("first.uid")) | (F.col("place") != F.col("first.place"))
    copies = active.join(firsts.where("n > 1"), ["anchor", "around"]).where(later).select(*span("place % 256"))

    several = firsts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    edges = firsts.join(several, "anchor").select(F.col("first.uid").alias("uid"), F.struct("anchor", F.col("first.place").alias("place"), (F.col("k") > crowd).alias("crowded")).alias("mark"))
    marks = edges.groupBy("uid").agg(F.collect_list("mark").alias("marks"))
    packed = base.mapInArrow(_packed, f"uid long, id {id_type}, packed binary").where("uid is not null")
    sequences = written(packed.join(marks.hint("shuffle_hash"), "uid").select("uid", "id", "packed", "marks").mapInArrow(_sequences(length), f"key long, uid long, id {id_type}, place long, words binary"))
    shards = sequences.where("words is not null").repartition("key").sortWithinPartitions("key", F.col("id").asc_nulls_last(), "uid", "place")
    matched = shards.select("key", "uid", "place", "words").mapInArrow(_streamed(length), SPAN)
    windows = sequences.where("words is null").drop("words")
    heads = windows.groupBy("key").agg(F.count("*").alias("n"), F.min(order()).alias("first")).where("n > 1")
    crowds = windows.join(heads, "key").where(later).select(*span("0"))

    spans = copies.unionByName(matched).unionByName(crowds).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = packed.join(spans.hint("shuffle_hash"), "uid", "left").select("uid", "id", "packed", "spans")
    return joined.mapInArrow(_cut, f"id {id_type}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>").withColumnRenamed("id", id_col)
