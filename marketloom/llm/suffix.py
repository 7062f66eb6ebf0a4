"""Repeated byte strings across and within documents, by prefix doubling over sampled positions.

Positions get ranks by the first bytes of their string, pairs of ranks are sorted by Spark and ranked again over about
twice the length, and so on until a position's rank is its own or the length is past the threshold (400 bytes):

* Positions are sampled, as ranking every byte would move many times the input. The sample of a string of ``length``
  bytes is the place of the smallest q-gram hash among its first ``window`` q-grams (the leftmost of equal ones). It
  depends on the string only, so two equal strings have their samples at the same offset, and consecutive strings share
  them: about 2 / window of all positions are kept.
* Rank 0 is a 32-bit name (hash) of the first half of what all strings of a sample have in common, their
  ``length - window + 1`` bytes from the sample on.
* Round one sorts the pairs (rank of the sample, rank at the offset of half that length). Samples with a pair of their
  own drop out: none of their strings occurs twice.
* Round two groups the pairs (rank, 64-bit name of all bytes that the strings of the sample can cover, to both sides),
  which is past the threshold. Samples that still share a pair are settled: all their strings occur twice.
* Samples with the same rank and different surroundings are next to an edge of a repeat. Round three pairs the rank with
  the name of ``window / 2`` more bytes, to the right and to the left. Strings of the sample that cover those bytes go on
  only where another surrounding has the same pair; they are compared one by one, by a name of the whole length.
  One sample stands for all of equal surroundings. Nothing pairs documents with each other.

A wrong match of the 32-bit names only leaves more to compare.

A pair's rank is its place in the order of all pairs that occur twice, found by a range sort; its positions learn it by
a join. Frequent pairs are counted in the tasks first, and the join's large partitions can be split. Equal surroundings
within a piece of a task are merged before any shuffle, so text that repeats in place or in a third of all documents meets
in few rows.

Rows are known by a hash of their id and text, so that each pass over the documents finds the same numbers however
the input is split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, shared_dir, small_batches, written
from .tokens import U, Piece, mixed, pieces, powers, ranges, signed

SEED, Q, PLACE_BITS = 8, 16, 26


def samples(p: Piece, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places, the first and last start of the strings that have them, and the place's text borders."""
    none = np.zeros(0, np.int64)
    n = len(p.data)
    sums = p.sums(seed=SEED)
    m = n - Q + 1
    if m < window:
        return sums, none, none, none, none
    gram = (sums[Q:] - sums[:-Q]) * powers(n + 1)[1][:m]
    gram *= U(0xD6E8FEB86659FD93)
    out = []
    # places are numbered within blocks, so that a number and a hash fit one integer
    step = (1 << PLACE_BITS) - window
    for at in range(0, m - window + 1, step):
        part = gram[at : at + step + window - 1]
        key = (part >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < window:
            key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
        out.append((key & U((1 << PLACE_BITS) - 1)).astype(np.int64) + at)
    place = np.concatenate(out)
    sizes = np.diff(p.offsets)
    end = np.repeat(p.offsets[1:], sizes)[: len(place)]
    start = np.flatnonzero(np.arange(len(place)) + length <= end)
    if not len(start):
        return sums, none, none, none, none
    a = place[start]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    text = np.searchsorted(p.offsets, a[first], side="right") - 1
    return sums, a[first], start[first], start[last], text


def _ranked(length: int, window: int) -> object:
    """(uid, text) -> (pair, sides, around, uid, place, n): one row for each distinct surrounding in a piece; and, with n = 0, settled
    spans (from sides to around) where a piece holds a surrounding more than once. ``pair`` holds the rank and the rank at the
    offset, ``sides`` the names of the bytes to the right and to the left, ``place`` the sample's place and how far before it its
    first and last string start."""
    first = length - window + 1
    half, side = (first + 1) // 2, window // 2

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x >> U(32) << U(32) | y >> U(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for p in pieces(batch.column(1)):
                sums, a, lo, hi, text = samples(p, length, window)
                if not len(a):
                    continue
                start, end = p.offsets[text], p.offsets[text + 1]
                pair = joined(ranges(sums, a, a + half), ranges(sums, a + first - half, a + first))
                sides = joined(ranges(sums, a + first, np.minimum(a + first + window - side, end)), ranges(sums, np.maximum(a - side, start), a))
                left, right = np.maximum(a - window + 1, start), np.minimum(a + length, end)
                around = mixed(ranges(sums, left, right) + ((a - left) * 65537 + (right - a)).astype(np.uint64))
                by = np.lexsort((around, pair))
                same = np.zeros(len(by), bool)
                same[1:] = (pair[by][1:] == pair[by][:-1]) & (around[by][1:] == around[by][:-1])
                head = np.flatnonzero(~same)
                n = np.diff(np.append(head, len(by)))
                own, base = uid[p.first : p.last][text], start
                one = by[head]
                many = by[np.repeat(n > 1, n)]
                spans = np.stack([own[many], lo[many] - base[many], hi[many] - base[many] + length], 1) if len(many) else np.zeros((0, 3), np.int64)
                if len(spans):
                    # neighbouring samples' spans overlap: merge them within a text
                    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
                    reach = np.maximum.accumulate(spans[:, 2] + (np.unique(spans[:, 0], return_inverse=True)[1] << 40)) & ((1 << 40) - 1)
                    cut = np.ones(len(spans), bool)
                    cut[1:] = (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > reach[:-1])
                    f = np.flatnonzero(cut)
                    spans = np.stack([spans[f, 0], spans[f, 1], reach[np.append(f[1:], len(spans)) - 1]], 1)
                place = ((a - base) << 32 | (a - lo) << 16 | (a - hi))[one]
                none = np.zeros(len(spans), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([signed(pair[one]), spans[:, 0]])),
                        pa.array(np.concatenate([signed(sides[one]), spans[:, 1]])),
                        pa.array(np.concatenate([signed(around[one]), spans[:, 2]])),
                        pa.array(np.concatenate([own[one], spans[:, 0]])),
                        pa.array(np.concatenate([place, none])),
                        pa.array(np.concatenate([n, none]).astype(np.int32)),
                    ],
                    ["pair", "sides", "around", "uid", "place", "n"],
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [squeeze.compress(x.as_buffer()) if x.is_valid else None for x in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *batch.columns[2:]], batch.schema.names[:1] + ["packed"] + batch.schema.names[2:])


def _unpacked(column: pa.Array, groups: int = 1 << 20) -> Iterator[tuple[int, int, Piece]]:
    """Packed texts in pieces of bounded size."""
    loosen = zstandard.ZstdDecompressor()
    held, size, first = [], 0, 0
    for i, x in enumerate(column):
        raw = loosen.decompress(x.as_py()) if x.is_valid else b""
        held.append(raw)
        size += len(raw)
        if size >= groups or i + 1 == len(column):
            yield first, i + 1, Piece(first, i + 1, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in held])]).astype(np.int64))
            held, size, first = [], 0, i + 1


def _strings(length: int, window: int) -> object:
    """(uid, packed, id, marks) -> (h, uid, place): the strings of edge samples, named over the whole length; place is twice the start, and one more for a sample's own."""
    side = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, marks = batch.column(0).to_numpy(), batch.column(3)
            for i, j, p in _unpacked(batch.column(1)):
                sums = p.sums(seed=SEED)
                part = marks.slice(i, j - i)
                m = part.flatten()
                text = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))
                place, own, near, far = (m.field(x).to_numpy(zero_copy_only=False) for x in range(4))
                at = place >> 32
                lo, hi = at - (place >> 16 & 65535), at - (place & 65535)
                base, end = p.offsets[text], p.offsets[text + 1]
                # one sample stands for all strings of equal surroundings
                lo = np.where(own, lo, np.maximum(at - window + 1, 0))
                hi = np.where(own, hi, np.minimum(at, end - base - length))
                lo = np.where(far, lo, np.maximum(lo, at - side + 1)) + base
                hi = np.where(near, hi, np.minimum(hi, at - side)) + base
                n = np.maximum(hi - lo + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                h = mixed(ranges(sums, start, start + length) + ((at + base)[row] - start).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)), pa.array(uid[i:j][text[row]]), pa.array((start - base[row]) * 2 + own[row].astype(np.int64))], ["h", "uid", "place"]
                )

    return run


def _cut() -> object:
    """(uid, packed, id, spans) -> the result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, runs, digest = [], [], [], []
            spans = batch.column(3)
            for i, j, p in _unpacked(batch.column(1)):
                for k in range(j - i):
                    text = p.data[p.offsets[k] : p.offsets[k + 1]]
                    n, s, h = len(text), spans[i + k], hashlib.sha256()
                    lost = count = at = 0
                    if s.is_valid and len(s.values):
                        v = s.values
                        lo, hi = v.field(0).to_numpy(), v.field(1).to_numpy()
                        by = np.argsort(lo, kind="stable")
                        lo, reach = lo[by], np.maximum.accumulate(hi[by])
                        cut = np.ones(len(lo), bool)
                        cut[1:] = lo[1:] > reach[:-1]
                        f = np.flatnonzero(cut)
                        for a, b in zip(lo[f].tolist(), reach[np.append(f[1:], len(lo)) - 1].tolist(), strict=True):
                            h.update(text[at:a])
                            lost, count, at = lost + b - a, count + 1, b
                    h.update(text[at:])
                    total.append(n)
                    removed.append(lost)
                    runs.append(count)
                    digest.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), spans],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, window: int = 160) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and end bytes, not merged).

    Every byte covered by a string of ``length`` bytes that also starts anywhere else in the table, the same text
    included, is removed; strings never cross texts. Null and empty texts have 0 bytes and keep the digest of nothing.
    Rows repeated with one id are rows of their own (and remove each other if long enough). An empty table gives an
    empty result; other columns are ignored.
    """
    if not 1 <= window <= min(length - Q, 1 << 15):
        raise ValueError("window must leave room for the sampled q-gram")
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    id_field = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    base = docs.select(row_key(F.col(id_col), text).alias("uid"), text.alias("text"), F.col(id_col).alias("id"))
    ranked = base.select("uid", "text").mapInArrow(_ranked(length, window), "pair long, sides long, around long, uid long, place long, n int")

    # the rank of a pair: its place in the order of all pairs that several positions have
    pairs = ranked.where("n > 0").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").select("pair")
    pairs = written(pairs.repartitionByRange("pair").sortWithinPartitions("pair").withColumn("rank", F.monotonically_increasing_id()))
    active = written(ranked.join(pairs, "pair", "left").where("n = 0 or rank is not null").drop("pair"))
    within = active.where("n = 0").select("uid", F.col("sides").alias("start"), F.col("around").alias("end"))
    active = active.where("n > 0")

    same = active.groupBy("rank", "around").agg(F.sum("n").alias("same"), F.min(F.struct("uid", "place", "sides")).alias("head"))
    same = written(same.select("rank", "around", "same", "head.uid", "head.place", F.expr("shiftright(head.sides, 32)").alias("right"), F.expr("head.sides & 4294967295").alias("left")))
    at, first_start, last_start = F.expr("shiftright(place, 32)"), F.expr("shiftright(place, 16) & 65535"), F.expr("place & 65535")
    settled = active.join(same.where("same > 1").select("rank", "around"), ["rank", "around"]).select("uid", (at - first_start).alias("start"), (at - last_start + length).alias("end"))
    edges = same.select("rank", "same", "uid", "place", "right", "left")
    for side, mark in (("right", "near"), ("left", "far")):
        shared = same.groupBy("rank", side).agg(F.count("*").alias("k")).where("k > 1").select("rank", side, F.lit(True).alias(mark))
        edges = edges.join(shared, ["rank", side], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
    mark = F.struct("place", (F.col("same") == 1).alias("own"), "near", "far")
    marks = edges.where("near or far").groupBy("uid").agg(F.collect_list(mark).alias("marks"))
    # texts move once: all joins ask for the same columns and rows by the same key, so one exchange serves them
    packed = base.mapInArrow(_packed, f"uid long, packed binary, id {id_field}").where("uid is not null")
    strings = packed.join(marks.hint("shuffle_hash"), "uid").mapInArrow(_strings(length, window), "h long, uid long, place long")
    twice = strings.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h")
    singles = strings.where("place % 2 = 1").join(twice, F.col("h") == F.col("_h")).select("uid", F.expr("place div 2").alias("start"), (F.expr("place div 2") + length).alias("end"))
    spans = within.unionByName(settled).unionByName(singles).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = packed.join(spans.hint("shuffle_hash"), "uid", "left").select("uid", "packed", "id", "spans")
    span_type = "array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(_cut(), f"id {id_field}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {span_type}").withColumnRenamed("id", id_col)
