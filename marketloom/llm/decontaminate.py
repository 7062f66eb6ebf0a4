"""Benchmark decontamination by latent semantic retrieval.

A passage is a bag of words with TF-IDF weights. The columns of the passage matrix are the benchmark block's own words,
one each, and a fixed number of hashed columns for all other words; inverse document frequencies are counted over all
documents. A distributed randomised SVD finds the latent space: Spark multiplies the matrix of the passages of all
documents (and of all benchmark items) with a few random vectors, twice for accuracy, and only sums of fixed size come
to the driver. The pass that counts frequencies leaves the passages' columns in packed blocks, so that the texts are
read into words once for all of this.

Every window of every document, in the lengths of the benchmark items, is a query: where the benchmark's words bring
half of the TF-IDF energy that the least item of that length has, it is projected into the latent space and compared
with the items by cosine. As a space of fixed rank cannot tell many items apart, windows that hold enough of
an item's rarest words are candidates as well: no window that the check on the words accepts lacks them (``gates``).
Candidates are then
checked on the words themselves: the longest common subsequence must hold most of the item's words, or, for
paraphrases, somewhat fewer if the item's answer (its last words, unless a column names it) is there as well.

Words are runs of letters and digits, and single characters of scripts that are written without spaces. Items of few
words are looked for as a whole: all their words and operators, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, small_batches, written
from .packed import pack, unpack
from .tokens import Index, Piece, mixed, pieces, powers, ranges

SLICES = 64
OPERATORS = np.frombuffer(b"+-*/=<>^%", np.uint8)


@dataclass
class Space:
    """Columns, weights and the latent embedding of each column; the items of one benchmark block."""

    words: np.ndarray
    hashed: int
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    embed: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    items: list = field(default_factory=list)
    item_words: list = field(default_factory=list)
    answers: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    classes: list = field(default_factory=list)
    least: list = field(default_factory=list)
    #: by item: how many of its rarest words a window must hold
    needed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: by word: the items that have it among those, from first[word] on
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    rare_in: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: whole short items by number of tokens: keys, and the items of each
    whole: dict = field(default_factory=dict)

    def columns(self, h: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_index"):
            self._index = Index(self.words)
        at = self._index.find(h)
        return np.where(at >= 0, at, len(self.words) + (h % np.uint64(self.hashed)).astype(np.int64))

    def latent(self) -> np.ndarray:
        """The embedding with a row for each latent direction."""
        if not hasattr(self, "_latent"):
            self._latent = np.ascontiguousarray(self.embed.T)
        return self._latent

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of an item and one of its words, and the word's places in the item as bits."""
        if not hasattr(self, "_places"):
            short = [i for i, n in enumerate(self.lengths) if 0 < n <= 64]
            word = [self.columns(self.item_words[i]) for i in short]
            key = np.concatenate([i * np.int64(len(self.words)) + w for i, w in zip(short, word, strict=True)] or [np.zeros(1, np.int64) - 1])
            bit = np.concatenate([np.uint64(1) << np.arange(len(w), dtype=np.uint64) for w in word] or [np.zeros(1, np.uint64)])
            keys, at = np.unique(key, return_inverse=True)
            bits = np.zeros(len(keys), np.uint64)
            np.bitwise_or.at(bits, at, bit)
            self._places = (keys, bits)
        return self._places

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_index", "_latent", "_places")}


def _borders(data: np.ndarray, operators: bool) -> tuple[np.ndarray, np.ndarray]:
    """By byte: whether it belongs to a word, and whether a word must begin there."""
    inside = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    begins = np.zeros(len(data) + 1, bool)
    if operators:
        at = np.flatnonzero(np.isin(data, OPERATORS))
        inside[at] = begins[at] = begins[at + 1] = True
    lead = np.flatnonzero(data >= 0xE0)
    lead = lead[lead < len(data) - 2]
    if len(lead):
        x, y, z = data[lead], data[lead + 1], data[lead + 2]
        # ideographic and full-width marks divide words
        mark = ((x == 0xE3) & (y == 0x80)) | ((x == 0xEF) & (y == 0xBC) & ((z <= 0x8F) | (z >= 0x9A)) & (z <= 0xA0))
        for i in range(3):
            inside[lead[mark] + i] = False
        thai_lao, khmer = (x == 0xE0) & (y >= 0xB8) & (y <= 0xBB), (x == 0xE1) & (((y >= 0x80) & (y <= 0x82)) | (y == 0x9E) | (y == 0x9F))
        three, four = ~mark & (((x >= 0xE3) & (x <= 0xE9)) | thai_lao | khmer), (x == 0xF0) & (y >= 0xA0)
        begins[lead[three | four]] = True
        begins[lead[three] + 3] = True
        begins[np.minimum(lead[four] + 4, len(data))] = True
    return inside, begins[:-1]


def word_hashes(p: Piece, operators: bool = False) -> tuple[np.ndarray, np.ndarray]:
    inside, begins = _borders(p.data, operators)
    borders = p.offsets[:-1]
    begins[borders[borders < len(begins)]] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins))
    after = np.ones(len(inside), bool)
    after[:-1] = ~inside[1:] | begins[1:]
    ends = np.flatnonzero(inside & after) + 1
    return ranges(p.sums(lower=True), starts, ends), np.searchsorted(starts, p.offsets)


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """The keys of all runs of ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(h) - n + 1] + np.uint64(n))


def hashes_of(texts: list[str | None], operators: bool = False) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for p in pieces(pa.array([(x or "").lower() for x in texts], pa.string())):
        h, b = word_hashes(p, operators)
        out += [h[b[i] : b[i + 1]] for i in range(len(b) - 1)]
    return out


def _passages(shared, length: int, counting: bool) -> object:  # noqa: ANN001
    """Blocks of passages of ``length`` words (distinct columns of each, the columns, their numbers) and, if ``counting``, the texts that have each column; column -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        width = len(s.words) + s.hashed
        df, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for p in pieces(batch.column(0)):
                h, b = word_hashes(p)
                words = np.diff(b)
                held = (words + length - 1) // length
                first = np.cumsum(held) - held
                row = np.repeat(first, words) + (np.arange(len(h)) - np.repeat(b[:-1], words)) // length
                cell, tf = np.unique(row * width + s.columns(h), return_counts=True)
                row, col = cell // width, cell % width
                if counting:
                    pairs, _ = np.unique(np.repeat(np.arange(len(held)), held)[row] * width + col, return_counts=True)
                    df += np.bincount(pairs % width, minlength=width)
                    n += len(held)
                if len(cell):
                    block = pack(np.bincount(row, minlength=int(held.sum())), col, tf)
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([block], pa.binary())], names)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n)), pa.nulls(len(at) + 1, pa.binary())], names)

    names = ["col", "n", "block"]
    return run


def run_sums(x: np.ndarray, at: np.ndarray, sizes: np.ndarray, group: int, part: int = 4096) -> np.ndarray:
    """Sums of the rows ``at`` of ``x`` over runs of the given sizes, none of them 0. Runs are cut into groups, filled up
    with the last row of ``x``, which is zero; groups are added by matrix products, in parts that the cache holds."""
    held = (sizes + group - 1) // group
    first = np.cumsum(held) - held
    slots = np.full(int(held.sum()) * group, len(x) - 1)
    slots[np.arange(len(at)) + np.repeat(first * group - (np.cumsum(sizes) - sizes), sizes)] = at
    out = np.empty((len(slots) // group, x.shape[1]), x.dtype)
    ones, step = np.ones((1, group), x.dtype), max(1, part // group)
    for i in range(0, len(out), step):
        out[i : i + step] = np.matmul(ones, np.take(x, slots[i * group : (i + step) * group], axis=0).reshape(-1, group, x.shape[1]))[:, 0]
    return out if len(out) == len(sizes) else np.add.reduceat(out, first, axis=0)


def _products(shared, length: int, gram: bool) -> object:  # noqa: ANN001
    """Partial sums of A'(A X) by slices of rows, or of (A X)'(A X). The rows of A are passages of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, x = shared.value
        weighted = np.vstack([idf[:, None] * x, np.zeros((1, x.shape[1]))]).astype(np.float32)
        total = np.zeros((x.shape[1], x.shape[1]) if gram else x.shape)
        for batch in batches:
            for block in batch.column(0):
                sizes, col, tf = (a.astype(np.int64) for a in unpack(block.as_py()))
                first = np.cumsum(sizes) - sizes
                norm = np.maximum(np.add.reduceat((tf * idf[col]) ** 2, first), 1e-24)
                # a column stands as often as in the passage, so that sums need no weights
                col, words = np.repeat(col, tf), np.add.reduceat(tf, first)
                y = run_sums(weighted, col, words, length)
                if gram:
                    y = y / np.sqrt(norm)[:, None]
                    total += y.T @ y
                    continue
                y = np.vstack([y / norm.astype(np.float32)[:, None], np.zeros((1, x.shape[1]), np.float32)])
                by = np.argsort(col.astype(np.uint16) if len(idf) <= 1 << 16 else col, kind="stable")
                held = np.bincount(col)
                used = np.flatnonzero(held)
                total[used] += run_sums(y, np.repeat(np.arange(len(words)), words)[by], held[used], 16)
        if not gram:
            total *= idf[:, None]
        for k, part in enumerate(np.array_split(total, SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "part"])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pdf["part"].iloc[0])
    for x in pdf["part"].iloc[1:]:
        total = total + np.frombuffer(x)
    return pd.DataFrame({"k": [pdf["k"].iloc[0]], "part": [total.tobytes()]})


def fit(texts: DataFrame, items: list, item_texts: list, answers: list, hashed: int = 1 << 13, rank: int = 48, passage: int = 40) -> Space:
    """The latent space of one benchmark block. ``texts`` has the column text, lower-cased; frequencies count all of it, and the SVD sees all its passages and the items."""
    spark = texts.sparkSession
    words = hashes_of(item_texts)
    s = Space(np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64), hashed)
    shared = spark.sparkContext.broadcast(s)
    own = spark.createDataFrame([((x or "").lower(),) for x in item_texts], "text string").coalesce(1)
    parts = [t.mapInArrow(_passages(shared, passage, counting), "col long, n long, block binary") for t, counting in ((texts.select("text"), True), (own, False))]
    table = written(parts[0].unionByName(parts[1]))
    counts = {r["col"]: r["n"] for r in table.where("block is null").groupBy("col").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(-1, 0)
    df = np.zeros(len(s.words) + hashed)
    df[list(counts)] = list(counts.values())
    s.idf = np.log((total + 2) / (df + 1))
    blocks = table.where("block is not null").select("block")
    rng = np.random.default_rng(7)
    x = rng.standard_normal((len(s.idf), rank + 8))
    for turn in range(3):
        gram = turn == 2
        shared = spark.sparkContext.broadcast((s.idf, x))
        parts = blocks.mapInArrow(_products(shared, passage, gram), "k int, part binary").groupBy("k").applyInPandas(_added, "k int, part binary").collect()
        z = np.concatenate([np.frombuffer(r["part"]).reshape(-1, x.shape[1]) for r in sorted(parts, key=lambda r: r["k"])])
        if not gram:
            x = np.linalg.qr(z)[0]
        shared.unpersist()
    discard(table)
    power, turn_ = np.linalg.eigh(z)
    best = np.argsort(power)[::-1][:rank]
    sigma = np.sqrt(np.maximum(power[best], 1e-9))
    # whitened: every latent direction counts alike, so unrelated passages have cosines near 0
    s.embed = (s.idf[:, None] * (x @ turn_[:, best]) / np.maximum(sigma, sigma[0] * 0.05)).astype(np.float32)
    s.items, s.item_words, s.lengths = items, words, [len(w) for w in words]
    s.answers = [hashes_of([a])[0] if a else w[-max(1, len(w) // 8) :] for a, w in zip(answers, words, strict=True)]
    classes: dict[int, list[int]] = {}
    for i, n in enumerate(s.lengths):
        if n:
            classes.setdefault(int(round(np.log(n) / np.log(1.25))), []).append(i)
    for group in classes.values():
        length = int(np.median([s.lengths[i] for i in group]))
        v = np.stack([s.embed[s.columns(words[i])].sum(0) for i in group])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        s.classes.append((length, np.array(group), v.astype(np.float32)))
    return s


def energies(s: Space) -> list[float]:
    """The least TF-IDF energy (squared weights of the words) of the items of each class of lengths."""
    return [min(float((s.idf[s.columns(s.item_words[i])] ** 2).sum()) for i in group) for _, group, _ in s.classes]


def gates(s: Space, share: float) -> None:
    """Sets what a window must hold of the rarest words of an item for a common subsequence of ``share`` of its words.

    Such a subsequence takes at least r = share * n of the item's n words, so at most n - r of any of them are missing:
    of the n - r + k rarest words at least k are there.
    """
    word, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    s.needed = np.ones(len(s.lengths), np.int64)
    for i in (int(i) for _, group, _ in s.classes for i in group):
        own, n = s.columns(s.item_words[i]), s.lengths[i]
        r = max(1, int(np.ceil(share * n - 1e-9)))
        s.needed[i] = k = (r + 1) // 2
        rare = np.unique(own[np.argsort(-s.idf[own], kind="stable")][: n - r + k])
        word.append(rare)
        item.append(np.full(len(rare), i))
    w = np.concatenate(word)
    s.first = np.searchsorted(np.sort(w), np.arange(len(s.words) + 1))
    s.rare_in = np.concatenate(item)[np.argsort(w, kind="stable")]


def shorts(s: Space, texts: list, chosen: list[int]) -> None:
    """Sets the keys of the items that are looked for as a whole."""
    found: dict[int, dict[int, list[int]]] = {}
    for i, h in zip(chosen, hashes_of([texts[i] for i in chosen], operators=True), strict=True):
        if len(h):
            found.setdefault(len(h), {}).setdefault(int(sequences(h, len(h))[0]), []).append(i)
    s.whole = {n: (Index(np.array(list(keys), np.uint64)), list(keys.values())) for n, keys in found.items()}


def rare_runs(s: Space, col: np.ndarray, text: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first place, last place) of all runs of an item's rarest words that are as many as needed within ``reach``."""
    n = np.append(np.diff(s.first), 0)[np.minimum(col, len(s.words))]
    at = np.flatnonzero(n)
    n = n[at]
    place = np.repeat(at, n)
    item = s.rare_in[np.repeat(s.first[col[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    by = np.argsort(item * np.int64(len(col) + 1) + place, kind="stable")
    item, place = item[by], place[by]
    last = np.arange(len(item)) + s.needed[item] - 1
    ok = last < len(item)
    last = np.minimum(last, len(item) - 1)
    ok &= (item[last] == item) & (text[place[last]] == text[place]) & (place[last] - place < reach[item])
    return item[ok], place[ok], place[last[ok]]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, on the bits of one integer."""
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def common_lengths(s: Space, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, col: np.ndarray, share: float) -> np.ndarray:
    """Lengths of the longest common subsequences of items and the words lo..hi, many at once; 0 where the words in common are
    fewer than ``share`` of the item's. Items of up to 64 words are the bits of one integer."""
    out = np.zeros(len(item), np.int64)
    lengths = np.asarray(s.lengths, np.int64)
    for k in np.flatnonzero(lengths[item] > 64).tolist():
        out[k] = common_subsequence(s.item_words[item[k]], h[lo[k] : hi[k]])
    keys, bits = s.places()
    todo = np.flatnonzero(lengths[item] <= 64)
    for at in range(0, len(todo), 4096):
        part = todo[at : at + 4096]
        n = np.maximum(hi[part] - lo[part], 0)
        who = np.repeat(np.arange(len(part)), n)
        word = col[np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        own = np.flatnonzero(word < len(s.words))
        who, word = who[own], word[own]
        key = item[part][who] * np.int64(len(s.words)) + word
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        own = np.flatnonzero(keys[found] == key)
        who, mask = who[own], bits[found[own]]
        size = lengths[item[part]]
        # the words in common bound the subsequence
        first = np.searchsorted(who, np.arange(len(part) + 1))
        some = np.flatnonzero(np.diff(first))
        covered = np.zeros(len(part), np.int64)
        covered[some] = np.bitwise_count(np.bitwise_or.reduceat(mask, first[some])) if len(some) else 0
        good = np.flatnonzero(covered >= share * size - 1e-9)
        if not len(good):
            continue
        held = np.diff(first)[good]
        steps = np.zeros((int(held.max()), len(good)), np.uint64)
        row = np.repeat(np.arange(len(good)), held)
        step = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
        steps[step, row] = mask[first[good][row] + step]
        full = ~np.uint64(0) >> (64 - size[good]).astype(np.uint64)
        v = full.copy()
        for m in steps:
            u = v & m
            v = ((v + u) | (v - u)) & full
        out[part[good]] = size[good] - np.bitwise_count(v)
    return out


def _search(shared, min_weight: float, min_cosine: float, min_lcs: float, min_paraphrase: float) -> object:  # noqa: ANN001
    share = min(min_lcs, min_paraphrase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Space = shared.value
        of_item = {int(i): (length, v) for length, group, vectors in s.classes for i, v in zip(group, vectors, strict=True)}
        lengths = np.asarray(s.lengths, np.int64)
        margin = lengths // 3 + 1
        span_of = np.array([of_item[i][0] if i in of_item else 0 for i in range(len(lengths))], np.int64)
        # words of the longest window of an item, margins included
        reach = np.where(span_of > 0, span_of + 2 * margin, 0)
        for batch in batches:
            rows: dict[tuple[int, int], tuple[float, float]] = {}
            for p in pieces(batch.column(1), 1 << 18):
                h, b = word_hashes(p)
                col = s.columns(h)
                energy = np.zeros(len(h) + 1)
                np.cumsum(np.where(col < len(s.words), s.idf[col] ** 2, 0.0) if len(col) else col, out=energy[1:])
                size = np.diff(b)
                near = []
                covered = np.zeros(len(h) + 1, np.int32)
                for length, least in zip((c[0] for c in s.classes), s.least, strict=True):
                    stride = max(1, length // 8)
                    # windows of every text at every stride, and one that ends with the text
                    span = np.minimum(size, length)
                    n = np.where(size > 0, (size - span + stride - 1) // stride + 1, 0)
                    text = np.repeat(np.arange(len(size)), n)
                    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                    lo = b[text] + np.minimum(k * stride, size[text] - span[text])
                    hi = lo + span[text]
                    sel = np.flatnonzero(energy[hi] - energy[lo] >= min_weight * least)
                    near.append((lo[sel], hi[sel], text[sel]))
                    np.add.at(covered, lo[sel], 1)
                    np.add.at(covered, hi[sel], -1)
                # latent running sums over the words of such windows only
                inside = np.cumsum(covered)[:-1] > 0
                place = np.zeros((s.embed.shape[1], int(inside.sum()) + 1))
                np.cumsum(s.latent()[:, col[inside]], axis=1, out=place[:, 1:], dtype=np.float64)
                at = np.concatenate([[0], np.cumsum(inside)])

                def accepted(text: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, float]]:
                    """(index, ratio) of the windows lo..hi that hold what the item asks for, margins included."""
                    lo, hi = np.maximum(b[text], lo - margin[item]), np.minimum(b[text + 1], hi + margin[item])
                    ratio = common_lengths(s, item, lo, hi, h, col, share) / lengths[item]
                    for k in np.flatnonzero((ratio >= min_lcs) | (ratio >= min_paraphrase)).tolist():
                        if ratio[k] >= min_lcs or np.isin(s.answers[item[k]], h[lo[k] : hi[k]]).all():
                            yield k, float(ratio[k])

                for (lo, hi, text), (_, group, vectors) in zip(near, s.classes, strict=True):
                    for i in range(0, len(lo), 4096):
                        v = (place[:, at[hi[i : i + 4096]]] - place[:, at[lo[i : i + 4096]]]).astype(np.float32)
                        cos = (v.T @ vectors.T) / np.maximum(np.sqrt(np.einsum("ij,ij->j", v, v)), 1e-12)[:, None]
                        a, g = np.nonzero(cos >= min_cosine)
                        by = np.argsort(-cos[a, g], kind="stable")
                        a, g = a[by], g[by]
                        for k, ratio in accepted(text[i + a], group[g], lo[i + a], hi[i + a]):
                            key = (p.first + int(text[i + a[k]]), int(group[g[k]]))
                            if rows.get(key, (0.0, 0.0))[0] < ratio:
                                rows[key] = (ratio, float(cos[a[k], g[k]]))
                # windows that the space does not see, by the rarest words of the items
                text = np.repeat(np.arange(len(size)), size)
                item, start, end = rare_runs(s, col, text, reach)
                if len(item):
                    t = text[start]
                    new = np.array([rows.get((p.first + x, y), (0.0, 0.0))[0] < min_lcs for x, y in zip(t.tolist(), item.tolist(), strict=True)], bool)
                    item, start, end, t = item[new], start[new], end[new], t[new]
                    around = common_lengths(s, item, np.maximum(b[t], end - reach[item] + 1), np.minimum(b[t + 1], start + reach[item]), h, col, share)
                    good = np.flatnonzero(around >= share * lengths[item] - 1e-9)
                    windows: dict[tuple[int, int], int] = {}
                    for item_, start_, end_, t_ in zip(*(x[good].tolist() for x in (item, start, end, t)), strict=True):
                        span = min(int(size[t_]), int(span_of[item_]))
                        stride, most, m = max(1, int(span_of[item_]) // 8), int(size[t_]) - span, int(margin[item_])
                        # the windows of the text's grid, with their margins, that hold the whole run
                        k = max(0, (end_ - int(b[t_]) - span - m + 1 + stride - 1) // stride)
                        while True:
                            lo_ = int(b[t_]) + min(k * stride, most)
                            if lo_ - m > start_:
                                break
                            windows[item_, lo_] = t_
                            if k * stride >= most:
                                break
                            k += 1
                    if windows:
                        item, lo = np.array(list(windows), np.int64).T
                        t = np.array(list(windows.values()), np.int64)
                        hi = lo + np.minimum(size[t], span_of[item])
                        for k, ratio in accepted(t, item, lo, hi):
                            key = (p.first + int(t[k]), int(item[k]))
                            if rows.get(key, (0.0, 0.0))[0] < ratio:
                                v, vector = s.embed[col[lo[k] : hi[k]]].sum(0), of_item[key[1]][1]
                                rows[key] = (ratio, float(v @ vector / max(float(np.linalg.norm(v)), 1e-12)))
                if s.whole:
                    h, b = word_hashes(p, operators=True)
                    text = np.repeat(np.arange(len(b) - 1), np.diff(b))
                    for n, (index, items) in s.whole.items():
                        hit = index.find(sequences(h, n))
                        for j in np.flatnonzero(hit >= 0).tolist():
                            if text[j] == text[j + n - 1]:
                                for item in items[int(hit[j])]:
                                    rows[(p.first + int(text[j]), item)] = (1.0, 1.0)
            keys = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([rows[k][1] for k in keys], pa.float64()), pa.array([rows[k][0] for k in keys], pa.float64()),
                ],
                ["id", "item", "cosine", "lcs"],
            )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None,
    block: int = 4000, min_words: int = 8, min_weight: float = 0.5, min_cosine: float = 0.5, min_lcs: float = 0.75, min_paraphrase: float = 0.6, **fitting: int,
) -> DataFrame:
    """Pairs of a document and a benchmark item found in it: id, item id, cosine, lcs (share of the item's words).

    One row per pair, with its best window. Null and empty texts contain nothing; items of fewer than ``min_words``
    words, which meet by chance, must be there as a whole (words and operators, in order, nothing between). Items with equal texts are all reported. Rows repeated with one
    id are reported once each; null ids are kept. Without items or documents the result is empty. The benchmark is
    searched for in blocks of ``block`` items, so what is broadcast stays bounded.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item int, cosine double, lcs double"
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("text"), answer.alias("answer"))
    out = spark.createDataFrame([], f"{id_col} {id_type}, {item_col} {item_type}, cosine double, lcs double")
    pending: list = []

    def searched(part: list) -> DataFrame:
        space = fit(texts.where("text is not null"), [r["item"] for r in part], [r["text"] for r in part], [(r["answer"] or "").lower() for r in part], **fitting)
        for i, n in enumerate(space.lengths):
            if n < min_words:
                space.classes = [(a, g[g != i], v[g != i]) for a, g, v in space.classes]
        space.classes = [c for c in space.classes if len(c[1])]
        space.least = energies(space)
        gates(space, min(min_lcs, min_paraphrase))
        shorts(space, [r["text"] for r in part], [i for i, n in enumerate(space.lengths) if n < min_words])
        shared = spark.sparkContext.broadcast(space)
        found = texts.mapInArrow(_search(shared, min_weight, min_cosine, min_lcs, min_paraphrase), schema)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(part)], f"item int, {item_col} {item_type}")
        return found.join(F.broadcast(names), "item").select(F.col("id").alias(id_col), item_col, "cosine", "lcs")

    for r in rows.toLocalIterator():
        pending.append(r)
        if len(pending) == block:
            out, pending = out.unionByName(searched(pending)), []
    if pending:
        out = out.unionByName(searched(pending))
    return out
