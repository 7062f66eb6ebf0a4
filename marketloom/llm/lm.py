"""Language-model scoring with a weighted backoff automaton.

Tokens are the words of a text, A-Z lower-cased, then one end token. Training counts them all, and all n-grams; an n-gram
seen ``least`` times or more is kept, whatever the size of the corpus.

Probabilities are absolutely discounted and back off to the next shorter history; a state's failure arc carries the
backoff weight that makes its distribution sum to one. The shortest history has the additive unigram estimate over all
training tokens and one unseen token. The vocabulary is not cut.

Arcs and backoff weights are computed by joins and stay in a Spark table. As every shorter part of a kept n-gram is kept
as well, the log probability of a token is a sum over the n-grams that end at it or before it: what each adds to the next
shorter estimate, and its backoff weight. The n-grams with a share of all training tokens of ``head_share`` or more, at
most 1 / share of each order, are broadcast as an automaton. What it does not have is asked of the table, by order.

Counting and asking move packed blocks, not rows: a task's distinct n-grams of about a million tokens, sorted, dealt by
ranges of their hashed keys. A frequent n-gram is one entry of a block, however often it occurs. The number of ranges
grows with the tokens, so that what meets in one range is bounded.

Scoring reads each text from left to right once. A position's state is the longest broadcast n-gram that ends there; it is
carried from the position before: the state of length k at a position is the arc of the state of length k-1 before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, numbered, small_batches, written
from .packed import by_range, pack, range_count, steps, unpack
from .tokens import Counter, Index, Piece, mixed, per_text, pieces, ranges, signed, unsigned

#: The key of the end token. Word keys come from a 64-bit mixer; this one is reserved.
END = np.uint64(0x5851F42D4C957F2D)
#: Bigram and trigram keys are drawn apart by these.
SALTS = {2: np.uint64(0xA24BAED4963EE407), 3: np.uint64(0x9FB21C651E98DF25)}
#: Texts are hashed in parts of so many bytes, whose sums of eight times that size stay in a core's cache.
CACHED = 1 << 17
#: Tokens whose n-grams a task counts at once, and bits of a word's number among them and 2^20 common words.
STRETCH = 1_000_000
CODE = np.uint64(21)
_kept = partial(written, tidy=True)


@dataclass
class Level:
    """The broadcast n-grams of one order: state before, word, log10 probability, log10 backoff weight, and what each adds to a text's score."""

    before: np.ndarray
    word: np.ndarray
    log_p: np.ndarray
    log_back: np.ndarray
    gain: np.ndarray
    index: Index


@dataclass
class Automaton:
    total: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    index: Index
    spoken: int
    levels: list[Level]
    word_back: np.ndarray
    #: whether all words, and whether all kept n-grams are broadcast
    spelled: bool
    whole: bool

    def unigram_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    @cached_property
    def adds(self) -> list[np.ndarray]:
        """What each word adds to base and score, then what the n-grams of each order add to the score; at the end (place -1) that of none."""
        base = self.unigram_log(np.append(self.counts, 0))
        return [base, base + np.append(self.word_back, 0.0), *[np.append(level.gain, 0.0) for level in self.levels]]


def arc(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an arc: state number and word number as one integer."""
    return mixed((before.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))


def token_keys(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of a piece, each text followed by its end token, and the texts' borders."""
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in p.split(CACHED):
        starts, ends, borders = part.words()
        keys.append(np.insert(ranges(part.sums(lower=True), starts, ends), borders[1:], END))
        sizes.append(np.diff(borders) + 1)
    return np.concatenate(keys), np.cumsum(np.concatenate(sizes))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = Counter()
    for batch in batches:
        for p in pieces(batch.column(0)):
            c.add(token_keys(p)[0])
    k, n = c.merge()
    for i in range(0, len(k), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(signed(k[i : i + 100_000])), pa.array(n[i : i + 100_000])], ["w", "n"])


def carried(a: Automaton, keys: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word numbers (-1: not in the automaton's word table) and, by order from 2 on, the n-gram that ends at each place (-1: none kept)."""
    word = a.index.find(keys)
    first = np.zeros(len(keys), bool)
    first[borders[:-1]] = True
    state = np.where(word < a.spoken, word, -1)
    found = []
    for level in a.levels:
        before = np.empty_like(state)
        before[0:1], before[1:] = -1, state[:-1]
        before[first] = -1
        ok = np.flatnonzero((before >= 0) & (word >= 0) & (word < a.spoken))
        state = np.full(len(keys), -1, np.int64)
        state[ok] = level.index.find(arc(before[ok], word[ok]))
        found.append(state)
    return word, found


def keyed(order: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their two parts: words for bigrams, first and last bigram for trigrams."""
    return mixed(mixed(a ^ SALTS[order]) + b)


def grams(order: int, keys: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By order from 2 on: the places where n-grams end, and the keys of both parts."""
    lead = leads(borders)
    own = keys
    for k in range(2, order + 1):
        at = np.flatnonzero(lead >= k - 1)
        yield k, at, own[at - 1], own[at]
        own, parts = np.zeros(len(keys), np.uint64), own
        own[at] = keyed(k, parts[at - 1], parts[at])


def leads(borders: np.ndarray) -> np.ndarray:
    """How many tokens of its text stand before each token."""
    return np.arange(borders[-1]) - np.repeat(borders[:-1], np.diff(borders))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All tokens' keys and leads in stretches of at most STRETCH new tokens; two older ones come before those of a text that goes on."""
    keys, lead, held = [], [], 0

    def cut() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k, n = np.concatenate(keys), np.concatenate(lead)
        for i in range(0, len(k), STRETCH):
            j = max(0, i - 2)
            part = n[j : i + STRETCH].copy()
            part[: i - j] = 0
            yield k[j : i + STRETCH], part

    for batch in batches:
        for p in pieces(batch.column(0)):
            k, borders = token_keys(p)
            if keys and held + len(k) > STRETCH:
                yield from cut()
                keys, lead, held = [], [], 0
            keys.append(k)
            lead.append(leads(borders))
            held += len(k)
    if keys:
        yield from cut()


def _pack_grams(order: int, shared: object, count: int) -> object:
    """A task's distinct n-grams of one order with their numbers, as blocks of the ranges of their keys.

    Within a block, a word is its place among the ``shared`` common ones (at most 2^20), or after them among the block's others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        index, n_common = Index(common), np.uint64(len(common))
        for keys, lead in _stretches(batches):
            word = index.find(keys)
            rare = np.flatnonzero(word < 0)
            others, to = np.unique(keys[rare], return_inverse=True)
            word[rare] = len(common) + to
            word, names = word.astype(np.uint64), np.concatenate([common, others])
            at = np.flatnonzero(lead >= order - 1)
            code = np.zeros(len(at), np.uint64)
            for back in range(order - 1, -1, -1):
                code = (code << CODE) | word[at - back]
            code, n = np.unique(code, return_counts=True)
            parts = [(code >> (CODE * np.uint64(i))) & np.uint64((1 << 21) - 1) for i in range(order - 1, -1, -1)]
            rows: tuple[list, list] = [], []
            for r, here in by_range(parted(*[names[x] for x in parts])[2], count):
                own = np.stack([x[here] for x in parts])
                far = own >= n_common
                used, to = np.unique(own[far], return_inverse=True)
                own[far] = n_common + to.astype(np.uint64)
                rows[0].append(r)
                # the first word ascends, but for those numbered anew, which ascend as well
                rows[1].append(pack(steps(own[0]), *own[1:], n[here] - 1, names[used]))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], ["r", "block"])

    return run


def parted(*words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of both parts and of the whole of n-grams given by their words' keys."""
    if len(words) == 2:
        return words[0], words[1], keyed(2, words[0], words[1])
    a, b = keyed(2, words[0], words[1]), keyed(2, words[1], words[2])
    return a, b, keyed(3, a, b)


def _unpack_grams(shared: object, least: float) -> object:
    """The n-grams of one range that all its blocks together have ``least`` times or more."""

    def run(blocks: pa.Table) -> pa.Table:
        common, found = shared.value, []
        for block in blocks.column("block"):
            first, *own, n, others = unpack(block.as_py())
            names = np.concatenate([common, others])
            found.append((*parted(*[names[x] for x in (np.cumsum(first, dtype=np.uint64), *own)]), n.astype(np.int64) + 1))
        a, b, k, n = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(k)
        k = k[by]
        first = np.flatnonzero(changes(k))
        n = np.add.reduceat(n[by], first) if len(first) else n
        first, n = first[n >= least], n[n >= least]
        at = by[first]
        return pa.table({"a": signed(a[at]), "b": signed(b[at]), "n": n, "k": signed(k[first])})

    return run


def _looked_up(df: DataFrame, col: str, table: DataFrame, head: float) -> DataFrame:
    """``df`` with the row of ``table`` whose first column is ``col``; all have one. Rows counted ``head`` times or more (column m), which many may ask for, go to all tasks."""
    key = table.columns[0]
    often = F.broadcast(table.where(F.col("m") >= head))
    near = df.join(often, F.col(col) == F.col(key)).drop(key)
    far = df.join(F.broadcast(table.where(F.col("m") >= head).select(key)), F.col(col) == F.col(key), "left_anti")
    return near.unionByName(far.join(table.where(F.col("m") < head).hint("shuffle_hash"), F.col(col) == F.col(key)).drop(key))


def _backoff(states: DataFrame, key: str, arcs: DataFrame, discount: float) -> DataFrame:
    """``states`` (``key``, n, ...) with back, the log10 backoff weight of each from its kept arcs (a, n, lower)."""
    sums = arcs.groupBy(F.col("a").alias("_a")).agg(F.sum(F.col("n") - discount).alias("_used"), F.sum(F.pow(F.lit(10.0), "lower")).alias("_below"))
    back = F.log10(F.greatest(1 - F.col("_used") / F.col("n"), F.lit(1e-12)) / F.greatest(1 - F.col("_below"), F.lit(1e-12)))
    return states.join(sums.hint("shuffle_hash"), F.col(key) == F.col("_a"), "left").withColumn("back", F.coalesce(back, F.lit(0.0))).drop("_a", "_used", "_below")


def _arcs(arcs: DataFrame, states: DataFrame, key: str, head: float, discount: float) -> DataFrame:
    """``arcs`` (a, n, lower, ...) with log_p, and gain over the shorter estimate with the backoff weight."""
    before = states.select(F.col(key).alias("_k"), F.col("n").alias("m"), "back")
    out = _looked_up(arcs, "a", before, head).withColumn("log_p", F.log10((F.col("n") - discount) / F.col("m")))
    return out.withColumn("gain", F.col("log_p") - F.col("back") - F.col("lower")).drop("m", "back")


def train(
    docs: DataFrame, text_col: str = "text", order: int = 3, word_share: float = 2.0**-20, gram_share: float = 0.0, discount: float = 0.75, least: int = 2, head_share: float = 2.0**-17,
) -> tuple[Automaton, DataFrame]:
    """The automaton of the frequent part, and the table of all words and kept n-grams. ``order`` is 2 or 3.

    Kept is what was seen ``least`` times (or ``gram_share`` of all tokens, if that is more). ``word_share`` and
    ``head_share`` only say which words and n-grams are broadcast.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    tokens = _kept(texts.mapInArrow(_count_tokens, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    unit = total + 0.5 * (distinct + 1)
    kept_from = max(float(least), gram_share * total)
    head = max(kept_from, head_share * total)
    # the words of all broadcast n-grams are broadcast
    word_head = min(max(1.0, word_share * total), head)

    def unigram(n: Column) -> Column:
        return F.log10((n + 0.5) / F.lit(unit))

    frequent = tokens.where(F.col("n") >= word_head).toPandas().sort_values(["n", "w"], ascending=[False, True])
    own = unsigned(frequent["w"].to_numpy(np.int64))
    common = spark.sparkContext.broadcast(own[: 1 << 20])
    count = range_count(2 * total)

    def counted(k: int) -> DataFrame:
        blocks = texts.mapInArrow(_pack_grams(k, common, count), "r int, block binary")
        return _kept(blocks.groupBy("r").applyInArrow(_unpack_grams(common, kept_from), "a long, b long, n long, k long"))

    def named(level: DataFrame, *columns: str) -> DataFrame:
        """Only broadcast n-grams need ``columns`` from here on."""
        return level.withColumns({c: F.when(F.col("n") >= head, F.col(c)) for c in columns})

    # one order after the other, every join once, and no table kept longer than it is read: all this lies on disk
    two = counted(2)
    low = _kept(named(_looked_up(two, "b", tokens.select(F.col("w").alias("_k"), F.col("n").alias("m")), head).withColumn("lower", unigram(F.col("m"))).drop("m"), "b"))
    discard(two)
    words = _kept(_backoff(tokens, "w", low, discount))
    discard(tokens)
    pairs = _kept(named(_arcs(low, words, "w", head, discount).drop("lower"), "a"))
    discard(low)
    levels = []
    if order == 3:
        first, three = pairs, counted(3)
        low = _kept(named(_looked_up(three, "b", first.select(F.col("k").alias("_k"), F.col("n").alias("m"), F.col("log_p").alias("lower")), head).drop("m"), "b"))
        discard(three)
        pairs = _kept(named(_backoff(first, "k", low, discount), "log_p"))
        discard(first)
        levels = [_kept(named(_arcs(low, pairs, "k", head, discount).drop("lower"), "a", "log_p"))]
        discard(low)
    else:
        pairs = pairs.withColumn("back", F.lit(0.0))
    levels = [pairs.withColumn("gain", F.col("gain") + F.col("back")), *levels]
    base = unigram(F.col("n")) - unigram(F.lit(0))
    table = words.where(F.col("n") < word_head).select("w", F.lit(2).alias("ord"), F.lit(1).alias("known"), base.alias("more"), (base + F.col("back")).alias("gain"))
    for k, level in enumerate(levels, 2):
        table = table.unionByName(level.where(F.col("n") < head).select(F.col("k").alias("w"), F.lit(k).alias("ord"), F.lit(0).alias("known"), F.lit(0.0).alias("more"), "gain"))

    rows = words.where(F.col("n") >= word_head).toPandas().sort_values(["n", "w"], ascending=[False, True])
    n = rows["n"].to_numpy(np.int64)
    a = Automaton(total, distinct, own, n, Index(own), int((n >= head).sum()), [], rows["back"].to_numpy(float), word_head <= 1, head <= kept_from)
    states, last = a.index, np.arange(len(own))
    for level in levels:
        rows = level.where(F.col("n") >= head).toPandas()
        before, word = states.find(unsigned(rows["a"].to_numpy(np.int64))), last[states.find(unsigned(rows["b"].to_numpy(np.int64)))]
        back = rows["back"].to_numpy(float) if "back" in rows else np.zeros(len(rows))
        a.levels.append(Level(before, word, rows["log_p"].to_numpy(float), back, rows["gain"].to_numpy(float), Index(arc(before, word))))
        states, last = Index(unsigned(rows["k"].to_numpy(np.int64))), word
    return a, table


@dataclass
class Traversed:
    """The token keys of a piece, its texts' borders among them, and what the automaton has of them."""

    keys: np.ndarray
    borders: np.ndarray
    word: np.ndarray
    found: list[np.ndarray]


def traversed(a: Automaton, p: Piece) -> Traversed:
    keys, borders = token_keys(p)
    return Traversed(keys, borders, *carried(a, keys, borders))


def scores(a: Automaton, x: Traversed) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base and score, as if what is not broadcast were unseen."""
    word, borders = x.word, x.borders
    common = word >= 0
    base, logs = a.adds[0][word], a.adds[1][word]
    for gain, here in zip(a.adds[2:], x.found, strict=True):
        logs += gain[here]
    return np.diff(borders), per_text(common, borders).astype(np.int64), per_text(base, borders), per_text(logs, borders)


def asked(a: Automaton, x: Traversed, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one order that end where the automaton has none, with those of order 2 also the words it does not have: number of the text in the piece, and key."""
    lost, w = [], []
    if order == 2 and not a.spelled:
        lost.append(np.flatnonzero(x.word < 0))
        w.append(x.keys[lost[0]])
    if not a.whole:
        _, at, left, right = next(g for g in grams(order, x.keys, x.borders) if g[0] == order)
        miss = x.found[order - 2][at] < 0
        lost.append(at[miss])
        w.append(keyed(order, left[miss], right[miss]))
    return np.searchsorted(x.borders, np.concatenate(lost), side="right") - 1, np.concatenate(w)


def changes(ascending: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values differs from the one before it."""
    out = np.ones(len(ascending), bool)
    out[1:] = ascending[1:] != ascending[:-1]
    return out


def distinct_pairs(t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a text's number (below 2^31) and a key, by key and then text, with their numbers.

    Two plain sorts take a fraction of one stable sort's time.
    """
    by = np.argsort(w)
    w = w[by]
    new = changes(w)
    code = np.sort((np.cumsum(new) - 1) << 32 | t[by])
    at = np.flatnonzero(changes(code))
    n = np.diff(np.append(at, len(code)))
    return code[at] & ((1 << 32) - 1), w[new][code[at] >> 32], n


def _looked_up_sums(numbers: DataFrame, model: object, table: DataFrame, order: int, count: int) -> DataFrame:
    """Per text: uid, and sums (tokens, known, more, gain) over its words and n-grams of ``order`` outside the automaton that are in the table.

    With order 2 they are added to what the automaton has, so that no pass is needed for that alone; with order 3, where
    tokens is 0, texts that ask for nothing may be absent. Tasks ask in blocks for the n-grams of about a million tokens; a
    block's texts are known by their places. Answers go back by block, with the numbers of its texts.
    """
    shift = np.uint64(count.bit_length() - 1)
    names = ["r", "ask", "texts", "own", "block"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.value

        def sent(uids: list, texts: list, keys: list, sums: list) -> pa.RecordBatch:
            u, t, w = (np.concatenate(x) for x in (uids, texts, keys))
            name = int(signed(mixed(u[:1].view(np.uint64)))[0])
            rows = [(name & (count - 1), name, pack(u.view(np.uint64)), np.concatenate(sums, axis=1).tobytes() if order == 2 else None, None)]
            t, w, n = distinct_pairs(t, w)
            for r, here in by_range(w, count):
                rows.append((r, name, None, None, pack(steps(w[here] >> shift), t[here], n[here] - 1)))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], names)

        held: tuple[list, ...] = ([], [], [], [])
        texts = tokens = 0
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for p in pieces(batch.column(1)):
                here = traversed(a, p)
                t, w = asked(a, here, order)
                if order > 2 and not len(t):
                    continue
                sums = np.array(scores(a, here)) if order == 2 else None
                for x, y in zip(held, (uid[p.first : p.last], t + texts, w, sums), strict=True):
                    x.append(y)
                texts += p.last - p.first
                tokens += len(w)
                if tokens > STRETCH or texts > STRETCH:
                    yield sent(*held)
                    held = ([], [], [], [])
                    texts = tokens = 0
        if held[0]:
            yield sent(*held)

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        r = np.uint64(asks.column("r")[0].as_py() if len(asks) else 0)
        index = Index(unsigned(known.column("w").to_numpy()))
        adds = [known.column(c).to_numpy() for c in ("known", "more", "gain")]
        rows: list = []
        for name, texts, own, block in zip(*(asks.column(c).to_pylist() for c in names[1:]), strict=True):
            if texts is not None:
                rows.append((name, texts, own, None, None, None))
                continue
            w, t, n = unpack(block)
            at = index.find((np.cumsum(w, dtype=np.uint64) << shift) | r)
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                here, to = np.unique(t[hit], return_inverse=True)
                times, at = (n[hit] + 1).astype(np.float64), at[hit]
                words, more, gain = (np.bincount(to, times * x[at], len(here)) for x in adds)
                rows.append((name, None, None, pack(here, words.astype(np.int64)), more.tobytes() if order == 2 else None, gain.tobytes()))
        return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate([*types[1:], pa.binary(), pa.binary()])], [*names[1:], "more", "gain"])

    def gathered(rows: pa.Table) -> pa.Table:
        texts, own = next(x for x in zip(rows.column("texts").to_pylist(), rows.column("own").to_pylist(), strict=True) if x[0] is not None)
        uid = unpack(texts)[0].view(np.int64)
        tokens, *out = np.zeros((4, len(uid))) if own is None else np.frombuffer(own).reshape(4, -1).copy()
        for block, more, gain in zip(rows.column("block").to_pylist(), rows.column("more").to_pylist(), rows.column("gain").to_pylist(), strict=True):
            if block is None:
                continue
            t, n = (x.astype(np.int64) for x in unpack(block))
            if order == 2:
                out[0][t] += n
                out[1][t] += np.frombuffer(more)
            out[2][t] += np.frombuffer(gain)
        return pa.table({"uid": uid, "tokens": tokens.astype(np.int64), "known": out[0].astype(np.int64), "more": out[1], "gain": out[2]})

    asks = numbers.mapInArrow(ask, "r int, ask long, texts binary, own binary, block binary")
    known = table.where(F.col("ord") == order).select(F.col("w").bitwiseAND(count - 1).cast("int").alias("r"), "w", "known", "more", "gain")
    answers = asks.groupBy("r").cogroup(known.groupBy("r")).applyInArrow(answer, "ask long, texts binary, own binary, block binary, more binary, gain binary")
    return answers.groupBy("ask").applyInArrow(gathered, "uid long, tokens long, known long, more double, gain double")


def score(docs: DataFrame, model: tuple[Automaton, DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score (sums of log10 probabilities).

    A null or empty text has its end token only. Rows repeated with one id are scored one by one; a null id is kept. An
    empty table gives an empty result. After training on no text all probabilities are those of one unseen token, 1.
    """
    a, table = model
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(a)
    row = next(c for c in (f"_row{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    fed = numbered(docs, row).select(F.col(row).alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column(1)):
                tokens, known, base, logs = scores(shared.value, traversed(shared.value, p))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, p.last - p.first), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(base), pa.array(logs)], names)

    names = ["uid", "tokens", "known", "more", "gain"]
    texts, parts = fed.select("uid", "text"), fed.select("uid", "id")
    if a.whole and a.spelled:
        parts = parts.unionByName(texts.mapInArrow(run, "uid long, tokens long, known long, more double, gain double"), allowMissingColumns=True)
    else:
        # about seven bytes a token with its space; what the table holds is dealt by the same ranges
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        count = range_count(2 * max(a.total, size // 7))
        for order in range(2, len(a.levels) + 2):
            if order == 2 or not a.whole:
                parts = parts.unionByName(_kept(_looked_up_sums(texts, shared, table, order, count)), allowMissingColumns=True)
    out = parts.groupBy("uid").agg(
        F.max("id").alias(id_col), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("more").alias("base_score"), F.sum("gain").alias("score"),
    )
    return out.select(id_col, "n_tokens", "n_known", F.lit(int(a.total)).cast("long").alias("train_tokens"), "base_score", "score")
