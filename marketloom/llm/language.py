"""Language identification: words first, backing off to ever shorter character n-grams.

Training counts every word of every training text by language, then the character n-grams of the counted words. A word is
known if it is seen twice and its share of the words of any one language is high enough; so is an n-gram among those of its
order. With L languages the share is L / ``words`` (L / ``grams``): each language has room for as many frequent keys as any
other, a rare language too, and at most ``words`` words and ``grams`` n-grams of each order can reach it. Both numbers shrink where
there are so many languages that the tables would have more than ``cells`` cells, so what scoring receives has a fixed bound.
Words that are not known are not lost: they back off.

A known word adds its smoothed log frequency in each language. An unseen word backs off: the longest order at which
any of its n-grams is known scores it, by the mean log frequency of those n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, struct_of, written
from .tokens import U, Counter, Index, Piece, mixed, per_text, pieces, ranges, signed, unsigned

ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: np.ndarray
    word_logs: np.ndarray
    grams: np.ndarray
    gram_logs: np.ndarray

    def indexes(self) -> tuple[Index, Index]:
        if not hasattr(self, "_ix"):
            self._ix = (Index(self.words), Index(self.grams))
        return self._ix

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ix"}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n); words of a task are merged up to a bounded backlog."""
    held: dict[str, dict[bytes, int]] = {}
    waiting = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            keys = list(words)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([words[k] for k in part], pa.int64())], ["lang", "word", "n"]
                )
        held.clear()

    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            texts = batch.filter(pa.compute.equal(batch.column(0), lang)).column(1)
            for p in pieces(texts):
                starts, ends, _ = p.words(letters_only=True)
                if not len(starts):
                    continue
                _, at, n = np.unique(ranges(p.sums(), starts, ends), return_index=True, return_counts=True)
                raw, mine = p.data.tobytes(), held.setdefault(lang, {})
                before = len(mine)
                for s, e, k in zip(starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                    w = raw[s:e]
                    mine[w] = mine.get(w, 0) + k
                waiting += len(mine) - before
        if waiting > 250_000:
            yield from flush()
            waiting = 0
    yield from flush()


def _grams_of(p: Piece, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of words, and for each the index of its word."""
    chars = np.flatnonzero((p.data & 0xC0) != 0x80)
    a, b = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    n = np.maximum(b - a - order + 1, 0)
    word = np.repeat(np.arange(len(starts)), n)
    first = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    borders = np.append(chars, len(p.data))
    return mixed(ranges(sums, borders[first], borders[first + order]) + U(order)), word


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) -> (lang, ord, gram, n)."""
    counters: dict[tuple[str, int], Counter] = {}
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            rows = batch.filter(pa.compute.equal(batch.column(0), lang))
            weights = rows.column(2).to_numpy()
            for p in pieces(rows.column(1)):
                sums, w = p.sums(), weights[p.first : p.last]
                starts, ends = p.offsets[:-1], p.offsets[1:]
                for order in ORDERS:
                    keys, word = _grams_of(p, sums, starts, ends, order)
                    if len(keys):
                        counters.setdefault((lang, order), Counter()).add(keys, w[word])
    for (lang, order), c in counters.items():
        k, n = c.merge()
        for i in range(0, len(k), 50_000):
            m = len(k[i : i + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * m), pa.array(np.full(m, order), pa.int32()), pa.array(signed(k[i : i + m])), pa.array(n[i : i + m])], ["lang", "ord", "gram", "n"]
            )


def _frequent(counts: DataFrame, keys: list[str], langs: list[str], least: list[Column]) -> tuple[pa.Table, np.ndarray]:
    """The keys of ``counts`` (keys, lang, n) seen twice or more, and in some language as often as ``least`` says; with their counts by language."""
    by = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    wide = counts.groupBy(*keys).agg(F.sum("n").alias("all"), *by)
    often = F.lit(False)
    for i, x in enumerate(least):
        often = often | (F.col(f"n{i}") >= x)
    got = wide.where(often & (F.col("all") >= 2)).drop("all").toArrow()
    return got.select(keys), np.stack([got.column(f"n{i}").to_numpy() for i in range(len(langs))], 1).astype(np.float32)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = 1 << 20, grams: int = 1 << 17, cells: int = 1 << 24, smooth: float = 0.5) -> Model:
    """A model of all rows with a language; null texts count as empty. With no such row the model knows no language."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.lower(F.col(text_col)).alias("text"))
    counted = written(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros(0), np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)))
    n_l = np.array([totals[x] for x in langs], float)
    share = len(langs) / min(words, max(1, cells // len(langs)))
    known, counts = _frequent(counted, ["word"], langs, [F.lit(share * x) for x in n_l.tolist()])
    names = known.column("word").combine_chunks()
    keys = np.concatenate([ranges(x.sums(), x.offsets[:-1], x.offsets[1:]) for x in pieces(names)]) if len(names) else np.zeros(0, np.uint64)
    word_logs = np.log((counts + smooth) / (n_l + smooth * max(1, len(keys)))).astype(np.float32)
    of_order = written(counted.mapInArrow(_count_grams, "lang string, ord int, gram long, n long").groupBy("ord", "gram", "lang").agg(F.sum("n").alias("n")))
    share = len(langs) / min(grams, max(1, cells // len(langs)))
    sums = {(r["ord"], r["lang"]): r["n"] for r in of_order.groupBy("ord", "lang").agg(F.sum("n").alias("n")).collect()}
    least = []
    for x in langs:
        at = F.lit(float("inf"))
        for k in ORDERS:
            at = F.when(F.col("ord") == k, F.lit(share * sums.get((k, x), 0.0))).otherwise(at)
        # a language without such n-grams has none to know
        least.append(F.greatest(at, F.lit(1.0)))
    kept, gram_counts = _frequent(of_order, ["ord", "gram"], langs, least)
    order = kept.column("ord").to_numpy()
    gram_logs = np.zeros(gram_counts.shape, np.float32)
    for k in set(order.tolist()):
        m = order == k
        gram_logs[m] = np.log((gram_counts[m] + smooth) / (gram_counts[m].sum(0, dtype=float) + smooth * m.sum()))
    return Model(langs, np.log((n_l + 1) / (n_l + 1).sum()), keys, word_logs, unsigned(kept.column("gram").to_numpy()), gram_logs)


def _score_piece(p: Piece, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per text: summed log frequencies by language, and the number of words."""
    words, grams = model.indexes()
    sums = p.sums()
    starts, ends, borders = p.words(letters_only=True)
    scores = np.zeros((len(starts), len(model.langs)), np.float32)
    h = ranges(sums, starts, ends)
    at = words.find(h)
    known = at >= 0
    scores[known] = model.word_logs[at[known]]
    lost = np.flatnonzero(~known)
    if len(lost):
        _, first, inverse = np.unique(h[lost], return_index=True, return_inverse=True)
        s, e = starts[lost[first]], ends[lost[first]]
        own = np.zeros((len(s), len(model.langs)))
        todo = np.arange(len(s))
        for order in ORDERS:
            keys, word = _grams_of(p, sums, s[todo], e[todo], order)
            g = grams.find(keys)
            hit = g >= 0
            n = np.bincount(word[hit], minlength=len(todo))
            for j in range(len(model.langs)):
                total = np.bincount(word[hit], model.gram_logs[g[hit], j], len(todo))
                own[todo, j] = np.where(n > 0, total / np.maximum(n, 1), 0.0)
            todo = todo[n == 0]
            if not len(todo):
                break
        scores[lost] = own[inverse]
    return per_text(scores, borders), np.diff(borders)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced).

    The score is the posterior probability of lang_pred, each text's evidence being tempered by the square root of its
    number of words. A text that is null or has no letter gets ``und`` with score 0; so does every text if the model
    knows no language. Equal texts get equal results; ties go to the first language in order of names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = struct_of(docs, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))
    keep = schema.names[:-2]
    # columns go by place: their names may be those of the helpers
    fed = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.lower(F.col(text_col)).alias("_low"), has_letter(F.col(text_col)).alias("_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n, names = batch.num_rows, np.array([*m.langs, UNKNOWN], object)
            best, score = np.full(n, len(m.langs)), np.zeros(n)
            if m.langs:
                for p in pieces(batch.column(batch.num_columns - 2)):
                    logs, count = _score_piece(p, m)
                    logs = logs / np.sqrt(np.maximum(count, 1))[:, None] + 0.1 * m.prior
                    e = np.exp(logs - logs.max(1, keepdims=True))
                    e /= e.sum(1, keepdims=True)
                    best[p.first : p.last], score[p.first : p.last] = e.argmax(1), e.max(1)
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best[~letter], score[~letter] = len(m.langs), 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return fed.mapInArrow(run, schema)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
