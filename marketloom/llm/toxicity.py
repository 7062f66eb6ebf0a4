"""Toxicity by weak supervision.

1. Lexicon and pattern keys. Words and word beginnings (4 to 7 characters) are counted over all labelled training
   texts; those that are far more frequent in texts labelled toxic become keys, strongest first, up to a fixed number.
2. Voters. The keys are dealt to voters in order of strength; a voter fires on a text that holds one of its keys, and
   one more voter fires on any two different keys.
3. Generative label model. The firing patterns of all training texts, labelled or not, are counted. Expectation
   maximisation finds each voter's accuracy under either latent label, starting from the labelled texts. Voters whose
   firings are still correlated within a latent label are then put in blocks, whose joint firing is modelled instead of
   each alone, and the model is fitted again. A pattern's posterior becomes the label of its texts.
4. Linear classifier. Logistic regression on the keys a text holds, trained on the posterior labels of a bounded sample
   of training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, struct_of
from .tokens import Counter, Index, Piece, mixed, pieces, ranges, signed, unsigned

WORD_KIND, KINDS = 0, (0, 4, 5, 6, 7)


@dataclass
class Keys:
    """Key hashes (with their kind mixed in), the voter of each, and the number of voters."""

    hashes: np.ndarray
    voter: np.ndarray
    voters: int

    def find(self, h: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_index"):
            self._index = Index(self.hashes)
        return self._index.find(h)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_index"}


@dataclass
class Model:
    keys: Keys
    weights: np.ndarray
    bias: float
    repeat: float


def text_keys(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key hash) of a piece: its words, and the beginnings of its longer words."""
    sums = p.sums()
    starts, ends, borders = p.words(letters_only=True)
    text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    # work on the distinct words of each text
    h = ranges(sums, starts, ends)
    by = np.lexsort((h, text))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (text[by][1:] != text[by][:-1])
    one = by[new]
    starts, ends, text, h = starts[one], ends[one], text[one], h[one]
    chars = np.append(np.flatnonzero((p.data & 0xC0) != 0x80), len(p.data))
    a, b = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    texts, keys = [text], [mixed(h + np.uint64(WORD_KIND))]
    for k in KINDS[1:]:
        long = np.flatnonzero(b - a >= k)
        g = mixed(ranges(sums, starts[long], chars[a[long] + k]) + np.uint64(k))
        by = np.lexsort((g, text[long]))
        new = np.ones(len(by), bool)
        new[1:] = (g[by][1:] != g[by][:-1]) | (text[long][by][1:] != text[long][by][:-1])
        texts.append(text[long][by][new])
        keys.append(g[by][new])
    return np.concatenate(texts), np.concatenate(keys)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (key, toxic, n texts)."""
    counters = {0: Counter(), 1: Counter()}
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for p in pieces(batch.column(0)):
            text, key = text_keys(p)
            y = toxic[p.first : p.last][text]
            for c in (0, 1):
                counters[c].add(key[y == c])
    for c, counter in counters.items():
        k, n = counter.merge()
        for i in range(0, len(k), 100_000):
            m = len(k[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[i : i + m])), pa.array(np.full(m, c), pa.int32()), pa.array(n[i : i + m])], ["key", "toxic", "n"])


def fired(p: Piece, keys: Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' firing patterns (bits), and the (text, key number) pairs."""
    text, key = text_keys(p)
    at = keys.find(key)
    hit = at >= 0
    text, at = text[hit], at[hit]
    n = len(p.offsets) - 1
    bits = np.zeros(n, np.int64)
    np.bitwise_or.at(bits, text, np.int64(1) << keys.voter[at])
    # the strong voter: two different keys
    many = np.bincount(text, minlength=n) >= 2
    bits |= many.astype(np.int64) << keys.voters
    return bits, text, at


def _patterns(shared, with_keys: bool) -> object:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches:
            bits, lists = [], []
            for p in pieces(batch.column(0)):
                b, text, at = fired(p, keys)
                bits.append(b)
                if with_keys:
                    by = np.argsort(text, kind="stable")
                    cut = np.searchsorted(text[by], np.arange(len(b) + 1))
                    lists += [at[by][cut[i] : cut[i + 1]].tolist() for i in range(len(b))]
            all_bits = np.concatenate(bits) if bits else np.zeros(0, np.int64)
            if with_keys:
                yield pa.RecordBatch.from_arrays([pa.array(all_bits), pa.array(lists, pa.list_(pa.int32()))], ["bits", "keys"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(all_bits), batch.column(1)], ["bits", "id"])

    return run


def label_model(bits: np.ndarray, n: np.ndarray, known: np.ndarray, voters: int, turns: int = 50) -> np.ndarray:
    """Posterior probability of label 1 for each pattern.

    ``n``: texts with the pattern; ``known``: of them labelled 0 and labelled 1 (columns).
    """
    votes = (bits[:, None] >> np.arange(voters)) & 1
    prior = (known[:, 1].sum() + 1) / (known.sum() + 2)
    post = (known[:, 1] + prior) / (known.sum(1) + 1)

    def fit(blocks: list[list[int]], post: np.ndarray) -> np.ndarray:
        codes = [np.unique(votes[:, b], axis=0, return_inverse=True)[1] for b in blocks]
        labelled = known.sum(1)
        # unlabelled texts weigh no more than labelled ones, or they would redefine what is labelled
        rest = (n - labelled) * min(1.0, 0.5 * labelled.sum() / max((n - labelled).sum(), 1.0))
        for _ in range(turns):
            # labelled texts keep their label; the others count by their posterior
            ones = known[:, 1] + rest * post
            zeros = known[:, 0] + rest * (1 - post)
            share = (ones.sum() + 1) / (ones.sum() + zeros.sum() + 2)
            odds = np.full(len(bits), np.log(share / (1 - share)))
            for c in codes:
                m = c.max() + 1
                p1 = (np.bincount(c, ones, m) + 0.1) / (ones.sum() + 0.1 * m)
                p0 = (np.bincount(c, zeros, m) + 0.1) / (zeros.sum() + 0.1 * m)
                odds += np.log(p1[c] / p0[c])
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return new

    post = fit([[j] for j in range(voters)], post)
    # correlations that the latent label leaves unexplained: the strongest pairs share a block, of three at most
    left = np.zeros((voters, voters))
    for w in (n * post, n * (1 - post)):
        total = max(w.sum(), 1e-9)
        mean = w @ votes / total
        cov = (votes * w[:, None]).T @ votes / total - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        left = np.maximum(left, np.abs(cov / np.outer(sd, sd)))
    home = {j: [j] for j in range(voters)}
    pairs = sorted(((left[a, b], a, b) for a in range(voters) for b in range(a)), reverse=True)
    for strength, a, b in pairs:
        if strength > 0.2 and home[a] is not home[b] and len(home[a]) + len(home[b]) <= 3:
            home[a].extend(home[b])
            for k in home[b]:
                home[k] = home[a]
    blocks = list({id(x): x for x in home.values()}.values())
    return fit(blocks, post)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_keys: int = 2000, voters: int = 16, min_texts: int = 5, min_share: float = 0.6, min_deviation: float = 6.0, fit_rows: int = 40_000) -> Model:
    """A model of all rows of ``docs``. Those without a label 0 or 1 in ``labels`` are unlabelled; of several labels of
    one id the largest counts. ``fit_rows`` bounds the sample of the linear classifier (chosen by hash of id and text),
    ``max_keys`` the lexicon.

    Texts move once, to meet their labels; the same join is asked for at every size, so that the plan does not change
    with it. Firing patterns meet labels as narrow rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")).hint("merge")
    totals = {r["toxic"]: r["n"] for r in rows.select("id").join(known, "id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0, everything = totals.get(1, 0), totals.get(0, 0), rows.count()
    counts = rows.join(known, "id").select("text", "toxic").mapInArrow(_count, "key long, toxic int, n long")
    counts = counts.groupBy("key").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    # keys whose share of toxic texts is high, and higher than chance by many standard deviations
    both, rate = F.col("a") + F.col("b"), max(n1, 1) / max(n1 + n0, 1)
    deviation = (F.col("a") - both * rate) / F.sqrt(both * rate * (1 - rate) + 1e-9)
    strength = F.log((F.col("a") + 0.5) / (F.col("b") + 0.5)) - F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    strong = counts.where((F.col("a") >= min_texts) & ((F.col("a") + 0.5) / (both + 1) >= min_share) & (deviation >= min_deviation)).withColumn("strength", strength)
    chosen = strong.orderBy(F.desc("strength"), F.desc("a"), "key").limit(max_keys).collect()
    keys = Keys(unsigned(np.array([r["key"] for r in chosen], np.int64)), np.arange(len(chosen)) * voters // max(len(chosen), 1), voters)
    shared = spark.sparkContext.broadcast(keys)
    id_type = rows.schema["id"].dataType.simpleString()
    # at most 2 ** (voters + 1) patterns
    seen = rows.select("text", "id").mapInArrow(_patterns(shared, False), f"bits long, id {id_type}").join(known, "id", "left")
    one = lambda c: F.count_if(F.col("toxic") == c)
    table = seen.groupBy("bits").agg(F.count("*").alias("n"), one(0).alias("zero"), one(1).alias("one")).collect()
    bits = np.array([r["bits"] for r in table], np.int64)
    if not len(bits) or not n1:
        return Model(keys, np.zeros(len(chosen)), -4.0, 0.0)
    post = label_model(bits, np.array([r["n"] for r in table], float), np.array([[r["zero"], r["one"]] for r in table], float), voters + 1)
    label = dict(zip(bits.tolist(), post.tolist(), strict=True))

    # the linear classifier, on a bounded sample of rows; equal texts with different ids come in one by one
    share = min(1.0, fit_rows / max(everything, 1))
    sample = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(53)), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = sample.select("text").mapInArrow(_patterns(shared, True), "bits long, keys array<int>").toPandas()
    y = np.array([label.get(b, 0.0) for b in got["bits"]])
    k = got["keys"].map(len).to_numpy()
    row, col = np.repeat(np.arange(len(got)), k), np.concatenate([np.asarray(x, int) for x in got["keys"]]) if len(got) else np.zeros(0, int)
    w, bias, repeat = fit_linear(row, col, np.log1p(k), y, len(chosen))
    return Model(keys, w, bias, repeat)


def fit_linear(row: np.ndarray, col: np.ndarray, many: np.ndarray, y: np.ndarray, size: int, turns: int = 800, decay: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Logistic regression on soft labels: weights of the keys (not negative), bias, and weight of their number.
    Gradient steps scaled by running moments."""
    theta = np.zeros(size + 2)
    theta[size] = -2.0
    first, second = np.zeros(size + 2), np.zeros(size + 2)
    n = max(len(y), 1)
    for turn in range(1, turns + 1):
        z = theta[size] + theta[size + 1] * many + np.bincount(row, theta[:size][col], len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.concatenate([np.bincount(col, g[row], size) + decay * theta[:size] / n * 100, [g.sum(), g @ many]])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= 0.05 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-9)
        theta[:size] = np.maximum(theta[:size], 0)
    return theta[:size], float(theta[size]), float(theta[size + 1])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1; columns of that name are replaced).

    Only the text matters; null and empty texts get the score of a text without keys. Equal texts get equal scores.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = struct_of(docs, T.StructField("score", T.DoubleType()))
    keep = schema.names[:-1]
    # columns go by place: their names may be those of the helpers
    fed = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.lower(F.col(text_col)).alias("_low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for p in pieces(batch.column(batch.num_columns - 1)):
                text, key = text_keys(p)
                at = m.keys.find(key)
                hit = at >= 0
                n = len(p.offsets) - 1
                many = np.log1p(np.bincount(text[hit], minlength=n))
                z = m.bias + m.repeat * many + np.bincount(text[hit], m.weights[at[hit]], n)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out))], names=[*keep, "score"])

    return fed.mapInArrow(run, schema)
