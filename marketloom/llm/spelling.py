"""Spelling variants: words one edit apart, found by bands of a bitmask of letter parities.

A word's mask has one bit for every letter of the alphabet, set where the letter occurs an odd number of times. An
inserted or deleted letter flips one bit and a replaced letter two, so of three bands of the mask at least one is equal
in two words one edit apart. Words that agree in a band are joined within equal length (or a length one more), and
verified. The edit also lies in the first or in the second half of the shorter word, so one half is equal; it is part of
the join's key, which keeps the words under one key few however large the vocabulary.

A word's form is its most frequent neighbour, if that is several times as frequent; roots follow forms by pointer doubling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
BANDS = 3


def occurrences(docs: DataFrame, id_col: str, text_col: str, least_length: int, damage: int | None) -> DataFrame:
    """(word): one row for every run of letters of at least ``least_length`` code points, after one code point of one run in ``damage`` is lost."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")).where(F.char_length("run") >= least_length)
    if damage is None:
        return runs.select(F.col("run").alias("word"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)


def bands(word: Column) -> list[Column]:
    """The three bands of the word's parity mask, each an integer. Letters are dealt to the bands in turn, so that each has frequent and rare ones."""
    place = lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26)
    codes = F.transform(F.split(word, ""), place)
    bit = lambda x: F.call_function("shiftleft", F.lit(1), F.call_function("div", x, F.lit(BANDS)).cast("int"))

    def band(k: int) -> Column:
        return F.aggregate(F.filter(codes, lambda x: x % BANDS == k), F.lit(0), lambda acc, x: acc.bitwiseXOR(bit(x)))

    return [band(k) for k in range(BANDS)]


def _keyed(words: DataFrame, longer: int, suffix: str) -> DataFrame:
    """Six rows per word and kind of edit: each band with each half, as one hash. ``longer``: what to take from the length to get that of the shorter word, for insertions."""
    rows = []
    for kind, less in (("=", 0), ("+", longer)):
        length = F.char_length("word") - less
        half = F.call_function("div", length, F.lit(2)).cast("int")
        front, back = F.substring("word", F.lit(1), half), F.call_function("right", F.col("word"), length - half)
        rows += [F.xxhash64(F.lit(kind), length, F.lit(side), part, F.lit(k), F.col(f"b{k}")) for side, part in (("front", front), ("back", back)) for k in range(BANDS)]
    exploded = words.select("word", "n", "b0", "b1", "b2", F.posexplode(F.array(*rows)).alias("slot", "key"))
    return exploded.select("key", "slot", *[F.col(c).alias(c + suffix) for c in ("word", "n", "b0", "b1", "b2")])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each two words (distinct, with their counts) that differ by exactly one inserted, deleted or replaced code point, in both directions."""
    masked = words.select("word", "n", *[b.alias(f"b{k}") for k, b in enumerate(bands(F.col("word")))])
    left, right = _keyed(masked, 0, "_1"), _keyed(masked, 1, "_2")
    flips = sum((F.bit_count(F.col(f"b{k}_1").bitwiseXOR(F.col(f"b{k}_2"))) for k in range(BANDS)), F.lit(0))
    same = F.col("slot") < 2 * BANDS
    lengths = F.char_length("word_2") - F.char_length("word_1")
    # a pair may meet in several bands: it counts in the first that is equal
    band = F.col("slot") % BANDS
    earlier = [(band > k) & (F.col(f"b{k}_1") == F.col(f"b{k}_2")) for k in range(BANDS - 1)]
    half = F.call_function("div", F.char_length("word_1"), F.lit(2)).cast("int")
    front = F.substring("word_1", F.lit(1), half) == F.substring("word_2", F.lit(1), half)
    back = (F.call_function("div", F.col("slot"), F.lit(BANDS)) % 2) == 1
    once = ~(earlier[0] | earlier[1]) & ~(back & front)
    shape = (same & (lengths == 0) & (F.col("word_1") < F.col("word_2")) & (flips == 2)) | (~same & (lengths == 1) & (flips == 1))
    met = left.join(right, ["key", "slot"]).where(shape & once & (F.levenshtein("word_1", "word_2", 1) == 1))
    way = lambda a, b: F.struct(F.col(f"word_{a}").alias("word"), F.col(f"n_{a}").alias("n"), F.col(f"word_{b}").alias("near"), F.col(f"n_{b}").alias("near_n"))
    return met.select(F.inline(F.array(way(1, 2), way(2, 1))))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, factor: int = 5, damage: int | None = None) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are lower-cased (A-Z only) runs of letters of at least ``least_length`` code points that occur ``least_count`` times
    or more. ``form`` is the near word of largest n (of equal ones the first in code-point order) if that is at least
    ``factor`` times the word's own, else null; ``root`` follows forms to the last. ``damage``: one run in so many, by a
    checksum of id and run, loses a code point before it is counted (for measuring; a null id counts as empty there).
    Null and empty texts have no words; repeated rows count like all; an empty table gives no rows; other columns are
    ignored.
    """
    counted = occurrences(docs, id_col, text_col, least_length, damage).groupBy("word").agg(F.count("*").alias("n"))
    words = written(counted.where(F.col("n") >= least_count))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best"))
    formed = written(formed.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    # each step multiplies n by the factor, which bounds the steps to a root; every doubling follows twice as many
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(max(most / least_count, 1), factor)) + 1
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        nexts = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = written(links.join(nexts, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
