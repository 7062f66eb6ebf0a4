"""How the sources of each language differ in their terms: wide term vectors, pair contributions, exact integer sums.

Every kept term of a language is pivoted into one array, indexed by the place of the source among the language's sources;
only sources with the term have an entry. Higher-order functions turn the counts of an array into shares and emit the
contribution of every two of its sources; the sums over all terms combine in the tasks before anything moves. Terms with
equal arrays are counted first and emit once.

A contribution f(p, q) also arises where a source lacks the term. Those have no entry, so they are summed apart: for a
term that only source i has, the other's share is that of a count of nothing, q0. With H_i(c) terms that i has c times,

    value(i, j) = sum over c of H_i(c) f(p_i(c), q0_j) + sum over c of H_j(c) f(q0_i, p_j(c)) + (V - n_i - n_j) f(q0_i, q0_j)
                + sum over terms of both of f(p_i, p_j) - f(p_i, q0_j) - f(q0_i, p_j) + f(q0_i, q0_j)

in integers, so no term's contribution is lost or rounded, and the work follows the entries, not terms times sources.

A term is a run of ASCII letters and non-ASCII characters; only A-Z are lower-cased. Terms are told apart by a 64-bit hash
within a batch of documents, and by themselves from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import small_batches, written
from .tokens import BASE, U, mixed, pieces, ranges

SEED = 17
SCALE = 1_000_000_000
#: Above this count the product with SCALE leaves 64 bits, and decimals are used.
LONG_COUNTS = 9_000_000_000


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); a language without terms has no shares, and any divisor serves there."""
    by = F.greatest(total + terms, F.lit(1))
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), by.cast("decimal(20,0)"))
    return F.when(count < LONG_COUNTS, F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), by)).otherwise(wide) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, tf, df) of each batch's documents."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for batch in batches:
        groups = pa.compute.binary_join_element_wise(batch.column(0), batch.column(1), "\n").dictionary_encode()
        group = groups.indices.to_numpy().astype(np.uint64)
        at = np.unique(group, return_index=True)[1]
        for p in pieces(batch.column(2), 1 << 22):
            starts, ends, borders = p.words(letters_only=True)
            h = ranges(p.sums(seed=SEED, lower=True), starts, ends)
            doc = np.repeat(np.arange(p.first, p.last, dtype=np.uint64), np.diff(borders))
            # one entry for each term of a document, then one for each term of a group
            _, one, tf = np.unique(mixed(h + (doc + U(1)) * U(BASE)), return_index=True, return_counts=True)
            own = group[doc[one].astype(np.int64)]
            _, two, back = np.unique(mixed(h[one] + (own + U(1)) * U(BASE)), return_index=True, return_inverse=True)
            a, b = starts[one[two]], ends[one[two]]
            offsets = np.concatenate([[0], np.cumsum(b - a)])
            data = lower[p.data[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]]
            terms = pa.Array.from_buffers(pa.large_string(), len(two), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
            rows = pa.array(at[own[two].astype(np.int64)])
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), terms.cast(pa.string()), pa.array(np.bincount(back, tf, len(two)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(two)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "tf", "df"])


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, tf, df): occurrences, and documents of that language and source with the term. Batches are counted before rows move."""
    small_batches(docs.sparkSession)
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    each = clean.mapInArrow(_counted, "lang string, source string, term string, tf long, df long")
    return each.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    totals = groups.groupBy("lang").agg(F.first("v").alias("v"), F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias("sizes"))
    size = lambda x: F.get("sizes", x["k"])
    shares = F.transform("vector", lambda x: F.struct(x["k"].alias("k"), share(x["tf"], size(x), F.col("v")).alias("p"), share(F.lit(0).cast("long"), size(x), F.col("v")).alias("q0")))
    alike = kept.join(totals, "lang").groupBy("lang", shares.alias("s")).agg(F.count("*").alias("m"))
    # every two entries of an array once; what they contribute both ways is arithmetic on plain columns, which compiles
    two = F.flatten(F.transform("s", lambda a, at: F.transform(F.slice("s", at + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = lambda a, b: excess(F.col(f"{a}.p"), F.col(f"{b}.p")) - excess(F.col(f"{a}.p"), F.col(f"{b}.q0")) - excess(F.col(f"{a}.q0"), F.col(f"{b}.p")) + excess(F.col(f"{a}.q0"), F.col(f"{b}.q0"))
    met = alike.select("lang", "m", F.inline(two)).groupBy("lang", F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(both("a", "b") * F.col("m")).alias("there"), F.sum(both("b", "a") * F.col("m")).alias("back"))
    shared = met.select("lang", F.inline(F.array(F.struct("i", "j", F.col("there").alias("f")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("back").alias("f")))))

    zero = share(F.lit(0).cast("long"), F.col("n"), F.col("v"))
    own = groups.select("lang", F.col("k").alias("i"), zero.alias("a0"), F.col("nonzero").alias("ni"), "v")
    other = groups.select("lang", F.col("k").alias("j"), zero.alias("b0"), F.col("nonzero").alias("nj"))
    none = own.join(other, "lang").where("i != j").select("lang", "i", "j", ((F.col("v") - F.col("ni") - F.col("nj")) * excess(F.col("a0"), F.col("b0"))).alias("f"))

    counts = kept.select("lang", F.inline("vector")).groupBy("lang", "k", "tf").agg(F.count("*").alias("h"))
    having = counts.join(groups.select("lang", "k", "n", "v"), ["lang", "k"]).select("lang", F.col("k").alias("i"), share(F.col("tf"), F.col("n"), F.col("v")).alias("p"), "h")
    lone = having.join(other, "lang").where("i != j").groupBy("lang", "i", "j").agg(F.sum(F.col("h") * excess(F.col("p"), F.col("b0"))).alias("up"), F.sum(F.col("h") * excess(F.col("b0"), F.col("p"))).alias("down"))
    parts = [shared, none, lone.select("lang", "i", "j", F.col("up").alias("f")), lone.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.col("down").alias("f"))]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    name = lambda k, n: groups.select("lang", F.col("k").alias(k), F.col("source").alias(n))
    return summed.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", "item", "value")


def _terms(kept: DataFrame, groups: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """(lang, source, item, value): the ``top`` terms of which a source has more than its language. Ranked within salted parts first, so that no task sorts all terms of one source."""
    each = kept.select("lang", "term", F.col("tf").alias("all"), F.inline("vector")).join(groups, ["lang", "k"])
    p, q = share(F.col("tf"), F.col("n"), F.col("v")), share(F.col("all"), F.col("total"), F.col("v"))
    more = each.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))
    salted = more.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    best = W.partitionBy("lang", "source", "salt").orderBy(F.col("value").desc(), "item")
    return salted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("lang", "source", "item", "value")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    ``pair`` rows hold for each other source of the language how far the source's shares of all kept terms lie from that
    source's; ``term`` rows hold the source's ``top`` terms by distance above the language's share. Null text, language
    and source count as empty; a source without kept terms has pair rows like all. Ties are ranked by item. Repeated rows
    are documents of their own. A source alone in its language has no pair rows, a language without kept terms has pair
    values of 0, an empty table gives no rows. Other columns are ignored.
    """
    occurring = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    places = written(occurring.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1))
    entry = F.struct("k", "tf")
    kept = term_counts(docs, text_col, lang_col, source_col).join(places, ["lang", "source"]).groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("vector"), F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    kept = written(kept.where(F.col("df") >= least_docs).drop("df"))
    of_source = kept.select("lang", F.inline("vector")).groupBy("lang", "k").agg(F.sum("tf").alias("n"), F.count("*").alias("nonzero"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("tf").alias("total"))
    groups = written(places.join(of_source, ["lang", "k"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "nonzero", "v", "total"]))
    found = _pairs(kept, groups).withColumn("part", F.lit("pair")).unionByName(_terms(kept, groups, top).withColumn("part", F.lit("term")))
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
