"""Exact Jaccard join of documents' word-shingle sets, as a join in a metric space.

Jaccard distance is a metric, so a pivot p bounds every other distance: |d(x,p) - d(y,p)| <= d(x,y). With links at
d <= eps, the steps are:

1. Equal sets form one class (distance 0); only one set of each class goes on.
2. Cells. Two linked sets share at least one of their first n - ceil(t n) + 1 shingles in hash order, and at least k of
   the first n - ceil(t n) + k. Sets with fewer than k of these known to any other set are alone. Of k shared shingles
   the rarest is not among the k - 1 most frequent of either set's, which are left out. The sets meet in cells of one
   shingle and one band of sizes.
3. Pivots. The most central set of a cell is its pivot; cells with the same pivot are one region, so that every linked
   pair lies in at least one region. All distances to the pivot are computed, row by row, without gathering a region.
   Sets within eps of it are linked to it.
4. Windows. What is still open in a region are pairs with at least one set outside the eps ball. Only those sets, and
   the part of the ball within eps of their distances, go on.
5. Regions with many open sets are divided anew: pivots spread over the region make Voronoi cells, and a set goes to
   its nearest pivot's cell and, as a boundary set, to every cell whose pivot is at most 2 eps farther. Every linked
   pair meets in the cell of either set's nearest pivot. Small regions are joined within a task, exactly; regions that
   pivots cannot divide are cut into slices, and every two slices are joined in a block of at most twice that size.

The links are a spanning part of all links: two sets are connected by them if and only if they are by all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, row_key, shared_dir, small_batches, written
from .tokens import U, mixed, pieces, ranges, signed


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of every text of an array."""
    for p in pieces(texts):
        starts, ends, borders = p.words()
        h = ranges(p.sums(lower=True), starts, ends)
        m = max(0, len(h) - width + 1)
        grams = np.zeros(m, np.uint64)
        for k in range(width):
            grams = mixed(grams * U(3) + h[k : k + m])
        for i in range(len(borders) - 1):
            a, z = borders[i], borders[i + 1]
            if z - a >= width:
                yield p.first + i, np.unique(grams[a : z - width + 1])
            elif z > a:
                whole = np.full(1, z - a, np.uint64)
                for x in h[a:z]:
                    whole = mixed(whole * U(3) + x)
                yield p.first + i, whole
            else:
                yield p.first + i, grams[:0]


def prefix_length(n: int, percent: int) -> int:
    return n + (percent * n) // -100 + 1


def shared_needed(n: int, percent: int) -> int:
    """How many of the prefix shingles must be shared, for sets of n shingles."""
    return max(1, prefix_length(n, percent) // 2)


def _sets(width: int, percent: int, with_heads: bool) -> object:
    """(uid, text, id) -> (uid, heads), or what else is to be known of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, need, one, two, heads = [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), width):
                k = len(s)
                n.append(k)
                least = -((percent * k) // -100)
                need.append(shared_needed(least, percent) if k else 0)
                if with_heads:
                    heads.append(signed(s[: prefix_length(k, percent) - 1 + shared_needed(k, percent)] if k else s))
                    continue
                one.append(int(mixed(s).sum(dtype=np.uint64)) if k else 0)
                two.append(int(np.bitwise_xor.reduce(mixed(s + U(0x632BE59BD9B4E019)))) if k else 0)
            sizes = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            values = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            if with_heads:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(values))], ["uid", "heads"])
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(need, pa.int32()), pa.array(np.array(one, np.uint64).view(np.int64)),
                    pa.array(np.array(two, np.uint64).view(np.int64)), batch.column(2),
                ],
                ["uid", "n", "need", "one", "two", "id"],
            )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [squeeze.compress(x.as_buffer()) if x.is_valid else None for x in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["uid", "packed"])


def _unpacked_sets(packed: pa.Array, width: int) -> list[np.ndarray]:
    loosen = zstandard.ZstdDecompressor()
    out: list[np.ndarray] = []
    for i in range(0, len(packed), 256):
        texts = pa.array([loosen.decompress(x) if x is not None else b"" for x in packed[i : i + 256].to_pylist()], pa.large_binary()).cast(pa.large_string())
        out += [s for _, s in shingle_sets(texts, width)]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _distances(width: int) -> object:
    """(region, uid, pivot, packed of the set, packed of the pivot) -> both sizes' intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivots: dict[int, np.ndarray] = {}
            own = _unpacked_sets(batch.column(3), width)
            names, packed = batch.column(2).to_pylist(), batch.column(4)
            both, union = [], []
            for i, s in enumerate(own):
                if names[i] not in pivots:
                    pivots[names[i]] = _unpacked_sets(packed.slice(i, 1), width)[0]
                x, y = jaccard(s, pivots[names[i]])
                both.append(x)
                union.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["region", "uid", "pivot", "both", "union"])

    return run


def local_links(uids: list[int], sets: list[np.ndarray], group: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect what is linked among some sets. Sets with the same non-zero ``group`` are connected already
    and only met by the others. For each other set, one pass over the places of its shingles counts what it shares
    with every set."""
    n = len(uids)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i in range(n):
        if group[i]:
            parent[root(i)] = root(first.setdefault(group[i], i))
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(code, kind="stable")
    places = owner[by]
    first_at = np.searchsorted(code[by], np.arange(int(code.max()) + 2))
    border = np.concatenate([[0], np.cumsum(size)])
    touched: set[int] = set()
    for i in range(n):
        if group[i]:
            continue
        own = code[border[i] : border[i + 1]]
        lo, m = first_at[own], first_at[own + 1] - first_at[own]
        at = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        both = np.bincount(places[at], minlength=n)
        for j in np.flatnonzero(100 * both >= percent * (size + size[i] - both)).tolist():
            if root(i) != root(j):
                parent[root(i)] = root(j)
                touched |= {i, j}
    # every connected part as a star, so that components need few rounds
    centre: dict[int, int] = {}
    for i in sorted(touched, key=lambda i: uids[i]):
        centre.setdefault(root(i), i)
    return [(uids[i], uids[centre[root(i)]]) for i in touched if centre[root(i)] != i]


def _local(width: int, percent: int) -> object:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("uid")
        sets = _unpacked_sets(pa.array(pdf["packed"].tolist(), pa.binary()), width)
        links = local_links(pdf["uid"].tolist(), sets, pdf["ball"].tolist(), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def components(links: DataFrame) -> DataFrame:
    """(uid, root): the smallest uid connected with each uid of the links (a, b)."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = written(links.where("a <> b").select(ways).select("way.*").distinct())
    label = both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("uid", "b"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("root").alias("near"))
        step = label.join(near, "uid").select("uid", "root", F.least("root", "near").alias("low"))
        # then jump: take the label of the label
        jump = label.select(F.col("uid").alias("low"), F.col("root").alias("far"))
        step = step.join(jump, "low", "left").select("uid", F.least("low", F.coalesce("far", "low")).alias("new"), "root").checkpoint()
        changed = step.where("new <> root").limit(1).count()
        label = step.select("uid", F.col("new").alias("root"))
        if not changed:
            return label


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, local_sets: int = 4000, rounds: int = 3) -> DataFrame:
    """Per row: id, n_shingles, set_id (smallest id with the same set), component_id (smallest id reachable by links).

    Words are runs of anything but the six white-space characters, A-Z lower-cased; a set holds the distinct shingles
    of ``width`` words, or the whole sequence where there are fewer; texts without words have empty sets and are linked
    with nothing. Sets link when 100 * intersection >= percent * union. Rows repeated with one id count once each and
    share their component. Null ids are kept and never name a component unless all ids in it are null. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    eps = 1 - percent / 100
    id_type = docs.schema[id_col].dataType.simpleString()
    # a row is known by a hash of its id and text, alike in every pass; rows equal in both are one in what follows
    base = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("uid"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sets = written(base.mapInArrow(_sets(width, percent, False), f"uid long, n long, need int, one long, two long, id {id_type}"))
    key = ["n", "one", "two"]
    reps = written(sets.where("n > 0").groupBy(*key).agg(F.min("uid").alias("rep"), F.first("need").alias("need")))
    heads = base.select("uid", "text").mapInArrow(_sets(width, percent, True), "uid long, heads array<long>")
    # rows equal in id and text give one
    heads = heads.join(reps.select(F.col("rep").alias("uid")), "uid").groupBy("uid").agg(F.first("heads").alias("heads"))
    heads = written(heads.select(F.col("uid").alias("rep"), "heads"))

    # cells: shingles of the prefixes that another set has too
    prefix = heads.select("rep", F.explode("heads").alias("h"))
    shared = prefix.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    met = prefix.join(shared, "h")
    alive = met.groupBy("rep").agg(F.count("*").alias("k"), F.sum(F.log2("df")).alias("weight"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))
    alive = alive.join(reps.select("rep", "n", "need"), "rep")
    # of what a linked pair shares, its rarest shingle is not among the need - 1 most frequent of either set
    rare = F.transform(F.slice("hs", F.lit(1), F.col("k").cast("int") - F.col("need") + 1), lambda x: x["h"])
    alive = written(alive.where("k >= need").select("rep", "n", "weight", rare.alias("hs")))
    discard(heads)
    band = F.floor(F.log("n") / F.lit(-math.log(percent / 100)) + 1e-9)
    cell = alive.select("rep", "n", "weight", band.alias("b"), F.explode("hs").alias("h")).select("rep", "n", "weight", "h", F.explode(F.array("b", F.col("b") + 1)).alias("b"))
    centre = F.max_by("rep", F.struct(F.col("weight") / F.col("n"), -F.col("rep")))
    centres = cell.groupBy("h", "b").agg(centre.alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size")
    region = written(cell.join(centres, ["h", "b"]).where("rep <> pivot").select("pivot", F.col("rep").alias("uid")).distinct())

    texts = base.select("uid", "text").mapInArrow(_pack, "uid long, packed binary")
    texts = written(texts.join(alive.select(F.col("rep").alias("uid")), "uid").groupBy("uid").agg(F.first("packed").alias("packed")))

    def measured(rows: DataFrame) -> DataFrame:
        """rows (region, uid, pivot) with the distance of uid to pivot."""
        fed = rows.join(texts, "uid").join(texts.select(F.col("uid").alias("pivot"), F.col("packed").alias("pivot_packed")), "pivot")
        out = fed.select("region", "uid", "pivot", "packed", "pivot_packed").mapInArrow(_distances(width), "region long, uid long, pivot long, both long, union long")
        return out.withColumn("d", 1 - F.col("both") / F.col("union")).withColumn("linked", F.col("both") * 100 >= F.col("union") * percent)

    near = written(measured(region.select(F.col("pivot").alias("region"), "uid", "pivot")))
    links = near.where("linked").select(F.col("pivot").alias("a"), F.col("uid").alias("b"))

    def still_open(rows: DataFrame) -> DataFrame:
        """(region, uid, ball): sets outside the ball, and the ball's part within their window."""
        least = rows.where("not linked").groupBy("region").agg(F.min("d").alias("least"), F.count("*").alias("out"))
        # written, so that what is counted by region next is combined before it moves
        rows = written(rows.join(least, "region").where(f"not linked or d >= least - {eps + 1e-9}").select("region", "uid", "linked"))
        many = rows.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
        return rows.join(many, "region").select("region", "uid", F.when(F.col("linked"), F.col("region")).otherwise(-1).alias("home"), "size")

    open_ = written(still_open(near))
    found = [links]
    for _ in range(rounds):
        large = open_.where(F.col("size") > local_sets)
        if not large.limit(1).count():
            break
        # Voronoi: about 16 pivots per region, by the smallest hashes
        chosen = large.withColumn("k", F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("uid"), "uid"))).where("k <= 16").select("region", F.col("uid").alias("pivot"))
        dist = written(measured(large.select("region", "uid").join(chosen, "region").select("region", "uid", "pivot")))
        found.append(dist.where("linked and uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")))
        nearest = dist.groupBy("region", "uid").agg(F.min("d").alias("least"))
        cells = dist.join(nearest, ["region", "uid"]).where(f"d <= least + {2 * eps + 1e-9}")
        cells = cells.join(large.select("region", "uid", "home"), ["region", "uid"])
        cells = cells.select(F.xxhash64("region", "pivot").alias("region"), "uid", "home", "d", "linked")
        sizes = cells.groupBy("region").agg(F.count("*").alias("size"), F.count_if(~F.col("linked")).alias("out"))
        # a division that repeats most sets is none; such a region is dealt in blocks below
        if cells.count() > 1.5 * large.count():
            break
        cells = cells.join(sizes, "region").where("size > 1 and out > 0").select("region", "uid", "home", "size")
        open_ = written(open_.where(F.col("size") <= local_sets).unionByName(cells))
    # a region that is still large is cut into slices of at most about ``local_sets`` sets; every two slices meet in a block
    slices = F.ceil(F.col("size") / local_sets).cast("int")
    mine = F.pmod(F.xxhash64("uid"), slices).cast("int")
    with_each = F.transform(F.sequence(F.lit(0), slices - 1), lambda other: F.least(mine, other) * slices + F.greatest(mine, other))
    open_ = open_.select(F.explode(F.when(slices > 2, with_each).otherwise(F.array(F.lit(0)))).alias("block"), "region", "uid", "home")
    fed = open_.join(texts, "uid").select("region", "block", "uid", "packed", F.when(F.col("home") >= 0, F.col("home") + 1).otherwise(0).alias("ball"))
    found.append(fed.groupBy("region", "block").applyInPandas(_local(width, percent), "a long, b long"))
    all_links = found[0]
    for x in found[1:]:
        all_links = all_links.union(x)
    roots = components(all_links)
    discard(texts)

    placed = sets.join(reps.select(*key, "rep"), key, "left").select("id", "n", F.coalesce("rep", "uid").alias("rep"))
    placed = placed.join(roots.withColumnRenamed("uid", "rep"), "rep", "left").select("id", "n", "rep", F.coalesce("root", "rep").alias("root"))
    rows = placed
    # the smallest id of each set and component, by two aggregations that combine before they move
    names = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    own = rows.groupBy(F.col("rep").alias("s")).agg(F.min("id").alias("set_id"))
    out = rows.join(names, "root").join(own, F.col("rep") == F.col("s"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "set_id", "component_id")
