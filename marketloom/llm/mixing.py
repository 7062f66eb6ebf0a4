"""Mixing sources to target weights by entropy balancing.

Rates w of documents are sought that meet each source's token target, sum(size * w) = target, stay within (0, cap) and
are otherwise as close to the prior rates q as the token-weighted relative entropy of a bounded rate allows:

    minimise  sum size * [ w log(w/q) + (cap-w) log((cap-w)/(cap-q)) ].

Its dual is convex with one multiplier per source; the optimum is the exponentially tilted, bounded rate

    w = cap * e^(t + lambda) / (1 + e^(t + lambda)),   t = log(q / (cap - q)).

Newton's method solves the dual. Every iteration is a Spark aggregation: gradient and curvature of all sources are sums
over the documents (gathered beforehand by source and prior rate, an exact compression), and each source takes a step
bounded by a bisection bracket. Rates are then rounded into copies: each document is taken floor(w) times, and the
fractions are settled in a fixed pseudo-random order, taking documents while the running total of their words stays
nearest to what the fractions are worth. Running totals are built from bucket totals, so a source that holds a third of
all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, shared_dir, written


def with_targets(sizes: DataFrame, cap: float) -> DataFrame:
    """Per source: weights 1, 2, 3, 1, ... in code-point order with null last; targets share all words by weight.

    A target stops at ``cap`` times its source's size and the excess is shared anew by weight. The level at which that
    ends is found in one pass over the sources in order of cap * size / weight.
    """
    w = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.pmod(F.row_number().over(w) - 1, F.lit(3)) + 1)
    s = s.withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.col("open"))
    s = s.withColumn("final", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything))
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("final") * F.col("weight")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def solve(groups: DataFrame, cap: float, tolerance: float = 1e-12, most: int = 60) -> DataFrame:
    """Per source the multiplier of the dual. ``groups``: source, prior, size (words), target."""
    tilt = F.log(F.col("prior") / (F.lit(cap) - F.col("prior")))
    groups = groups.withColumn("tilt", tilt)
    state = groups.groupBy("source").agg(
        F.first("target").alias("target"), F.sum("size").cast("double").alias("total"), F.max("tilt").alias("hi_tilt"), F.min("tilt").alias("lo_tilt")
    )
    goal = F.log(F.greatest(F.col("target") / (F.col("total") * cap), F.lit(1e-300)))
    goal = goal - F.log1p(-F.least(F.col("target") / (F.col("total") * cap), F.lit(1 - 1e-15)))
    inside = (F.col("total") > 0) & (F.col("target") > 0) & (F.col("target") < F.col("total") * cap * (1 - 1e-12))
    state = state.where(inside).select("source", "target", (goal - F.col("hi_tilt")).alias("lo"), (goal - F.col("lo_tilt")).alias("hi"), F.lit(0.0).alias("lam"))
    state = state.withColumn("lam", F.least(F.greatest(F.lit(0.0), F.col("lo")), F.col("hi"))).checkpoint()
    for _ in range(most):
        rate = F.lit(cap) / (1 + F.exp(-(F.col("tilt") + F.col("lam"))))
        sums = (
            groups.drop("target")
            .join(state.withColumnRenamed("source", "key"), F.col("source").eqNullSafe(F.col("key")))
            .groupBy("source")
            .agg(
                F.first("target").alias("target"), F.first("lam").alias("lam"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                F.sum(F.col("size") * rate).alias("got"), F.sum(F.col("size") * rate * (1 - rate / cap)).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.col("slope")
        sums = sums.select("source", "target", lo.alias("lo"), hi.alias("hi"), step.alias("step"), (F.abs(gap) / F.col("target")).alias("off"))
        bounded = F.when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = sums.select("source", "target", "lo", "hi", bounded.alias("lam"), "off").checkpoint()
        worst = state.agg(F.max("off")).first()[0]
        state = state.drop("off")
        if worst is None or worst < tolerance:
            break
    return state.select("source", "lam")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prior_col: str | None = None, cap: float = 3.0, buckets: int = 256, few_sources: int = 10_000) -> DataFrame:
    """Per document: id, size (words), source_size, target, rate, copies, taken (= copies * size).

    Null text has size 0; null sources form one source, weighed last. A document of size 0 takes nothing. Rows repeated
    with one id are rounded one by one. An empty table gives an empty result. ``prior_col`` names positive prior rates
    below ``cap``; 1 otherwise.

    Fractions of rates are settled in the order of u / fraction, u being a fixed number in [0, 1) made of the id: a
    document is taken once more if at least half of it lies within what the source's fractions are worth. Only the
    bucket that holds this boundary is sorted.
    """
    shared_dir(docs.sparkSession)
    prior = F.lit(1.0) if prior_col is None else F.least(F.greatest(F.coalesce(F.col(prior_col).cast("double"), F.lit(1.0)), F.lit(1e-6)), F.lit(cap - 1e-6))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    base = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), prior.alias("prior")))
    groups = base.groupBy("source", "prior").agg(F.sum("size").alias("size")).checkpoint()
    sources = with_targets(groups.groupBy("source").agg(F.sum("size").alias("source_size")), cap).checkpoint()
    goals = groups.join(sources.select(F.col("source").alias("key"), "target"), F.col("source").eqNullSafe(F.col("key"))).select("source", "prior", "size", "target")
    lam = solve(goals, cap)

    known = sources.join(lam.withColumnRenamed("source", "m"), F.col("source").eqNullSafe(F.col("m")), "left")
    known = known.select(F.col("source").alias("key"), "source_size", "target", "lam")
    # few sources are sent to all tasks, so that a source with a third of all rows stays where it is read; many
    # sources are joined by shuffle, whose skewed parts adaptive execution splits
    if sources.count() <= few_sources:
        known = F.broadcast(known)
    tilted = F.lit(cap) / (1 + F.exp(-(F.log(F.col("prior") / (F.lit(cap) - F.col("prior"))) + F.col("lam"))))
    rate = F.when(F.col("lam").isNotNull(), tilted).when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0.0))
    # sizes and rates are known by source and prior; only narrow rows meet them
    rated = base.join(known, F.col("source").eqNullSafe(F.col("key"))).drop("key").withColumn("rate", rate)
    # a rate that differs from a whole number by rounding noise counts as whole
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(2.0**48)
    rated = rated.withColumn("v", F.when(F.col("part") > 0, u / F.col("part")))
    rated = rated.withColumn("bucket", F.least(F.floor(F.col("v") * (buckets // 2)), F.lit(buckets)).cast("int"))

    totals = rated.where(F.col("v").isNotNull()).groupBy("source", "bucket").agg(F.sum("size").alias("b_size"), F.sum(F.col("part") * F.col("size")).alias("b_worth"))
    of = W.partitionBy("source")
    totals = totals.withColumn("before", F.sum("b_size").over(of.orderBy("bucket")) - F.col("b_size")).withColumn("worth", F.sum("b_worth").over(of))
    totals = totals.select(F.col("source").alias("t_source"), F.col("bucket").alias("t_bucket"), "before", "worth", (F.col("before") + F.col("b_size")).alias("through")).checkpoint()
    met = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("bucket") == F.col("t_bucket"))
    placed = rated.join(totals, met, "left").drop("t_source", "t_bucket")
    boundary = (F.col("before") < F.col("worth")) & (F.col("through") > F.col("worth"))
    upto = W.partitionBy("source", "bucket").orderBy("v", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    cut = placed.where(boundary).withColumn("at", F.col("before") + F.sum("size").over(upto) - F.col("size") / 2)
    cut = cut.withColumn("more", F.col("at") <= F.col("worth"))
    rest = placed.where(~F.coalesce(boundary, F.lit(False))).withColumn("more", F.coalesce(F.col("through") <= F.col("worth"), F.lit(False)))
    done = cut.drop("at").unionByName(rest)
    copies = (F.col("whole") + F.col("more").cast("int")).cast("long")
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
