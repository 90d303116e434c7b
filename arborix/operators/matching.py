"""Pairwise matches: best partners, degrees, votes, false-discovery correction, connected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborix.functions.scores import TIE
from arborix.operators import chunks
from arborix.session import Scratch


def best_with_ties(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """best_status of each row: best_unique, best_tie or not_best, within a tolerance of 1e-12.

    The best score and the number of rows that have it are aggregated and joined back, so a hub's rows are never one task.
    """
    best = df.groupBy(*group).agg(F.max(score).alias("_best"))
    rows = df.join(best, group, "left").withColumn("_top", F.coalesce(F.abs(F.col("_best") - F.col(score)) < TIE, F.lit(False)))
    n = rows.where("_top").groupBy(*group).agg(F.count("*").alias("_n"))
    return rows.join(n, group, "left").withColumn("best_status", F.when(~F.col("_top"), "not_best").when(F.col("_n") > 1, "best_tie").otherwise("best_unique")).drop("_top", "_best", "_n")


def reciprocal_best(matches: DataFrame, key: str, left: str, right: str, score: str) -> DataFrame:
    """Each match that is the best of both its ends, ends taken without direction, ties kept.

    Both ends become rows once; the best score of an end is aggregated and joined back, and a match counts if it's best at
    two ends.
    """
    ends = matches.select(key, F.col(score).alias("_s"), F.explode(F.array(F.col(left), F.col(right))).alias("_end"))
    top = ends.groupBy("_end").agg(F.max("_s").alias("_m"))
    best = F.coalesce(F.abs(F.col("_m") - F.col("_s")) < TIE, F.lit(False))
    return ends.join(top, "_end").groupBy(key).agg(F.min(best).alias("_all")).where("_all").select(key)


def cumulative(df: DataFrame, keys: list[str], by: str, weight: str, scratch: Scratch) -> DataFrame:
    """Rows with `chunk`, `upto` (the running sum of the weight in order of ``by``) and `whole` (the key's sum).

    The pairs of keys and ``by`` must be distinct; rows with a null key belong to none.
    """
    return chunks.running_sum(chunks.chunked(df, keys, [by], scratch), keys, [by], F.col(weight), "upto", scratch, "whole")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of each key, and `n`: equal values are one row, and a rank is found in its chunk."""
    scratch = Scratch(df.sparkSession, "quantiles")
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    rows = cumulative(counted, keys, "_v", "_k", scratch)
    place = lambda p: (F.col("whole") - 1) * F.lit(p)
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("_k") <= rank), F.col("_v")))
    got = rows.groupBy(*keys).agg(F.max("whole").alias("n"), *[x for n, p in shares.items() for x in (at(F.floor(place(p))).alias(f"_lo_{n}"), at(F.ceil(place(p))).alias(f"_hi_{n}"))])
    pos = lambda p: (F.col("n") - 1) * F.lit(p)
    mixed = lambda n, p: F.when(F.floor(pos(p)) == F.ceil(pos(p)), F.col(f"_lo_{n}")).otherwise((F.ceil(pos(p)) - pos(p)) * F.col(f"_lo_{n}") + (pos(p) - F.floor(pos(p))) * F.col(f"_hi_{n}"))
    return got.select(*keys, *[mixed(n, p).alias(n) for n, p in shares.items()], "n")


def degrees(matches: DataFrame, left: str, right: str) -> DataFrame:
    """Links at each record; a link counts at both its ends."""
    return matches.select(F.explode(F.array(left, right)).alias("occurrence_id")).groupBy("occurrence_id").agg(F.count("*").alias("degree"))


def vote(df: DataFrame, group: list[str], label: str, weight: Column, share: float = 0.9) -> DataFrame:
    """Labels whose summed weight is at least the share of the best label's."""
    sums = df.groupBy(*group, label).agg(F.sum(weight).alias("_w"))
    kept = sums.withColumn("_top", F.max("_w").over(W.partitionBy(*group))).where(F.col("_w") >= share * F.col("_top") - TIE)
    return kept.groupBy(*group).agg(F.array_join(F.sort_array(F.collect_set(label)), ";").alias("labels"), F.round(F.max("_top"), 6).alias("support"))


def bh_adjust(df: DataFrame, tests: list[str], p: str, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg: the running minimum of p * m / rank from the largest p down, within each family of tests.

    Equal p values share a rank, and are one row until the join back, so ties aren't ordered by chance. A family of any
    size is cut into chunks; ranks and minima are carried across them by one row a chunk.
    """
    scratch = Scratch(df.sparkSession, "adjusted")
    counted = df.where(F.col(p).isNotNull()).groupBy(*tests, p).agg(F.count("*").alias("_k"))
    q = cumulative(counted, tests, p, "_k", scratch).withColumn("_v", F.col(p) * F.col("whole") / F.col("upto"))
    down = W.partitionBy(*tests, "chunk").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    q = scratch.write(q.withColumn("_m", F.min("_v").over(down)), "minima")
    later = F.min("_c").over(W.partitionBy(*tests).orderBy("chunk").rowsBetween(1, W.unboundedFollowing))
    ends = q.groupBy(*tests, "chunk").agg(F.min("_v").alias("_c")).select(*tests, "chunk", later.alias("_l"))
    q = q.join(ends, [*tests, "chunk"]).select(*tests, p, F.least(F.lit(1.0), F.col("_m"), F.col("_l")).alias(out))
    return df.join(q, [*tests, p], "left")


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Record and smallest record that it's connected with: labels spread over edges, and each label takes its own label's.

    The second step halves the way to the smallest record, so the rounds grow with the logarithm of a chain's length.
    """
    scratch = Scratch(edges.sparkSession, "connected")
    pairs = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("a"), F.col(right).alias("b"))
    both = scratch.write(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "label0")
    step = 0
    while True:
        mine = label.select(F.col("a").alias("b"), "l")
        near = both.join(mine, "b").groupBy("a").agg(F.min("l").alias("n"))
        spread = label.join(near, "a").select("a", F.least("l", "n").alias("m"), F.col("l").alias("old"))
        jump = spread.join(label.select(F.col("a").alias("m"), F.col("l").alias("j")), "m").select("a", F.least("m", "j").alias("l"), "old")
        now = scratch.write(jump, f"label{step + 1}")
        changed = now.where("l <> old").limit(1).count()
        scratch.drop(f"label{step}")
        label, step = now.select("a", "l"), step + 1
        if not changed:
            return label.select(F.col("a").alias("record"), F.col("l").alias("smallest"))
