"""Binary characters on a rooted tree with unknown states: completion, coverage, patterns, least changes, likelihood.

The tree is a small table of a declared size (edges: parent, child, length, level); every step is one join and one sum per
level, over patterns of equal columns rather than over single characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

FAR = 1e9


def complete(observed: DataFrame, characters: DataFrame, tips: list[str], key: str) -> DataFrame:
    """A cell for every character and declared tip; what isn't observed is unknown, with the reason.

    The tips are those of the tree, an array of literals that each character explodes; observed cells meet them by an
    equi-join.
    """
    cells = characters.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, tips))).alias("tip"))
    rows = cells.join(observed.select(key, "tip", "state"), [key, "tip"], "left")
    return rows.select(key, "tip", "state", F.when(F.col("state").isNull(), "no_observation").otherwise("called").alias("reason"))


def scopes(cells: DataFrame, key: str) -> DataFrame:
    """Called and unknown tips of each character."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    s = F.col("state")
    rows = cells.groupBy(key).agg(F.count("*").alias("panel"), n(s == 0).alias("n0"), n(s == 1).alias("n1"), n(s.isNull()).alias("n_unknown"))
    share = (F.col("n0") + F.col("n1")) / F.col("panel")
    kind = F.when(F.col("n0") + F.col("n1") == 0, "all_missing").when((F.col("n0") == 0) | (F.col("n1") == 0), "no_observed_contrast").otherwise("observed_contrast")
    return rows.select("*", F.round(share, 6).alias("callable_fraction"), kind.alias("pattern_class"))


def patterns(cells: DataFrame, key: str) -> DataFrame:
    """key, pattern: the states of all tips in order as text, `?` unknown. Equal patterns are computed once."""
    letter = F.coalesce(F.col("state").cast("int").cast("string"), F.lit("?"))
    return cells.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tip", letter.alias("s")))), lambda x: x["s"]), "").alias("pattern"))


def tip_states(found: DataFrame, tips: list[str]) -> DataFrame:
    """pattern, node, state of each distinct pattern and tip."""
    rows = found.select("pattern").distinct().select("pattern", F.posexplode(F.split("pattern", "")).alias("i", "s")).where("s <> ''")
    names = F.array(*[F.lit(t) for t in tips])
    return rows.select("pattern", F.get(names, F.col("i")).alias("node"), F.when(F.col("s") != "?", F.col("s").cast("int")).alias("state"))


def fold_up(values: DataFrame, edges: DataFrame, levels: list[int], message: list[Column], start: list[Column]) -> DataFrame:
    """Values of all nodes from the tips up.

    values: pattern, node, v0, v1 of the tips. ``message`` gives what a child sends from its v0, v1 (and the edge's
    length); a parent's values are the sums. Returns pattern, node, v0, v1 of every node.
    """
    done = values
    last = values
    for level in levels:
        up = F.broadcast(edges.where(F.col("level") == level).select("child", "parent", "length"))
        sent = last.join(up, last["node"] == up["child"]).select("pattern", F.col("parent").alias("node"), message[0].alias("m0"), message[1].alias("m1"))
        last = sent.groupBy("pattern", "node").agg(F.sum("m0").alias("v0"), F.sum("m1").alias("v1"))
        done = done.unionByName(last)
    return done


def parsimony_messages() -> list[Column]:
    """Least changes below an edge if the parent has state 0, and 1."""
    c = F.col
    return [F.least(c("v0"), c("v1") + 1), F.least(c("v1"), c("v0") + 1)]


def transition(gain: float, loss: float, length: Column) -> tuple[Column, Column]:
    """Probabilities of 0 to 1 and of 1 to 0 along a branch; expm1 keeps short branches exact."""
    total = gain + loss
    moved = -F.expm1(-total * length)
    return gain / total * moved, loss / total * moved


def likelihood_messages(gain: float, loss: float) -> list[Column]:
    """log of the sum over the child's states, by the larger term first; v0, v1 are logs."""
    p01, p10 = transition(gain, loss, F.col("length"))

    def both(a: Column, b: Column) -> Column:
        hi, lo = F.greatest(a, b), F.least(a, b)
        return hi + F.log1p(F.exp(lo - hi))

    v0, v1 = F.col("v0"), F.col("v1")
    return [both(F.log(1 - p01) + v0, F.log(p01) + v1), both(F.log(p10) + v0, F.log(1 - p10) + v1)]


def root_log_likelihood(gain: float, loss: float, v0: Column, v1: Column) -> Column:
    """The root's states weighted by the stationary distribution."""
    a, b = math.log(loss / (gain + loss)) + v0, math.log(gain / (gain + loss)) + v1
    hi, lo = F.greatest(a, b), F.least(a, b)
    return hi + F.log1p(F.exp(lo - hi))
