"""Clusters whose members must all be compatible, for groups that no single task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborix.session import Scratch


def greedy_cluster_sizes(rows: DataFrame, group: str) -> DataFrame:
    """group, n_segments, n_clusters and largest of `kernels.chains.greedy_clusters`, by rounds over all groups.

    Rows hold far, total_score, and the ids and owners of both ends (left, right, left_owner, right_owner). Two clusters
    with a cross pair that isn't compatible never fit again, however they grow, so their edge is dropped; of the rest, an
    edge that comes first for both of its clusters is what the ordered pass would take next of either, and is merged. A
    round is a table; the rounds end when no edge is left. Rows with a null group belong to none.
    """
    rows = rows.where(F.col(group).isNotNull()).withColumnRenamed(group, "g")
    scratch = Scratch(rows.sparkSession, "clusters")
    named = rows.select("g", F.explode(F.array("left", "right")).alias("v")).distinct().groupBy("g").agg(F.count("*").alias("n_segments"))
    fit = rows.where((F.col("left") != F.col("right")) & ~F.col("left_owner").eqNullSafe(F.col("right_owner")))
    fit = fit.select("g", F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "far", "total_score")
    order = F.struct("far", (-F.col("total_score")).alias("s"), "a", "b")
    edges = scratch.write(fit.groupBy("g", "a", "b").agg(F.min(order).alias("first"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")), "edges0")
    merged, schema, level = [], None, 0
    while edges.take(1):
        ends = edges.select("g", F.col("a").alias("v"), "first").union(edges.select("g", F.col("b").alias("v"), "first")).groupBy("g", "v").agg(F.min("first").alias("least"))
        both = edges.join(ends.select("g", F.col("v").alias("a"), F.col("least").alias("la")), ["g", "a"]).join(ends.select("g", F.col("v").alias("b"), F.col("least").alias("lb")), ["g", "b"])
        done = scratch.write(both.where((F.col("first") == F.col("la")) & (F.col("first") == F.col("lb"))).select("g", "a", "b", (F.col("na") + F.col("nb")).alias("size")), f"merged{level}")
        schema = done.schema
        merged.append(f"merged{level}")
        to = done.select("g", F.col("a").alias("v"), F.col("a").alias("to"), "size").union(done.select("g", F.col("b").alias("v"), F.col("a").alias("to"), "size"))
        side = lambda c: to.select("g", F.col("v").alias(c), F.col("to").alias(f"to_{c}"), F.col("size").alias(f"size_{c}"))
        new = edges.join(side("a"), ["g", "a"], "left").join(side("b"), ["g", "b"], "left")
        new = new.select("g", F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), F.coalesce("size_a", "na").alias("nx"), F.coalesce("size_b", "nb").alias("ny"), "first", "n").where(F.col("x") != F.col("y"))
        swap = F.col("x") > F.col("y")
        new = new.select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("na"), F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("nb"), "first", "n")
        new = new.groupBy("g", "a", "b").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("na").alias("na"), F.max("nb").alias("nb")).where(F.col("n") == F.col("na") * F.col("nb"))
        edges = scratch.write(new, f"edges{level + 1}")
        scratch.drop(f"edges{level}")
        level += 1
    if schema is None:
        return named.select(F.col("g").alias(group), "n_segments", F.col("n_segments").alias("n_clusters"), F.lit(1).cast("long").alias("largest"))
    found = scratch.read(merged, schema).groupBy("g").agg(F.count("*").alias("merges"), F.max("size").alias("size"))
    out = named.join(found, "g", "left")
    return out.select(F.col("g").alias(group), "n_segments", (F.col("n_segments") - F.coalesce("merges", F.lit(0))).alias("n_clusters"), F.coalesce("size", F.lit(1)).cast("long").alias("largest"))
