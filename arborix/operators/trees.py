"""Rooted trees as rows: levels, distances, common ancestors, collapse of unary nodes. Paths come from the hierarchy operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from arborix.operators import forest


def ancestry(tree: DataFrame, lengths: DataFrame) -> DataFrame:
    """tree (scope, node, root, depth, path) with `at`: branch lengths summed from the root.

    Where a tree has an unknown or negative length, all its branches count 1; a root's own length counts 0.
    """
    steps = tree.where("depth > 0").select("scope", "root", F.col("node").alias("of"), F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("node"))
    known = lengths.select("scope", "node", "length")
    bad = tree.where("depth > 0").join(known, ["scope", "node"], "left").groupBy("scope", "root").agg(F.max((F.col("length").isNull() | F.isnan("length") | (F.col("length") < 0)).cast("int")).alias("unit"))
    sums = steps.join(known, ["scope", "node"], "left").groupBy("scope", F.col("of").alias("node")).agg(F.sum("length").alias("sum"))
    rows = tree.join(sums, ["scope", "node"], "left").join(bad, ["scope", "root"], "left")
    return rows.select("scope", "node", "root", "depth", "path", F.when(F.col("unit") == 1, F.col("depth").cast("double")).otherwise(F.coalesce("sum", F.lit(0.0))).alias("at"))


def levels(tree: DataFrame) -> DataFrame:
    """Children, leaves below and height of each node, from the paths."""
    parent = F.when(F.col("depth") > 0, F.element_at("path", -2))
    kids = tree.where("depth > 0").groupBy("scope", parent.alias("node")).agg(F.count("*").alias("n_children"))
    rows = tree.join(kids, ["scope", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tips = rows.where("n_children = 0").select("scope", "depth", F.explode("path").alias("node")).groupBy("scope", "node").agg(F.count("*").alias("n_tips"), F.max("depth").alias("deepest"))
    return rows.join(tips, ["scope", "node"]).select("scope", "node", "root", "depth", "n_children", "n_tips", (F.col("deepest") - F.col("depth")).alias("height"))


def common_ancestor(tree: DataFrame, sets: DataFrame, of: list[str]) -> DataFrame:
    """The deepest node above (or equal to) all members of each set of nodes of one tree, and the root's children they reach.

    sets has scope, node and the columns ``of``. A member adds one to each node of its path; those with all members are
    common ancestors.
    """
    members = sets.select("scope", "node", *of).distinct().join(tree, ["scope", "node"])
    n = members.groupBy("scope", "root", *of).agg(F.count("*").alias("n_members"), F.count_distinct(F.get("path", F.lit(1))).alias("root_children"))
    above = members.select("scope", "root", *of, F.posexplode("path").alias("at", "ancestor")).groupBy("scope", "root", *of, "at", "ancestor").agg(F.count("*").alias("k"))
    common = above.join(n, ["scope", "root", *of]).where("k = n_members")
    return common.groupBy("scope", "root", *of).agg(F.max_by("ancestor", "at").alias("mrca"), F.max("at").alias("mrca_depth"), F.first("n_members").alias("n_members"), F.first("root_children").alias("root_children"))


def collapse_unary(tree: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes that stay when those with a single child (roots apart) are taken out: new parent, summed length, merged nodes."""
    level = levels(tree)
    keep = level.where("depth = 0 or n_children <> 1").select("scope", "node")
    kept = tree.join(keep, ["scope", "node"])
    steps = kept.where("depth > 0").select("scope", F.col("node").alias("of"), "depth", F.posexplode("path").alias("at", "node"))
    marked = steps.join(keep.withColumn("k", F.lit(True)), ["scope", "node"], "left").join(lengths.select("scope", "node", "length"), ["scope", "node"], "left")
    order = W.partitionBy("scope", "of")
    cut = F.max(F.when(F.col("k") & (F.col("at") < F.col("depth")), F.col("at"))).over(order)
    rows = marked.withColumn("cut", cut).where("at >= cut")
    return rows.groupBy("scope", F.col("of").alias("node")).agg(
        F.min_by("node", "at").alias("parent"), F.round(F.sum(F.when(F.col("at") > F.col("cut"), F.col("length"))), 9).alias("length"), (F.count("*") - 2).alias("n_merged")
    )


def species_forest(spark, rows: DataFrame, scope, node, parent, length, label) -> tuple[DataFrame, DataFrame]:
    """The hierarchy of tree rows, written once, and lengths and labels of its nodes (the smallest of repeated ones)."""
    tree = forest.Forest(forest.nodes(rows, scope, node, parent), paths=True).tree()
    one = rows.where(node.isNotNull()).groupBy(F.coalesce(scope, F.lit("")).alias("scope"), node.alias("node")).agg(F.min(length).alias("length"), F.min(label).alias("label"))
    return tree, one
