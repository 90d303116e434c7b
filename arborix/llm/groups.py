"""Pairwise links to groups, by low-diameter decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborix.session import Scratch

#: Rate of the exponential shifts and their largest value; a shift of 3 lets a cluster grow two hops.
RATE, LATEST = 0.5, 3.0


def _start(v: Column) -> Column:
    """Start time of a vertex: LATEST less an exponential shift, from a hash of the vertex and the level's salt."""
    u = (F.shiftrightunsigned(F.xxhash64("salt", v), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(LATEST) + F.greatest(F.log(u) / RATE, F.lit(-LATEST))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("salt", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("salt", "e.*")


def _clusters(edges: DataFrame) -> DataFrame:
    """v, c: each vertex with the centre whose shifted arrival is the earliest.

    A vertex starts as a centre unless another cluster reaches it first. Later than LATEST nothing starts, so two hops
    are exact. The first hop needs no join: the start time is a function of the vertex. The earliest arrival is a number
    and its centre another, so both are aggregated by hash; two centres whose hashes agree in 53 bits may win either way,
    and either is a cluster of linked vertices.
    """
    ways = _both_ways(edges)
    s = _start(F.col("src"))
    seed = ways.select(F.explode(F.array(F.struct(F.col("src").alias("v"), s.alias("t"), F.col("src").alias("c")), F.struct(F.col("dst").alias("v"), (s + 1).alias("t"), F.col("src").alias("c")))).alias("x")).select("x.*")
    best = lambda rows: rows.groupBy("v").agg(F.min("t").alias("t"), F.min_by("c", "t").alias("c"))
    one = best(seed)
    # only arrivals that can still beat a start are passed on
    told = ways.join(one.where(F.col("t") + 1 < LATEST), ways["src"] == F.col("v")).select(F.col("dst").alias("v"), (F.col("t") + 1).alias("t"), "c")
    return best(one.unionByName(told)).select("v", "c")


def groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """member, group_id: each record linked with another, and the smallest record of all it is linked with.

    Vertices are encoded as integers in key order. On each level clusters grow from exponentially shifted start times
    and contract to super-vertices; the edges between clusters go to the next level until none is left, and the
    assignments are composed from the last level back. A level keeps a constant fraction of the vertices, so the levels
    grow with the logarithm of the longest chain.

    Hubs: each hop is aggregated before the shuffle; a hub's row joined to its edges is split by AQE. Every level is a
    table in the shared folder; nothing but emptiness comes to the driver.

    Null ends and links of a record with itself don't count; repeated and exchanged pairs count once. No pairs give no
    rows. Extra columns of any name change nothing.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    x, y = F.col(f"`{left}`"), F.col(f"`{right}`")
    linked = pairs.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    named = scratch.write(linked.select(F.explode(F.array("x", "y")).alias("member")).distinct(), "named")  # sampled, then ranged
    keys = scratch.write(named.repartitionByRange("member").sortWithinPartitions("member").withColumn("id", F.monotonically_increasing_id()), "keys")
    a, b = keys.select(F.col("member").alias("x"), F.col("id").alias("a")), keys.select(F.col("member").alias("y"), F.col("id").alias("b"))
    edges = scratch.write(linked.join(a, "x").join(b, "y").select("a", "b").distinct().withColumn("salt", F.lit(0)), "edges0")
    scratch.drop("named")
    schema = None
    level = 0
    while edges.take(1):
        found = scratch.write(_clusters(edges), f"level{level}")
        schema = found.schema
        ca, cb = found.select(F.col("v").alias("a"), F.col("c").alias("ca")), found.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        rest = edges.join(ca, "a").join(cb, "b").where(F.col("ca") != F.col("cb")).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), (F.col("salt") + 1).alias("salt")).distinct()
        edges = scratch.write(rest, f"edges{level + 1}")
        scratch.drop(f"edges{level}")
        level += 1
    if schema is None:
        return keys.select("member", F.col("member").alias("group_id"))
    whole = scratch.read([f"level{level - 1}"], schema)
    for k in range(level - 2, -1, -1):
        up = whole.select(F.col("v").alias("c"), F.col("c").alias("top"))
        whole = scratch.write(scratch.read([f"level{k}"], schema).join(up, "c", "left").select("v", F.coalesce("top", "c").alias("c")), f"whole{k}")
        scratch.drop(f"whole{k + 1}" if k < level - 2 else f"level{k + 1}")
        scratch.drop(f"level{k}")
    least = whole.groupBy("c").agg(F.min("v").alias("least"))
    top = keys.select(F.col("id").alias("least"), F.col("member").alias("group_id"))
    return whole.join(least.join(top, "least"), "c").join(keys, F.col("v") == F.col("id")).select("member", "group_id")
