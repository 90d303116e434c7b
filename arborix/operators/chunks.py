"""Running values over keys of any size: rows are cut by key and order into even chunks, and one row a chunk carries on.

A plain window puts a whole key in one task. Here the rows are ranged by key and order (rows equal in both share a chunk),
the running value is formed inside a chunk, and only each chunk's total goes through the key's own window. Rows with a null
key belong to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborix.session import Scratch

EARLIER = (W.unboundedPreceding, -1)


def chunked(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """The rows with `chunk`, numbered in order; written first, since a range samples its input."""
    return scratch.write(df, "rows").repartitionByRange(*keys, *order).withColumn("chunk", F.spark_partition_id())


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, scratch: Scratch) -> DataFrame:
    """Chunked rows with the largest value of all earlier ones (null for the first)."""
    inside = W.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(*EARLIER)
    local = scratch.write(df.withColumn("_value", value).withColumn("_most", F.max("_value").over(inside)), f"max-{name}")
    carry = F.max("_total").over(W.partitionBy(*keys).orderBy("chunk").rowsBetween(*EARLIER))
    chunks = local.groupBy(*keys, "chunk").agg(F.max("_value").alias("_total")).select(*keys, "chunk", carry.alias("_carried"))
    return local.join(chunks, [*keys, "chunk"]).withColumn(name, F.greatest("_most", "_carried")).drop("_value", "_most", "_carried")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, scratch: Scratch, whole: str | None = None) -> DataFrame:
    """Chunked rows with the sum of the values up to and with each; ``whole`` names the key's sum."""
    inside = W.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = scratch.write(df.withColumn("_value", value).withColumn("_upto", F.sum("_value").over(inside)), f"sum-{name}")
    key = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_total").over(key.orderBy("chunk").rowsBetween(*EARLIER)), F.lit(0))
    more = [F.sum("_total").over(key).alias(whole)] if whole else []
    chunks = local.groupBy(*keys, "chunk").agg(F.sum("_value").alias("_total")).select(*keys, "chunk", before.alias("_base"), *more)
    return local.join(chunks, [*keys, "chunk"]).withColumn(name, F.col("_base") + F.col("_upto")).drop("_value", "_upto", "_base")


def following(df: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    """Chunked rows with the next value of the order, across chunks; the order's values are distinct within a key."""
    inside = W.partitionBy(*keys, "chunk").orderBy(by)
    first = df.groupBy(*keys, "chunk").agg(F.min(by).alias("_f"))
    first = first.select(*keys, "chunk", F.lead("_f").over(W.partitionBy(*keys).orderBy("chunk")).alias("_n"))
    return df.withColumn("_l", F.lead(by).over(inside)).join(first, [*keys, "chunk"]).withColumn(name, F.coalesce("_l", "_n")).drop("_l", "_n")
