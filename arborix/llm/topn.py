"""The N highest-scoring items of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def top_n(df: DataFrame, group: str, item: list[str], score: str, n: int = 5, salts: int = 64) -> DataFrame:
    """The group, item columns and score of the n best items of each group.

    Each group is hashed by item into subgroups; repeated items are aggregated to their highest score inside their
    subgroup (all repeats of an item share it), each subgroup is ranked and keeps n, and the survivors, at most
    n * salts a group, are ranked by score and identifier. A group with a third of all rows is spread over all salts.

    Ties go to the smaller item columns, in their order, so the result is the same at every run. Rows with a null
    group, item column or score, or a NaN score, don't count; a group without other rows isn't in the result.
    Infinite scores rank as numbers. Text orders by code point. Extra columns of any name change nothing.
    """
    keys = [f"_i{j}" for j in range(len(item))]
    rows = df.select(F.col(f"`{group}`").alias("_g"), *[F.col(f"`{c}`").alias(k) for c, k in zip(item, keys)], F.col(f"`{score}`").cast("double").alias("_s"))
    keep = F.col("_g").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s")
    for k in keys:
        keep = keep & F.col(k).isNotNull()
    salted = rows.where(keep).withColumn("_t", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    items = salted.groupBy("_g", "_t", *keys).agg(F.max("_s").alias("_s"))
    order = [F.col("_s").desc(), *[F.col(k).asc() for k in keys]]
    first = items.withColumn("_r", F.row_number().over(W.partitionBy("_g", "_t").orderBy(*order))).where(F.col("_r") <= n)
    last = first.withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy(*order))).where(F.col("_r") <= n)
    return last.select(F.col("_g").alias(group), *[F.col(k).alias(c) for c, k in zip(item, keys)], F.col("_s").alias(score))
