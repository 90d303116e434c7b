"""The nearest row before or after, by union and window: one shuffle on the keys, no pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, after: bool = False, strict: bool = False, name: str | None = None) -> DataFrame:
    """left with ``value`` of the right row that is nearest before (or after) by its place, of equal places the largest value.

    Null places match nothing. ``strict`` leaves out equal places.
    """
    name = name or value
    a = left.select(*[F.col(f"`{c}`") for c in left.columns], F.col(left_at).alias("_at"), F.lit(1 if (not after) != strict else 0).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0 if (not after) != strict else 1).alias("_side"), F.col(value).alias("_v"), F.lit(True).alias("_r"))
    rows = a.withColumn("_r", F.lit(False)).unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(F.col("_at").desc() if after else F.col("_at").asc(), F.col("_side").desc() if after else F.col("_side").asc(), F.col("_v").asc_nulls_first())
    found = F.last(F.when(F.col("_r"), F.col("_v")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.when(F.col("_at").isNotNull(), found)).where("not _r").drop("_at", "_side", "_v", "_r")
