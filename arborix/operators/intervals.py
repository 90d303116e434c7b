"""Interval operators over closed, 1-based coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborix.session import Scratch

FIRST, BEFORE, HERE = W.unboundedPreceding, -1, W.currentRow


def _apart(start: Column, reach: Column) -> Column:
    """True where a free position lies between ``reach`` and ``start``; no sum can overflow."""
    return F.when(start > reach, start - 1 > reach).otherwise(False)


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", parts: int | None = None) -> DataFrame:
    """Continuous covered periods of each entity and the gaps between them.

    Rows are sorted by start, each start is compared with the running maximum of the earlier ends, islands get
    cumulative labels and are aggregated; a gap is what lies before an island that isn't the entity's first.

    No entity is ever one task: repeated starts are aggregated first, then all rows are cut by entity and start into
    chunks of about equal numbers of rows (``parts``, by default the shuffle partitions), so a dense or a sparse entity
    is spread alike; islands are formed inside a chunk, and only one row a chunk (its reach, its number of islands)
    goes through the entity's own window to carry the running values across.

    Result: the keys, kind (`period` or `gap`), start_pos, end_pos; touching segments belong together.
    Rows with a null key, start or end, or start > end, don't count. No rows give no rows. Repeats and extra columns
    of any name change nothing.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, k)], F.col(f"`{start}`").cast("long").alias("_s"), F.col(f"`{end}`").cast("long").alias("_e"))
    keep = F.col("_s") <= F.col("_e")
    for n in k:
        keep = keep & F.col(n).isNotNull()
    scratch = Scratch(df.sparkSession, "periods")
    starts = scratch.write(rows.where(keep).groupBy(*k, "_s").agg(F.max("_e").alias("_e")), "starts")  # sampled, then ranged
    ranged = starts.repartitionByRange(parts, *k, "_s") if parts else starts.repartitionByRange(*k, "_s")
    chunks = ranged.withColumn("_c", F.spark_partition_id())

    inside = W.partitionBy(*k, "_c").orderBy("_s")
    earlier, upto = inside.rowsBetween(FIRST, BEFORE), inside.rowsBetween(FIRST, HERE)
    reach = F.max("_e").over(earlier)
    local = (
        chunks.withColumn("_new", reach.isNull() | _apart(F.col("_s"), reach))
        .withColumn("_i", F.sum(F.col("_new").cast("long")).over(upto))
        .groupBy(*k, "_c", "_i")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    )
    local = scratch.write(local, "local")  # read four times below
    scratch.drop("starts")
    across = W.partitionBy(*k).orderBy("_c").rowsBetween(FIRST, BEFORE)
    carried = local.groupBy(*k, "_c").agg(F.max("_e").alias("_m")).select(*k, "_c", F.max("_m").over(across).alias("_carry"))
    opened = (
        local.join(carried, [*k, "_c"])
        .withColumn("_p", F.greatest("_carry", F.max("_e").over(earlier)))
        .withColumn("_new", F.col("_p").isNull() | _apart(F.col("_s"), F.col("_p")))
        .withColumn("_n", F.sum(F.col("_new").cast("long")).over(upto))
    )
    counted = opened.groupBy(*k, "_c").agg(F.max("_n").alias("_m")).select(*k, "_c", F.coalesce(F.sum("_m").over(across), F.lit(0)).alias("_base"))
    islands = (
        opened.join(counted, [*k, "_c"])
        .groupBy(*k, (F.col("_base") + F.col("_n")).alias("_label"))
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max(F.when(F.col("_new"), F.col("_p"))).alias("_p"))
    )
    period = F.struct(F.lit("period").alias("kind"), F.col("_s").alias("start_pos"), F.col("_e").alias("end_pos"))
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("_p") + 1).alias("start_pos"), (F.col("_s") - 1).alias("end_pos"))
    both = F.when(F.col("_p").isNull(), F.array(period)).otherwise(F.array(period, gap))
    return islands.select(*k, F.explode(both).alias("_r")).select(*[F.col(n).alias(c) for c, n in zip(keys, k)], "_r.*")
