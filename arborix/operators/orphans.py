"""References to records that are absent, withdrawn or arrive later."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from arborix.kernels import bitmaps as B
from arborix.session import UNKNOWN, Scratch

#: The period of rows without a time: before every other, so that they survive to the exact check.
NO_PERIOD = -(2**31)


@dataclass(frozen=True)
class Reference:
    """Columns of one table that name records of the parent table."""

    table_name: str
    rows: DataFrame
    record_key: str
    fields: tuple[str, ...]
    time: str = "loaded_at"


def month(at: Column) -> Column:
    return F.coalesce((F.year(at) * 12 + F.month(at) - 1).cast("int"), F.lit(NO_PERIOD))


def _stacked(refs: list[Reference]) -> DataFrame:
    parts = [
        r.rows.select(
            F.lit(r.table_name).alias("table_name"),
            F.col(f"`{r.record_key}`").cast("string").alias("record_key"),
            F.col(f"`{r.time}`").alias("at"),
            F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("ref")) for f in r.fields])).alias("r"),
        ).select("table_name", "record_key", "at", "r.*")
        for r in refs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("ref").isNotNull() & ~F.col("ref").isin(*UNKNOWN))


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed bitmaps of the events of each batch; keys lie in order, so a range is in few batches."""
    for batch in batches:
        ids, owner = batch.column(0).to_numpy(), batch.column(1)
        sizes = np.diff(owner.offsets.to_numpy())
        parts = [(np.repeat(ids, sizes), B.REFERENCED, owner.flatten().to_numpy())]
        for column, kind in ((batch.column(2), B.ARRIVED), (batch.column(3), B.WITHDRAWN)):
            known = column.is_valid().to_numpy(zero_copy_only=False)
            parts.append((ids[known], kind, column.drop_null().to_numpy()))
        found = B.build(np.concatenate([p[0] for p in parts]), np.concatenate([np.full(len(p[0]), p[1], np.int32) for p in parts]), np.concatenate([p[2] for p in parts]))
        columns = list(zip(*found)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["key_range", "kind", "period", "bits"])


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    found = B.not_present(pdf["kind"].to_numpy(), pdf["period"].to_numpy(), list(pdf["bits"]))
    base = int(pdf["key_range"].iloc[0]) * B.BITS
    if not found:
        return pd.DataFrame({"id": np.empty(0, np.int64), "period": np.empty(0, np.int32)})
    return pd.DataFrame({"id": np.concatenate([base + x for _, x in found]), "period": np.concatenate([np.full(len(x), p, np.int32) for p, x in found])})


def orphans(parents: DataFrame, key: str, refs: list[Reference], loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """References whose parent is absent, or first loaded after, or withdrawn at the reference's own time.

    Keys of both sides are aggregated to one row each and encoded as integers in key order; compressed bitmaps per range
    of 2**15 keys and month hold arrivals, withdrawals and references, built where the keys lie and shuffled once by
    range; reference AND NOT parent, month by month, leaves the candidates, whose bits are decoded and checked against
    the exact times.

    A hot key is one row before any bitmap exists, and its references meet it again only if it survives (AQE splits
    that join). A bitmap is an array, runs or all bits, whichever is smallest: two bytes a key at most.

    Result: table_name, record_key, field_name, ref, at, cause (`missing`, `later` or `withdrawn`); one row for each
    referring row, repeated ones too; a null record_key stays null. No parents: every reference is `missing`; no
    references: no rows. Extra columns of any name change nothing. Null and unknown references aren't references. A null time of the referring row or the parent
    compares as neither later nor withdrawn.
    """
    spark = parents.sparkSession
    scratch = Scratch(spark, "orphans")
    rows = _stacked(refs)
    none, no = F.lit(None).cast("timestamp_ntz"), F.lit(False)
    mine = parents.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("ref"), F.col(f"`{loaded}`").cast("timestamp_ntz").alias("loaded"), F.col(f"`{deleted}`").cast("timestamp_ntz").alias("deleted"), F.lit(True).alias("known"), F.lit(None).cast("int").alias("p"))
    theirs = rows.select("ref", none.alias("loaded"), none.alias("deleted"), no.alias("known"), month(F.col("at")).alias("p"))
    keys = mine.unionByName(theirs).groupBy("ref").agg(F.min("loaded").alias("loaded"), F.min("deleted").alias("deleted"), F.max("known").alias("known"), F.collect_set("p").alias("periods"))
    encoded = scratch.write(keys.repartitionByRange("ref").sortWithinPartitions("ref").withColumn("id", F.monotonically_increasing_id()), "keys")

    at = lambda c: F.when(F.col(c).isNotNull(), month(F.col(c))).alias(c)
    events = encoded.where(F.size("periods") > 0).select("id", "periods", at("loaded"), at("deleted"))
    bits = events.mapInArrow(_containers, "key_range long, kind int, period int, bits binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    left = bits.repartition(tasks, "key_range").groupBy("key_range").applyInPandas(_survivors, "id long, period int")
    candidates = left.join(encoded.drop("periods"), "id").drop("id")
    hit = rows.withColumn("period", month(F.col("at"))).join(candidates, ["ref", "period"])
    cause = F.when(~F.col("known"), "missing").when(F.col("loaded") > F.col("at").cast("timestamp_ntz"), "later").when(F.col("deleted") <= F.col("at").cast("timestamp_ntz"), "withdrawn")
    return hit.select("table_name", "record_key", "field_name", "ref", "at", cause.alias("cause")).where(F.col("cause").isNotNull())
