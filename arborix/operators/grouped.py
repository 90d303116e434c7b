"""Kernels by group. A group goes to one task only below a declared size; beyond it the answer is a refusal, not a part."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Rows of a group that a kernel may take at once.
LARGEST = 20_000


def by_group(df: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], dict], fields: str, largest: int = LARGEST) -> DataFrame:
    """keys, status and the kernel's fields of each group; `budget` and nulls where a group is too large.

    Group sizes are counted before any group is gathered, so an oversized one never reaches a task. Groups lie sorted in
    their partition and are cut from its batches, many small ones at a time. Rows with a null key belong to no group.
    """
    df = df.dropna(subset=keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    small = df.join(sizes.where(F.col("_size") <= largest).drop("_size"), keys, "left_semi")
    types = {f.name: f.dataType for f in df.schema}
    head = ", ".join(f"`{k}` {types[k].simpleString()}" for k in keys)
    names = [x.split()[0] for x in fields.split(", ")]

    def rows(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        out = [[*(pdf[k].iloc[lo] for k in keys), "complete", *(got[n] for n in names)] for lo, hi in zip(cuts[:-1], cuts[1:]) for got in [kernel(pdf.iloc[lo:hi])]]
        return pd.DataFrame(out, columns=[*keys, "status", *names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the last group, which may go on in the next batch
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            cuts = np.flatnonzero(new)
            held = pdf.iloc[cuts[-1] :].reset_index(drop=True)
            if len(cuts) > 1:
                yield rows(pdf, cuts)
        if held is not None and len(held):
            yield rows(held, np.array([0, len(held)]))

    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ordered = small.repartition(parts, *keys).sortWithinPartitions(*keys)
    done = ordered.mapInPandas(run, f"{head}, status string, {fields}")
    kinds = {f.name: f.dataType for f in done.schema}
    refused = sizes.where(F.col("_size") > largest).select(*keys, F.lit("budget").alias("status"), *[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    return done.unionByName(refused)
