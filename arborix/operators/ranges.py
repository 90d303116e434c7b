"""Joins on overlap. Positions are cut into bins, so that an overlap is an equi-join with a residual test.

Bins are hierarchical: an interval lies in the bins of the finest level at which it spans at most FEW of them, so that it is
at most FEW rows, however long. Rows of a level meet those of every other level in the bins of the coarser one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Width of the finest bins in bits, how much wider those of the next level are, and the most bins of an interval.
BIN_BITS, STEP_BITS, FEW = 14, 7, 130
#: Levels up to the largest long.
LEVELS = -(-(63 - BIN_BITS) // STEP_BITS) + 1


def _level(start: Column, end: Column, bits: int) -> Column:
    """The finest level at which an interval spans at most FEW bins."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(F.shiftright(end, bits + STEP_BITS * k) - F.shiftright(start, bits + STEP_BITS * k) < FEW, k).otherwise(out)
    return out


def _width(level: Column, bits: int) -> Column:
    return (level * STEP_BITS + bits).cast("int")


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def _used(df: DataFrame, start: str, end: str, bits: int) -> list[int]:
    """The levels that a side has, a few small numbers."""
    return sorted(r[0] for r in df.select(_level(F.col(start), F.col(end), bits).alias("k")).where("k is not null").distinct().collect())


def _meet(left: DataFrame, right: DataFrame, keys: list[str], bits: int, spans: tuple[str, str, str, str], more=None) -> DataFrame:
    def side(df: DataFrame, p: str, start: str, end: str, others: list[int]) -> DataFrame:
        named = df.select(*[F.col(f"`{c}`").alias(p + c) for c in df.columns], _level(F.col(start), F.col(end), bits).alias(p + "_own"), F.col(start).alias(p + "_a"), F.col(end).alias(p + "_z"))
        meet = F.array_distinct(F.transform(F.array(*map(F.lit, others)), lambda k: F.greatest(k, F.col(p + "_own"))))
        at = named.withColumn(p + "_at", F.explode(meet))
        by = _width(F.col(p + "_at"), bits)
        return at.withColumn(p + "_bin", F.explode(F.sequence(_shift(F.col(p + "_a"), by), _shift(F.col(p + "_z"), by))))

    ls, le, rs, re = spans
    levels_l, levels_r = _used(left, ls, le, bits), _used(right, rs, re, bits)
    a, b = side(left, "l_", ls, le, levels_r or [0]), side(right, "r_", rs, re, levels_l or [0])
    by = _width(F.col("l__at"), bits)
    on = (a["l__at"] == b["r__at"]) & (a["l__bin"] == b["r__bin"]) & (F.greatest("l__own", "r__own") == a["l__at"]) & (a["l__a"] <= b["r__z"]) & (b["r__a"] <= a["l__z"])
    on = on & (_shift(F.greatest("l__a", "r__a"), by) == a["l__bin"])
    for k in keys:
        on = on & (a["l_" + k] == b["r_" + k])
    if more is not None:
        on = on & more(a, b)
    return a.join(b, on).drop(*[f"{p}__{x}" for p in "lr" for x in ("bin", "at", "own", "a", "z")])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bits: int = BIN_BITS, more=None) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals overlap, once each.

    Columns of the sides come prefixed l_ and r_; both need start and end, as long. A pair meets at the coarser of its
    two levels and is kept in the bin where its common part begins, so no later distinct is needed; a hot key is spread
    over its bins. Intervals of any length up to the largest long are at most FEW rows a level of the other side.
    """
    return _meet(left, right, keys, bits, ("start", "end", "start", "end"), more)


def point_join(points: DataFrame, at: str, blocks: DataFrame, keys: list[str], bits: int = BIN_BITS) -> DataFrame:
    """Points inside closed blocks of the same keys, columns prefixed l_ and r_: an overlap with an interval of one place."""
    return _meet(points, blocks, keys, bits, (at, at, "start", "end"))
