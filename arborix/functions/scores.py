"""Scores and acceptance rules of pairwise matches, as column expressions. The numbers are fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TIE = 1e-12
NANO = 1_000_000_000


def exact_mean(value: Column) -> Column:
    """The mean to six digits, whatever the order of the rows: values count in whole billionths, halves round up."""
    units = F.floor(value * NANO + 0.5).cast("long")
    return F.floor((2 * F.sum(units) + 1000 * F.count(value)) / (2000 * F.count(value))).cast("long") / 1_000_000.0


def exact_mean_sql(value: str) -> str:
    """The same in SQL."""
    return f"floor((2 * sum(floor({value} * {NANO} + 0.5::DOUBLE)::BIGINT) + 1000 * count({value})) / (2000 * count({value})))::BIGINT / 1000000.0::DOUBLE"


def exact_sum(value: Column, digits: int = 3) -> Column:
    """The sum of values in whole billionths, rounded."""
    return F.round(F.sum(F.floor(value * NANO + 0.5).cast("decimal(38,0)")).cast("double") / NANO, digits)


def pair_threshold(threshold: Column, distance: Column) -> Column:
    """The identity asked for, by how far apart the species are."""
    return F.when(distance == "short", F.greatest(threshold, F.lit(0.75))).when(distance == "long", F.greatest(F.lit(0.45), threshold - 0.15)).otherwise(threshold)


def accepted(identity: Column, coverage: Column, threshold: Column) -> Column:
    """Enough identity over nearly half, or clearly more over a third."""
    return ((identity >= threshold) & (coverage >= 0.45)) | ((identity >= threshold + 0.15) & (coverage >= 0.30))


def accepted_short(identity: Column, coverage: Column, pairs: Column, threshold: Column) -> Column:
    """The stricter rule of short segments: at least 12 aligned pairs, or 3 to 11 as a microexon."""
    short = (pairs >= 12) & (identity >= F.greatest(F.lit(0.7), threshold)) & (coverage >= 0.8)
    micro = pairs.between(3, 11) & (identity >= F.greatest(F.lit(0.9), threshold)) & (coverage >= 0.95)
    return short | micro


def sequence_score(identity: Column, coverage: Column) -> Column:
    return 0.7 * identity + 0.3 * coverage


def splice_motif_score(donor: Column, acceptor: Column) -> Column:
    """GT-AG 1, the rarer pairs .8, half a canonical motif .45, otherwise .1."""
    d, a = F.upper(donor), F.upper(acceptor)
    return F.when((d == "GT") & (a == "AG"), 1.0).when((a == "AG") & (d == "GC") | (d == "AT") & (a == "AC"), 0.8).when((d == "GT") | (a == "AG"), 0.45).otherwise(0.1)
