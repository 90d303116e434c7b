"""Unknown-aware scalars. Unknown is never absent: it stays null or `unknown` until a rule decides."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from arborix.session import UNKNOWN

# Fixed values of the data model.
ABSENT_WORDS = ("absent", "0", "false", "no")
CONFIDENCE = {"high": 0.95, "medium": 0.75, "low": 0.45}
CODING_ROLES = ("CDS", "coding_exon")
UTR_TYPES = ("five_prime_UTR", "three_prime_UTR", "UTR")


def state(value: Column) -> Column:
    """The trimmed value; null and the unknown words become `unknown`."""
    v = F.trim(value)
    return F.when(v.isNull() | v.isin(*UNKNOWN), "unknown").otherwise(v)


def number(value: Column, default: float | None = None) -> Column:
    """A double, or the default where the text is blank, unknown or no finite number."""
    n = value.try_cast("double")
    finite = F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)
    return F.coalesce(finite, F.lit(default).cast("double"))


def confidence(value: Column) -> Column:
    """high, medium and low by word, otherwise the number in it, otherwise one half."""
    v = F.lower(F.trim(value))
    words = F.when(v == "high", CONFIDENCE["high"]).when(v == "medium", CONFIDENCE["medium"]).when(v == "low", CONFIDENCE["low"])
    return F.coalesce(words, number(v), F.lit(0.5))


def adjusted_confidence(base: Column, degree: Column) -> Column:
    """The base raised by the number of supporting links, one at most."""
    return F.least(F.lit(1.0), 0.75 * base + 0.25 * F.least(F.lit(1.0), degree / 2.0))


def role_of_type(kind: Column) -> Column:
    """CDS, UTR, intron, exon or other from a feature type."""
    k = F.lower(kind)
    return F.when(k == "cds", "CDS").when(k.contains("utr"), "UTR").when(k == "intron", "intron").when(k.contains("exon"), "exon").otherwise("other")


def exon_like(role: Column) -> Column:
    return role.isin("CDS", "exon", "UTR")


def key_of(*parts: Column) -> Column:
    """One unambiguous text for a tuple: JSON keeps the borders, null stays apart from empty."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})
