"""Nucleotide sequences as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The standard genetic code in T, C, A, G order of the three places (fixed value).
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"


def clean(text: Column) -> Column:
    """Upper case, U as T, everything but A, C, G and T taken out."""
    return F.regexp_replace(F.translate(F.upper(text), "U", "T"), "[^ACGT]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGTN", "TGCAN"))


def oriented_slice(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Closed 1-based slice, reverse-complemented on the minus strand."""
    part = F.substr(seq, start.cast("int"), (end - start + 1).cast("int"))
    return F.when(strand == "-", reverse_complement(part)).otherwise(part)


def _letters(seq: Column) -> Column:
    return F.filter(F.split(F.translate(F.upper(seq), "U", "T"), ""), lambda x: x != "")


def ungapped_identity(a: Column, b: Column) -> Column:
    """Equal share of the known pairs over the shorter length; null without known pairs."""
    pairs = F.filter(F.arrays_zip(_letters(a).alias("x"), _letters(b).alias("y")), lambda p: p["x"].isin(*"ACGT") & p["y"].isin(*"ACGT"))
    return F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda p: p["x"] == p["y"])) / F.size(pairs))


def occurrences(seq: Column, query: Column) -> Column:
    """Exact occurrences, overlapping ones too; the query holds letters only."""
    return F.when(F.length(query) > 0, F.regexp_count(seq, F.concat(F.lit("(?="), query, F.lit(")")))).otherwise(0)


def translate_codons(seq: Column) -> Column:
    """Amino acids of the whole codons; a codon with an unknown base is X.

    The codons are cut once; nothing inside the lambda refers to the whole sequence, which would be computed again for each.
    """
    codons = F.regexp_extract_all(seq, F.lit("(?s)(.{3})"), F.lit(1))
    place = lambda x, k: F.instr(F.lit(BASES), F.substr(x, F.lit(k), F.lit(1))) - 1

    def acid(x: Column) -> Column:
        a, b, c = (place(x, k) for k in (1, 2, 3))
        return F.when((a >= 0) & (b >= 0) & (c >= 0), F.substr(F.lit(CODE), a * 16 + b * 4 + c + 1, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(codons, acid), "")


def expected_phase(length: Column, phase: Column) -> Column:
    """Phase that the next coding segment must have."""
    return F.pmod(3 - F.pmod(length - phase, F.lit(3)), F.lit(3))


def cigar_operations(cigar: Column) -> Column:
    """Array of struct(n, op); an operation without a number counts once."""
    tokens = F.regexp_extract_all(cigar, F.lit(r"(\d*[MIDNSHP=X])"), F.lit(1))
    return F.transform(tokens, lambda t: F.struct(F.coalesce(F.regexp_extract(t, r"^(\d*)", 1).try_cast("long"), F.lit(1)).alias("n"), F.right(t, F.lit(1)).alias("op")))


def cigar_lengths(cigar: Column) -> Column:
    """struct(query, target, aligned, gaps): bases each side consumes."""
    ops = cigar_operations(cigar)
    total = lambda kinds: F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast("long"), lambda acc, o: acc + o["n"])
    return F.struct(total("MIS=X").alias("query"), total("MDN=X").alias("target"), total("M=X").alias("aligned"), total("IDN").alias("gaps"))


def transpose_cigar(cigar: Column) -> Column:
    """Query and target exchanged: insertions become deletions."""
    return F.translate(cigar, "ID", "DI")


def runs(text: Column, pattern: str) -> Column:
    """The maximal runs that match a character class such as `-` or `[^ACGT-]`."""
    return F.regexp_extract_all(text, F.lit(f"({pattern}+)"), F.lit(1))
