"""Closed (1-based) and half-open (0-based) coordinates, strands and aligned blocks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_open(start: Column, end: Column) -> Column:
    """struct(start0, end0) of a closed interval; null where it's empty or inverted."""
    return F.when((start >= 1) & (end >= start), F.struct((start - 1).alias("start0"), end.alias("end0")))


def closed(start0: Column, end0: Column) -> Column:
    """struct(start, end); an empty half-open interval has no closed form and is null."""
    return F.when(end0 > start0, F.struct((start0 + 1).alias("start"), end0.alias("end")))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases that two closed intervals share."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def to_genome(strand: Column, locus_start: Column, locus_end: Column, start: Column, end: Column) -> Column:
    """Local closed coordinates of a locus (1 is its first base in reading direction) on the genome."""
    plus = F.struct((locus_start + start - 1).alias("start"), (locus_start + end - 1).alias("end"))
    minus = F.struct((locus_end - end + 1).alias("start"), (locus_end - start + 1).alias("end"))
    return F.when(strand == "-", minus).otherwise(plus)


def to_local(strand: Column, locus_start: Column, locus_end: Column, start: Column, end: Column) -> Column:
    """The inverse of to_genome; null outside the locus."""
    plus = F.struct((start - locus_start + 1).alias("start"), (end - locus_start + 1).alias("end"))
    minus = F.struct((locus_end - end + 1).alias("start"), (locus_end - start + 1).alias("end"))
    inside = (start >= locus_start) & (end <= locus_end)
    return F.when(inside, F.when(strand == "-", minus).otherwise(plus))


def blocks_from_text(text: Column) -> Column:
    """`q1-q2:t1-t2;…` as an array of struct(q_start, q_end, t_start, t_end); what doesn't parse is left out."""
    part = lambda x, g: F.regexp_extract(x, r"^(\d+)-(\d+):(\d+)-(\d+)$", g).cast("long")
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x.rlike(r"^\d+-\d+:\d+-\d+$"))
    return F.transform(tokens, lambda x: F.struct(part(x, 1).alias("q_start"), part(x, 2).alias("q_end"), part(x, 3).alias("t_start"), part(x, 4).alias("t_end")))


def blocks_to_text(blocks: Column) -> Column:
    dash = lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
    return F.array_join(F.transform(blocks, lambda b: F.concat(dash(b["q_start"], b["q_end"]), F.lit(":"), dash(b["t_start"], b["t_end"]))), ";")


def genomic_block(token: Column) -> Column:
    """`contig:start-end:strand` as a struct; the contig may hold colons; null if malformed."""
    pattern = r"^(.+):(\d+)-(\d+):([+-])$"
    get = lambda g: F.regexp_extract(token, pattern, g)
    return F.when(token.rlike(pattern), F.struct(get(1).alias("contig"), get(2).cast("long").alias("start"), get(3).cast("long").alias("end"), get(4).alias("strand")))


def genomic_blocks(blocks: Column, side: str, contig: Column, start: Column, end: Column, strand: Column) -> Column:
    """Blocks of one side (`q` or `t`, 1-based in the record) as `contig:start-end:strand` in the genome, sorted, joined with `;`."""
    one = lambda b: to_genome(strand, start, end, b[f"{side}_start"], b[f"{side}_end"])
    text = lambda g: F.concat(contig, F.lit(":"), g["start"].cast("string"), F.lit("-"), g["end"].cast("string"), F.lit(":"), strand)
    return F.array_join(F.transform(F.array_sort(F.filter(F.transform(blocks, one), lambda g: g.isNotNull())), text), ";")
