"""GFF3 and GTF lines, their attributes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Prefixes that the same identifier may carry (fixed values).
PREFIXES = "gene|rna|mrna|transcript|cds|exon|id"


def attributes(text: Column) -> Column:
    """map of `k=v;` (GFF3) or `k "v";` (GTF); of a key given twice the last counts."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), r";\s*"), lambda x: F.trim(x).rlike(r"^[^=\s]+\s*[=\s]\s*\S"))
    entry = lambda x: F.struct(F.regexp_extract(F.trim(x), r"^([^=\s]+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(F.trim(x), r"^[^=\s]+\s*[=\s]\s*(.*)$", 1), '^"|"$', "").alias("value"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def identifiers(text: Column) -> Column:
    """The identifiers of a field that holds several, parted by comma or semicolon, quotes and blanks taken off."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")), lambda x: x != "")


def token_variants(token: Column) -> Column:
    """The token, and without a prefix such as `gene-` or `rna:`."""
    return F.array_distinct(F.array(token, F.regexp_replace(token, rf"(?i)^(?:{PREFIXES})[-:]", "")))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Features of GFF3 or GTF lines; comments and lines of another width than nine are left out.

    id and parent fall back to the attributes that the type has in GTF.
    """
    f = F.split(F.regexp_replace("value", r"\r\z", ""), "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") == 9)
    part = lambda i: F.get("f", F.lit(i))
    a = attributes(part(8))
    rows = rows.select(part(0).alias("seqid"), part(1).alias("source"), part(2).alias("type"), part(3).try_cast("long").alias("start"), part(4).try_cast("long").alias("end"), part(5).alias("score"), part(6).alias("strand"), part(7).alias("phase"), a.alias("attrs"))
    get = lambda *keys: F.coalesce(*[F.try_element_at("attrs", F.lit(k)) for k in keys])
    own = F.when(F.col("type") == "gene", get("ID", "gene_id", "gene")).when(F.col("type").isin("mRNA", "transcript"), get("ID", "transcript_id")).otherwise(get("ID", "exon_id", "protein_id"))
    up = F.when(F.col("type") == "gene", F.lit(None).cast("string")).when(F.col("type").isin("mRNA", "transcript"), get("Parent", "gene_id")).otherwise(get("Parent", "transcript_id"))
    return rows.withColumn("id", own).withColumn("parents", identifiers(up)).withColumn("parent", F.get("parents", F.lit(0)))
