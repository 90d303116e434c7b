"""FASTA as rows of records, and intervals of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborix.functions.sequence import oriented_slice


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """record_id (first word of the header), description, sequence (upper case), length.

    Records are split at `>` on a line's begin, so large files are read in parallel. Of records with one id the last
    counts; an empty header is left out.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("_at", F.monotonically_increasing_id())
    body = F.regexp_replace("value", r"\A>", "")
    rows = raw.select("_at", F.regexp_extract(body, r"\A([^\r\n]*)", 1).alias("description"), F.upper(F.regexp_replace(F.regexp_replace(body, r"\A[^\r\n]*", ""), r"\s", "")).alias("sequence"))
    rows = rows.withColumn("record_id", F.regexp_extract("description", r"\A\s*(\S+)", 1)).where("record_id <> ''")
    last = rows.groupBy("record_id").agg(F.max_by(F.struct("description", "sequence"), "_at").alias("r"))
    return last.select("record_id", "r.description", "r.sequence", F.length("r.sequence").alias("length"))


def write_fasta(df: DataFrame, path: str, key: str, sequence: str, width: int = 60) -> None:
    """One record a row, lines of the given width."""
    lines = F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), lines)).write.text(path)


def read_intervals(records: DataFrame, intervals: DataFrame, record: str, start: str, end: str, strand: str) -> DataFrame:
    """The interval rows with their sequence; null where the interval isn't wholly inside its record."""
    r = records.select(F.col("record_id").alias("_r"), F.col("sequence").alias("_s"))
    rows = intervals.join(r, F.col(record) == F.col("_r"), "left")
    inside = (F.col(start) >= 1) & (F.col(start) <= F.col(end)) & (F.col(end) <= F.length("_s"))
    return rows.withColumn("sequence", F.when(inside, oriented_slice(F.col("_s"), F.col(start), F.col(end), F.col(strand)))).drop("_r", "_s")
