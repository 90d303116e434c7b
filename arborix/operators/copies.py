"""Gene copies, transcripts and their segments: spans, classes, order, introns, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborix.operators import chunks
from arborix.session import Scratch

COPY = ["family_id", "species", "gene_copy_id"]
#: Copies of one contig at most so far apart stand in tandem (fixed value).
TANDEM_GAP = 250_000


def latest(df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """One row a key, the one loaded last; ties by the smallest remaining columns, so any run keeps the same."""
    rest = [F.col(f"`{c}`").asc_nulls_first() for c in sorted(df.columns) if c not in (key, at)]
    order = W.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), *rest)
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def present(occurrences: DataFrame) -> DataFrame:
    """Occurrences that are present, with a copy, a contig and valid coordinates."""
    c = F.col
    return occurrences.where((c("presence_status") == "present") & c("gene_copy_id").isNotNull() & c("contig").isNotNull() & (c("start") <= c("end")))


def spans(occurrences: DataFrame) -> DataFrame:
    """Smallest start, largest end, contig (the smallest) and roles of each copy."""
    return occurrences.groupBy(*COPY).agg(F.min("contig").alias("contig"), F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("role")).alias("roles"))


def contexts(copies: DataFrame) -> DataFrame:
    """Class of the copies of one family and species: single, tandem, same contig or dispersed; intronless ones apart."""
    group = W.partitionBy("family_id", "species")
    order = group.orderBy("start", "end", "gene_copy_id")
    gap = F.greatest(F.lit(0), F.col("start") - F.lag("end").over(order))
    rows = copies.withColumn("gap", gap).withColumn("n", F.count("*").over(group)).withColumn("far", F.max("gap").over(group))
    rows = rows.withColumn("one", F.min("contig").over(group) == F.max("contig").over(group))
    kind = F.when(F.col("n") == 1, "single_copy").when(F.col("one") & (F.col("far") <= TANDEM_GAP), "tandem_multi_copy").when(F.col("one"), "same_contig_multi_copy").otherwise("dispersed_multi_copy")
    exonic = F.arrays_overlap("roles", F.array(*map(F.lit, ("CDS", "UTR", "exon"))))
    bare = (F.col("n") > 1) & exonic & ~F.array_contains("roles", "intron")
    return rows.select(*COPY, kind.alias("copy_class"), F.when(bare, "processed_or_intronless_copy_candidate").otherwise(kind).alias("copy_subclass"), F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("copy_span"))


def adjacencies(occurrences: DataFrame) -> DataFrame:
    """Neighbouring segments of each copy in transcript order, numbered from 1."""
    order = W.partitionBy(*COPY).orderBy("transcript_order", "start", "occurrence_id")
    rows = occurrences.withColumn("right_occurrence_id", F.lead("occurrence_id").over(order)).withColumn("adjacency_no", F.row_number().over(order))
    return rows.where("right_occurrence_id is not null").select(*COPY, "adjacency_no", F.col("occurrence_id").alias("left_occurrence_id"), "right_occurrence_id")


def _islands(df: DataFrame, keys: list[str], opens) -> DataFrame:
    """Intervals with `_island`: a new one begins where ``opens`` (of the largest end so far) says so.

    Keys of any size are cut in chunks. Equal intervals are told apart by a number, so that both passes take them in one order.
    """
    scratch, order = Scratch(df.sparkSession, "islands"), ["start", "end", "_row"]
    spans = df.select(*keys, "start", "end", F.monotonically_increasing_id().alias("_row"))
    reached = chunks.running_max(chunks.chunked(spans, keys, order, scratch), keys, order, F.col("end"), "_reach", scratch)
    first = (F.col("_reach").isNull() | opens(F.col("_reach"))).cast("long")
    return chunks.running_sum(reached, keys, order, first, "_island", scratch).drop("_reach", "chunk")


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Closed intervals merged where they overlap or touch, by running maximum of the ends."""
    rows = _islands(df, keys, lambda reach: F.col("start") > reach + 1)
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged")).drop("_island")


def components(df: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open components: a new one begins where the start isn't below the largest end so far (touching splits)."""
    rows = _islands(df, keys, lambda reach: F.col("start") >= reach)
    return rows.groupBy(*keys, F.col("_island").alias("component")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_members"))


def introns(segments: DataFrame, keys: list[str]) -> DataFrame:
    """What lies between neighbouring merged exons of a transcript: closed start and end, numbered in reading direction."""
    exons = merged(segments, keys)
    order = W.partitionBy(*keys).orderBy("start")
    gaps = exons.withColumn("intron_start", F.col("end") + 1).withColumn("intron_end", F.lead("start").over(order) - 1).where("intron_end is not null")
    forward, back = W.partitionBy(*keys).orderBy("intron_start"), W.partitionBy(*keys).orderBy(F.desc("intron_start"))
    number = F.when(F.col("strand") == "-", F.row_number().over(back)).otherwise(F.row_number().over(forward))
    return gaps.select(*keys, "intron_start", "intron_end", number.alias("intron_no"))


def depth(df: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Bases with depth above 0 and above 1, by +1 and -1 events over half-open borders, and how the parts relate.

    Events of one place are summed before the running sum, so touching ends never count as overlap.
    """
    events = df.select(*keys, F.explode(F.array(F.struct((start - 1).alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))).alias("e"))
    places = events.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    scratch = Scratch(df.sparkSession, "depth")
    runs = chunks.running_sum(chunks.chunked(places, keys, ["at"], scratch), keys, ["at"], F.col("d"), "depth", scratch)
    runs = chunks.following(runs, keys, "at", "next").withColumn("span", F.col("next") - F.col("at"))
    sum_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("span"))), F.lit(0))
    got = runs.groupBy(*keys).agg(sum_if(F.col("depth") > 0).alias("covered"), sum_if(F.col("depth") > 1).alias("overlap"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    n = df.groupBy(*keys).agg(F.count("*").alias("n_parts"))
    relation = F.when(F.col("n_parts") == 1, "single_projection").when(F.col("overlap") > 0, "repeated_overlap").otherwise("complementary_disjoint")
    return got.join(n, keys).select(*keys, "n_parts", "covered", "overlap", (F.col("hi") - F.col("lo") - F.col("covered")).alias("uncovered"), relation.alias("relation"))


def order_context(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Scaled place (0 to 1) of each segment and the roles beside it, `terminal` at an end, over all its transcripts."""
    order = W.partitionBy(*keys).orderBy("transcript_order", "start", "occurrence_id")
    n, i = F.count("*").over(W.partitionBy(*keys)), F.row_number().over(order) - 1
    rows = segments.select("*", F.when(n > 1, i / (n - 1)).otherwise(0.0).alias("place"), F.coalesce(F.lag("role").over(order), F.lit("terminal")).alias("l"), F.coalesce(F.lead("role").over(order), F.lit("terminal")).alias("r"))
    side = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("alternative")
    return rows.groupBy("occurrence_id").agg(F.round(F.avg("place"), 6).alias("order_index"), side("l").alias("left_role"), side("r").alias("right_role"))


def canonical(transcripts: DataFrame) -> DataFrame:
    """The transcript of each copy with the longest coding length, then the longest span, then the smallest id."""
    order = W.partitionBy(*COPY).orderBy(F.desc("cds_length"), F.desc("span"), "transcript_id")
    return transcripts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def majority_path(paths: DataFrame, group: list[str], path: str) -> DataFrame:
    """The most frequent path of each group, ties by the smaller path, with its share as n/total."""
    counted = paths.groupBy(*group, path).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*group))
    order = W.partitionBy(*group).orderBy(F.desc("n"), path)
    rows = counted.withColumn("total", total).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.select(*group, F.col(path).alias("majority_path"), F.concat(F.col("n").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("support"))


def disjointness_violations(df: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Rows that overlap an earlier one of another owner: the running maximum end of each row, with its owner."""
    scratch, order = Scratch(df.sparkSession, "disjointness"), ["start", "end", owner]
    rows = chunks.running_max(chunks.chunked(df, keys, order, scratch), keys, order, F.struct("end", owner), "_p", scratch)
    return rows.where((F.col("start") <= F.col("_p.end")) & (F.col(owner) != F.col(f"_p.{owner}"))).select(*keys, F.col(f"_p.{owner}").alias("left_owner"), F.col(owner).alias("right_owner"), "start", F.col("_p.end").alias("reach"))
