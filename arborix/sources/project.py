"""Inputs and outputs of a project: orthogroup tables, manifests, species files, catalogues, rates, run records."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborix.kernels.configurations import KINDS
from arborix.sources.tabular import read_tsv

CATALOGUE_SCHEMA = "family string, unit string, length int, spans array<struct<start:int,end:int>>, junctions array<struct<donor:int,acceptor:int>>, tracts array<struct<id:string,start:int,end:int>>"
RATE_FIELDS = ("provenance", "rates")


def read_orthogroups(spark: SparkSession, path: str) -> DataFrame:
    """orthogroup, species, member: a wide table (one column a species, members parted by commas) or lines `OG: a b c`.

    Lines without a header don't say the species; it's null then.
    """
    first = spark.read.text(path).limit(1).collect()
    if first and "\t" in first[0][0]:
        wide = read_tsv(spark, path)
        key, *species = wide.columns
        long = wide.unpivot([key], species, "species", "members")
        return long.select(F.col(key).alias("orthogroup"), "species", F.explode(F.split("members", r"\s*,\s*")).alias("member")).where("member <> ''")
    lines = spark.read.text(path).where(F.col("value").contains(":"))
    return lines.select(F.trim(F.substring_index("value", ":", 1)).alias("orthogroup"), F.lit(None).cast("string").alias("species"), F.explode(F.split(F.trim(F.regexp_replace("value", r"^[^:]*:", "")), r"\s+")).alias("member")).where("member <> ''")


def single_locus_groups(groups: DataFrame) -> DataFrame:
    """Orthogroups with exactly one member in each of their species, and the reason for the others."""
    per = groups.groupBy("orthogroup", "species").agg(F.count_distinct("member").alias("n"))
    rows = per.groupBy("orthogroup").agg(F.count("*").alias("n_species"), F.max("n").alias("most"))
    return rows.select("orthogroup", "n_species", F.when(F.col("most") > 1, "several_members_in_a_species").when(F.col("n_species") < 2, "one_species").alias("excluded"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Species and their files; relative paths are beside the manifest, gene_copy_id and case_id have defaults."""
    rows = read_tsv(spark, path, required=["species", "family_id", "gene_id", "genome_fasta", "annotation_file"])
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    own = lambda c: F.when(F.col(c).rlike(r"^(/|[a-z0-9]+://)"), F.col(c)).otherwise(F.concat(F.lit(base + "/"), c))
    default = lambda name, value: F.coalesce(F.when(~F.col(name).isin("", "NA"), F.col(name)), value) if name in rows.columns else value
    copy = F.concat_ws("_", "species", "gene_id")
    return rows.withColumn("genome_fasta", own("genome_fasta")).withColumn("annotation_file", own("annotation_file")).withColumn("gene_copy_id", default("gene_copy_id", copy)).withColumn("case_id", default("case_id", F.col("family_id")))


def pair_species_files(files: DataFrame, path: str = "path") -> DataFrame:
    """species, sequence_file, annotation_file, problem: files joined by the stem of their name."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.(gz|bz2)$", "")
    stem, ending = F.regexp_replace(name, r"\.[^.]+$", ""), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(ending.isin("fa", "fasta", "fna"), "sequence").when(ending.isin("gff", "gff3", "gtf"), "annotation")
    rows = files.select(stem.alias("species"), kind.alias("kind"), F.col(path).alias("file")).where("kind is not null")
    of = lambda k: F.when(F.col("kind") == k, F.col("file"))
    got = rows.groupBy("species").agg(F.min(of("sequence")).alias("sequence_file"), F.min(of("annotation")).alias("annotation_file"), F.count(of("sequence")).alias("_s"), F.count(of("annotation")).alias("_a"))
    problem = F.when(F.col("_s") == 0, "no_sequence").when(F.col("_a") == 0, "no_annotation").when((F.col("_s") > 1) | (F.col("_a") > 1), "repeated_file")
    return got.select("species", "sequence_file", "annotation_file", problem.alias("problem"))


def _catalogue_problem(text: str) -> tuple[dict | None, str | None]:
    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise ValueError("repeated key")
        return dict(pairs)

    try:
        c = json.loads(text, object_pairs_hook=once)
        spans = [(int(a), int(b)) for a, b in c["spans"]]
        if not isinstance(c["length"], int) or c["length"] < 1:
            return None, "length"
        if any(not 0 <= a < b <= c["length"] for a, b in spans):
            return None, "span outside the unit"
        if any(not 0 <= d < a <= c["length"] for d, a in c.get("junctions", [])):
            return None, "junction outside the unit"
        if any(not 0 <= t["start"] < t["end"] <= c["length"] for t in c.get("tracts", [])):
            return None, "tract outside the unit"
        return c, None
    except ValueError as e:
        return None, str(e) if "repeated" in str(e) else "no JSON object"
    except (KeyError, TypeError) as e:
        return None, f"missing or wrong field: {e}"


def read_catalogues(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue rows of JSON lines, each with `problem` (null where it's valid); keys given twice are a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                c, problem = _catalogue_problem(text)
                c = c or {}
                pair = lambda x, a, b: [{a: int(u), b: int(v)} for u, v in x]
                rows.append((c.get("family"), c.get("unit"), c.get("length"), pair(c.get("spans", []), "start", "end"), pair(c.get("junctions", []), "donor", "acceptor"), c.get("tracts", []), problem))
            yield pd.DataFrame(rows, columns=["family", "unit", "length", "spans", "junctions", "tracts", "problem"]).astype({"length": "Int32"})

    return spark.read.text(path).where("trim(value) <> ''").mapInPandas(run, CATALOGUE_SCHEMA + ", problem string")


def catalogue_lines(catalogues: DataFrame) -> DataFrame:
    """Catalogues as JSON lines that read_catalogues takes."""
    pairs = lambda c, a, b: F.transform(c, lambda x: F.array(x[a], x[b]))
    row = F.struct("family", "unit", "length", pairs(F.col("spans"), "start", "end").alias("spans"), pairs(F.col("junctions"), "donor", "acceptor").alias("junctions"), "tracts")
    return catalogues.select(F.to_json(row).alias("value"))


def read_rates(path: str) -> dict[str, float]:
    """All eight edit rates, with a provenance; a missing, negative or non-finite rate is an error."""
    with open(path) as f:
        raw = json.load(f)
    if missing := [k for k in RATE_FIELDS if k not in raw]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    rates = {k: float(v) for k, v in raw["rates"].items()}
    if set(rates) != set(KINDS):
        raise ValueError(f"rates must be {', '.join(KINDS)}")
    if any(not math.isfinite(v) or v < 0 for v in rates.values()):
        raise ValueError("rates must be finite and not negative")
    return rates


def local_features(features: DataFrame, strand: Column, start: Column, end: Column) -> DataFrame:
    """Features rebased to a locus (closed coordinates), with the map back as text."""
    from arborix.functions.coordinates import to_local

    rows = features.withColumn("_l", to_local(strand, start, end, F.col("start"), F.col("end"))).where("_l is not null")
    back = F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), strand)
    return rows.withColumn("locus", back).withColumn("start", F.col("_l.start")).withColumn("end", F.col("_l.end")).drop("_l")
