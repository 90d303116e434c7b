"""Queries of the sequence functions, annotation attributes and file formats, with their SQL.

Sequences are what is left of A, C, G and T in the texts of documents, whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborix.functions import scores, sequence as Q
from arborix.operators import chunks
from arborix.session import Scratch, table
from arborix.sources import annotation as A, sequences, tabular


def _seq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "source", Q.clean(F.col("text")).alias("seq")).where("seq <> ''")


def neighbours(rows: DataFrame) -> DataFrame:
    """doc_id, seq and the sequence before it in its source (`before`).

    Neighbours are found among the ids alone, in chunks, so that no source is one task; then both sequences are joined to the pair.
    """
    scratch = Scratch(rows.sparkSession, "neighbours")
    ids = rows.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("of"))
    pairs = chunks.following(scratch.write(chunks.chunked(ids, ["of"], ["doc_id"], scratch), "chunks"), ["of"], "doc_id", "next").where("next is not null")
    first = rows.select("doc_id", F.col("seq").alias("before"))
    return pairs.select("doc_id", "next").join(first, "doc_id").select(F.col("next").alias("doc_id"), "before").join(rows.select("doc_id", "seq"), "doc_id")


def reverse_complements(spark, d):
    r = Q.reverse_complement(F.col("seq"))
    return _seq(spark, d).select("doc_id", F.length("seq").alias("length"), F.md5(r).alias("digest"), F.substr(r, F.lit(1), F.lit(12)).alias("head"))


def neighbour_identity(spark, d):
    """Ungapped identity of each sequence with the one before it in its source."""
    return neighbours(_seq(spark, d)).select("doc_id", F.round(Q.ungapped_identity(F.col("seq"), F.col("before")), 6).alias("identity"))


def splice_motifs(spark, d):
    """Motif score of the two first and the two last bases."""
    s = F.col("seq")
    score = F.when(F.length(s) < 4, 0.0).otherwise(scores.splice_motif_score(F.substr(s, F.lit(1), F.lit(2)), F.right(s, F.lit(2))))
    return _seq(spark, d).groupBy(score.alias("splice_motif_score")).agg(F.count("*").alias("n"))


def translations(spark, d):
    p = Q.translate_codons(F.col("seq"))
    return _seq(spark, d).select("doc_id", F.length(p).alias("n_codons"), F.md5(p).alias("digest"), (F.length(p) - F.length(F.replace(p, F.lit("*")))).alias("n_stops"), Q.expected_phase(F.length("seq"), F.lit(0)).alias("next_phase"))


def repeats(spark, d):
    """How often each sequence's first three bases stand in it, overlapping ones too, and those of its reverse."""
    s = F.col("seq")
    head = F.substr(s, F.lit(1), F.lit(3))
    return _seq(spark, d).where(F.length("seq") >= 3).select("doc_id", Q.occurrences(s, head).alias("n_forward"), Q.occurrences(s, Q.reverse_complement(head)).alias("n_reverse"))


def gap_runs(spark, d):
    """Maximal runs of other signs than bases in the texts, by length."""
    row = F.regexp_replace(F.translate("text", "acgt", "ACGT"), "(?s)[^ACGT]", "-")
    runs = table(spark, d, "documents").where("text is not null").select(F.explode(Q.runs(row, "-")).alias("run"))
    return runs.groupBy(F.length("run").alias("length")).agg(F.count("*").alias("n"))


def cigar_lengths(spark, d):
    """CIGARs made of aligned pairs and gaps: bases of both sides, and of the transposed alignment."""
    m = table(spark, d, "segment_matches").where("match_id is not null and aligned_pairs is not null and size_ratio is not null and not isnan(size_ratio)")
    gap = F.floor((1 - F.col("size_ratio")) * F.col("aligned_pairs")).cast("long")
    text = lambda n, op: F.concat(n.cast("string"), F.lit(op))
    half = F.floor(F.col("aligned_pairs") / 2).cast("long")
    cigar = F.concat(text(half, "M"), text(gap, "I"), text(F.col("aligned_pairs") - half, "="), F.lit("D"))
    rows = m.select("match_id", Q.cigar_lengths(cigar).alias("a"), Q.cigar_lengths(Q.transpose_cigar(cigar)).alias("b"))
    return rows.select("match_id", "a.query", "a.target", "a.aligned", "a.gaps", F.col("b.query").alias("transposed_query"), F.col("b.target").alias("transposed_target")).distinct()


def attribute_map(spark, d):
    """Attribute keys of the raw features: rows, distinct values, and rows in which they agree with the columns."""
    rows = table(spark, d, "raw_gene_features").select("id", "parent", F.explode(A.attributes(F.col("attrs"))))
    agree = F.when(F.col("key") == "ID", F.col("value") == F.col("id")).when(F.col("key") == "Parent", F.col("value") == F.col("parent"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.sum(F.coalesce(agree, F.lit(False)).cast("long")).alias("n_agreeing"))


def token_resolution(spark, d):
    """Gene ids of the later lines looked up among features: exact ids first, names and other attributes only then.

    A token resolves if the features of the best class belong to one gene copy.
    """
    f = table(spark, d, "raw_gene_features").where("gene_copy_id is not null")
    primary = f.select(F.explode(A.token_variants(F.col("id"))).alias("token"), "gene_copy_id", F.lit(1).alias("class"))
    other = f.select(F.explode(F.map_values(A.attributes(F.col("attrs")))).alias("token"), "gene_copy_id", F.lit(2).alias("class"))
    known = primary.unionByName(other).where("token is not null").distinct()
    wanted = table(spark, d, "raw_feature_lines").select(F.get(F.split("raw_line", "\t"), F.lit(3)).alias("token")).where("token is not null and token <> ''").distinct()
    hits = wanted.join(known, "token", "left").groupBy("token", "class").agg(F.count_distinct("gene_copy_id").alias("n"), F.min("gene_copy_id").alias("copy"))
    best = hits.groupBy("token").agg(F.min_by(F.struct("class", "n", "copy"), F.coalesce("class", F.lit(9))).alias("b"))
    status = F.when(F.col("b.class").isNull(), "not_found").when(F.col("b.n") == 1, "resolved").otherwise("ambiguous")
    return best.select("token", status.alias("status"), F.when(F.col("b.n") == 1, F.col("b.copy")).alias("gene_copy_id"))


def multi_parents(spark, d):
    """Parents of raw features as sets: how many each row names, and whether its parent is among them."""
    ids = A.identifiers(F.col("parents"))
    return table(spark, d, "raw_gene_features").groupBy(F.size(ids).alias("n_parents"), F.coalesce(F.array_contains(ids, F.col("parent")), F.lit(False)).alias("has_parent")).agg(F.count("*").alias("n"))


def tsv_round_trip(spark, d):
    """species_tree as TSV and back: what each column holds then."""
    path = Scratch(spark, "tsv").path("species_tree")
    fields = ["node_id", "parent_id", "label", "branch_length", "absent"]
    tabular.write_tsv(table(spark, d, "species_tree"), path, fields)
    back = tabular.read_tsv(spark, path, required=["node_id"])
    long = back.unpivot([], fields, "column", "value")
    return long.groupBy("column").agg(F.count("*").alias("n"), F.sum((F.col("value") == "NA").cast("long")).alias("n_na"), F.count_distinct("value").alias("n_values"))


def fasta_round_trip(spark, d):
    """The sequences as FASTA and back, by digest, with a slice of each on the minus strand."""
    path = Scratch(spark, "fasta").path("seq")
    sequences.write_fasta(_seq(spark, d).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("k"), "seq"), path, "k", "seq")
    rows = sequences.read_fasta(spark, path)
    cuts = rows.select(F.col("record_id").alias("r"), F.lit(2).alias("s"), F.lit(9).alias("e"), F.lit("-").alias("strand"))
    return sequences.read_intervals(rows, cuts, "r", "s", "e", "strand").join(rows.select("record_id", "length", F.md5("sequence").alias("digest")), F.col("r") == F.col("record_id")).select("record_id", "length", "digest", F.col("sequence").alias("slice"))


QUERIES = {f.__name__: f for f in (reverse_complements, neighbour_identity, splice_motifs, translations, repeats, gap_runs, cigar_lengths, attribute_map, token_resolution, multi_parents, tsv_round_trip, fasta_round_trip)}

_S = "WITH seq AS (SELECT * FROM (SELECT doc_id, source, regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL) WHERE seq <> '')"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_ATTR = r"""a0 AS (SELECT *, list_filter(string_split_regex(coalesce(attrs, ''), ';\s*'), lambda x: regexp_matches(trim(x), '^[^=\s]+\s*[=\s]\s*\S')) AS l FROM raw_gene_features),
a1 AS (SELECT row_id, id, parent, gene_copy_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM a0), a2 AS (SELECT *, regexp_extract(trim(x), '^([^=\s]+)', 1) AS key, regexp_replace(regexp_extract(trim(x), '(?s)^[^=\s]+\s*[=\s]\s*(.*)$', 1), '^"|"$', '', 'g') AS value FROM a1),
alast AS (SELECT * FROM a2 QUALIFY row_number() OVER (PARTITION BY row_id, key ORDER BY i DESC) = 1)"""
SQL = {
    "reverse_complements": _S + f" SELECT doc_id, length(seq) AS length, md5({_RC.format('seq')}) AS digest, substr({_RC.format('seq')}, 1, 12) AS head FROM seq",
    "neighbour_identity": _S
    + """, p AS (SELECT doc_id, seq, lag(seq) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM seq), n AS (SELECT doc_id, least(length(seq), length(b)) AS n, seq, b FROM p WHERE b IS NOT NULL)
SELECT doc_id, round(len(list_filter(range(1, n + 1), lambda i: seq[i] = b[i])) / n, 6) AS identity FROM n""",
    "splice_motifs": _S
    + " SELECT CASE WHEN length(seq) < 4 THEN 0 WHEN seq[:2] = 'GT' AND seq[-2:] = 'AG' THEN 1 WHEN (seq[-2:] = 'AG' AND seq[:2] = 'GC') OR (seq[:2] = 'AT' AND seq[-2:] = 'AC') THEN 0.8 WHEN seq[:2] = 'GT' OR seq[-2:] = 'AG' THEN 0.45 ELSE 0.1 END::DOUBLE AS splice_motif_score, count(*) AS n FROM seq GROUP BY 1",
    "translations": _S
    + f""", p AS (SELECT doc_id, length(seq) AS n, CASE WHEN length(seq) < 3 THEN '' ELSE array_to_string(list_transform(range(1, length(seq) - 1, 3), lambda i: substr('{Q.CODE}', CAST((instr('TCAG', seq[i]) - 1) * 16 + (instr('TCAG', seq[i + 1]) - 1) * 4 + instr('TCAG', seq[i + 2]) AS BIGINT), 1)), '') END AS p FROM seq)
SELECT doc_id, length(p) AS n_codons, md5(p) AS digest, length(p) - length(replace(p, '*', '')) AS n_stops, (3 - n % 3) % 3 AS next_phase FROM p""",
    "repeats": _S
    + f", h AS (SELECT doc_id, seq, seq[:3] AS q, {_RC.format('seq[:3]')} AS r FROM seq WHERE length(seq) >= 3) SELECT doc_id, len(list_filter(range(1, length(seq) - 1), lambda i: substr(seq, i, 3) = q)) AS n_forward, len(list_filter(range(1, length(seq) - 1), lambda i: substr(seq, i, 3) = r)) AS n_reverse FROM h",
    "gap_runs": "WITH r AS (SELECT unnest(regexp_extract_all(regexp_replace(translate(text, 'acgt', 'ACGT'), '(?s)[^ACGT]', '-', 'g'), '-+')) AS run FROM documents WHERE text IS NOT NULL) SELECT length(run) AS length, count(*) AS n FROM r GROUP BY 1",
    "cigar_lengths": """WITH m AS (SELECT match_id, aligned_pairs AS p, floor((1 - size_ratio) * aligned_pairs)::BIGINT AS g FROM segment_matches WHERE match_id IS NOT NULL AND aligned_pairs IS NOT NULL AND size_ratio IS NOT NULL AND NOT isnan(size_ratio))
SELECT DISTINCT match_id, p + g AS query, p + 1 AS target, p AS aligned, g + 1 AS gaps, p + 1 AS transposed_query, p + g AS transposed_target FROM m""",
    "attribute_map": "WITH " + _ATTR + " SELECT key, count(*) AS n, count(DISTINCT value) AS n_values, count(*) FILTER ((key = 'ID' AND value = id) OR (key = 'Parent' AND value = parent)) AS n_agreeing FROM alast GROUP BY 1",
    "token_resolution": "WITH "
    + _ATTR
    + r""", k AS (SELECT DISTINCT token, gene_copy_id, c FROM (SELECT unnest([id, regexp_replace(id, '(?i)^(?:gene|rna|mrna|transcript|cds|exon|id)[-:]', '')]) AS token, gene_copy_id, 1 AS c FROM raw_gene_features UNION ALL SELECT value, gene_copy_id, 2 FROM alast) WHERE token IS NOT NULL AND gene_copy_id IS NOT NULL),
w AS (SELECT DISTINCT t AS token FROM (SELECT string_split(raw_line, chr(9))[4] AS t FROM raw_feature_lines) WHERE t <> ''), h AS (SELECT w.token, c, count(DISTINCT gene_copy_id) AS n, min(gene_copy_id) AS copy FROM w LEFT JOIN k USING (token) GROUP BY 1, 2)
SELECT token, CASE WHEN c IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN copy END AS gene_copy_id FROM h QUALIFY row_number() OVER (PARTITION BY token ORDER BY c) = 1""",
    "multi_parents": r"""WITH p AS (SELECT parent, list_filter(list_transform(string_split_regex(coalesce(parents, ''), '[,;]'), lambda x: regexp_replace(trim(x), '^"|"$', '', 'g')), lambda x: x <> '') AS l FROM raw_gene_features)
SELECT len(l) AS n_parents, coalesce(list_contains(l, parent), false) AS has_parent, count(*) AS n FROM p GROUP BY 1, 2""",
    "tsv_round_trip": """WITH l AS (SELECT unnest(['node_id', 'parent_id', 'label', 'branch_length', 'absent']) AS "column", unnest([coalesce(node_id, 'NA'), coalesce(parent_id, 'NA'), coalesce(label, 'NA'), coalesce(branch_length::VARCHAR, 'NA'), 'NA']) AS v FROM species_tree)
SELECT "column", count(*) AS n, count(*) FILTER (v = 'NA') AS n_na, count(DISTINCT v) AS n_values FROM l GROUP BY 1""",
    "fasta_round_trip": _S + f" SELECT 'doc_' || doc_id AS record_id, length(seq) AS length, md5(seq) AS digest, CASE WHEN length(seq) >= 9 THEN {_RC.format('seq[2:9]')} END AS slice FROM seq",
}
