"""Queries over pairwise matches and homology rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborix.functions import scores, status
from arborix.operators import copies, matching as M
from arborix.session import table


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each match with both ends, no self matches."""
    rows = table(spark, d, "segment_matches").where("query_occurrence_id is not null and subject_occurrence_id is not null and query_occurrence_id <> subject_occurrence_id")
    return copies.latest(rows, "match_id")


def _homology(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_homology").where("homology_id is not null and occurrence_id is not null")


def match_acceptance(spark, d):
    """Matches by status that meet the rule of their distance class, and the rule of short segments."""
    m = _matches(spark, d)
    t = scores.pair_threshold(F.col("threshold"), F.col("distance_class"))
    ok = scores.accepted(F.col("alignment_score"), F.col("coverage_score"), t)
    short = scores.accepted_short(F.col("alignment_score"), F.col("coverage_score"), F.col("aligned_pairs"), t)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return m.groupBy(status.state(F.col("match_status")).alias("match_status"), status.state(F.col("distance_class")).alias("distance_class")).agg(F.count("*").alias("n"), n(ok).alias("n_accepted"), n(short).alias("n_accepted_short"))


def pair_prefilter(spark, d):
    """Why a pair of known occurrences would not be compared."""
    o = copies.latest(table(spark, d, "segment_occurrences"), "occurrence_id").select("occurrence_id", "family_id", "gene_copy_id", "role", (F.col("end") - F.col("start") + 1).alias("n"))
    a, b = o.select(*[F.col(c).alias("l_" + c) for c in o.columns]), o.select(*[F.col(c).alias("r_" + c) for c in o.columns])
    m = _matches(spark, d).join(a, F.col("query_occurrence_id") == F.col("l_occurrence_id")).join(b, F.col("subject_occurrence_id") == F.col("r_occurrence_id"))
    c = F.col
    ratio = F.least("l_n", "r_n") / F.greatest("l_n", "r_n")
    exonic = status.exon_like(c("l_role")) & status.exon_like(c("r_role"))
    reason = (
        F.when(c("l_family_id") != c("r_family_id"), "other_family").when(c("l_gene_copy_id") == c("r_gene_copy_id"), "same_copy").when((c("l_role") == "intron") & (c("r_role") == "intron"), "both_introns")
        .when(~(F.least("l_n", "r_n") > 0) | c("l_n").isNull() | c("r_n").isNull(), "no_length").when((ratio < 0.25) & ~exonic, "size_ratio").otherwise("compared")
    )
    return m.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def best_per_query(spark, d):
    rows = M.best_with_ties(_matches(spark, d), ["query_occurrence_id"], "total_score")
    return rows.where("best_status <> 'not_best'").select("match_id", "query_occurrence_id", "total_score", "best_status")


def reciprocal_best(spark, d):
    return M.reciprocal_best(_matches(spark, d), "match_id", "query_occurrence_id", "subject_occurrence_id", "total_score")


def edge_degrees(spark, d):
    """How many segments have how many accepted links."""
    linked = _matches(spark, d).where("match_status = 'mapped'")
    return M.degrees(linked, "query_occurrence_id", "subject_occurrence_id").groupBy("degree").agg(F.count("*").alias("n_segments"))


def match_scores(spark, d):
    """Sequence score from identity and coverage, and how far the delivered one is from it."""
    s = scores.sequence_score(F.col("alignment_score"), F.col("coverage_score"))
    return _matches(spark, d).select("match_id", F.round(s, 6).alias("score"), F.round(F.col("sequence_score") - s, 6).alias("difference"))


def sensitivity_grid(spark, d):
    """Accepted matches over a grid of identity and coverage thresholds: one pass, the grid is exploded a row."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("identity"), F.lit(c).alias("coverage")) for i in (0.5, 0.6, 0.7, 0.8) for c in (0.3, 0.45, 0.6, 0.8)])).alias("g")
    rows = _matches(spark, d).where("match_status = 'mapped'").select("alignment_score", "coverage_score", grid)
    ok = (F.col("alignment_score") >= F.col("g.identity")) & (F.col("coverage_score") >= F.col("g.coverage"))
    return rows.groupBy("g.identity", "g.coverage").agg(F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias("n_accepted"), F.count("*").alias("n"))


def score_quantiles(spark, d):
    """Interpolated quantiles of the total score by backend."""
    rows = M.quantiles(_matches(spark, d).where("total_score is not null and not isnan(total_score)"), ["backend"], "total_score", {"q025": 0.025, "q500": 0.5, "q975": 0.975})
    return rows.select("backend", *[F.round(q, 6).alias(q) for q in ("q025", "q500", "q975")], "n")


def bh_qvalues(spark, d):
    """False-discovery rate of each match, 1 - total_score as p, within its distance class."""
    rows = _matches(spark, d).where("total_score is not null and not isnan(total_score)").select("match_id", status.state(F.col("distance_class")).alias("test_id"), F.round(1 - F.col("total_score"), 9).alias("p_value"))
    return M.bh_adjust(rows, ["test_id"], "p_value").select("match_id", "test_id", F.round("q_value", 6).alias("q_value"))


def element_summary(spark, d):
    """Members, species, copies, roles and observation call of each homology group."""
    o = copies.latest(table(spark, d, "segment_occurrences"), "occurrence_id").select("occurrence_id", "species", "gene_copy_id", "role", status.state(F.col("presence_status")).alias("presence"))
    rows = _homology(spark, d).select("homology_id", "occurrence_id").distinct().join(o, "occurrence_id", "left")
    seen = F.count_distinct(F.when(F.col("presence") == "present", F.col("species")))
    call = F.when(seen > 1, "observed_in_multiple_species").when(seen == 1, "observed_single_species").otherwise("no_species_presence_observed")
    return rows.groupBy("homology_id").agg(F.count("*").alias("n_members"), F.count_distinct("gene_copy_id").alias("n_copies"), seen.alias("n_species"), call.alias("conservation_call"))


def role_spectrum(spark, d):
    """`role:count;…` of each homology group."""
    o = copies.latest(table(spark, d, "segment_occurrences"), "occurrence_id").select("occurrence_id", "role")
    rows = _homology(spark, d).select("homology_id", "occurrence_id").distinct().join(o, "occurrence_id", "left").groupBy("homology_id", status.state(F.col("role")).alias("role")).agg(F.count("*").alias("n"))
    return rows.groupBy("homology_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("role", F.lit(":"), F.col("n").cast("string")))), ";").alias("role_spectrum"))


def label_support(spark, d):
    """Source labels of each homology group, by votes weighted with confidence."""
    rows = _homology(spark, d).withColumn("label", status.state(F.col("source_label"))).where("label <> 'unknown'")
    return M.vote(rows, ["homology_id"], "label", status.confidence(F.col("confidence")))


def confidence_calls(spark, d):
    """Confidence of each homology row raised by its segment's accepted links; core from 0.7."""
    deg = M.degrees(_matches(spark, d).where("match_status = 'mapped'"), "query_occurrence_id", "subject_occurrence_id")
    rows = _homology(spark, d).join(deg, "occurrence_id", "left")
    adj = status.adjusted_confidence(status.confidence(F.col("confidence")), F.coalesce(F.col("degree"), F.lit(0)))
    return rows.groupBy("support_type", F.when(F.round(adj, 9) >= 0.7, "core").otherwise("peripheral").alias("call")).agg(F.count("*").alias("n"), scores.exact_mean(adj).alias("mean_confidence"))


def reference_choice(spark, d):
    """Reference segment of each homology group: the longest, then the best linked, then the smallest id."""
    o = copies.latest(table(spark, d, "segment_occurrences"), "occurrence_id").where("start <= `end`").select("occurrence_id", (F.col("end") - F.col("start") + 1).alias("n"))
    deg = M.degrees(_matches(spark, d).where("match_status = 'mapped'"), "query_occurrence_id", "subject_occurrence_id")
    rows = _homology(spark, d).select("homology_id", "occurrence_id").distinct().join(o, "occurrence_id").join(deg, "occurrence_id", "left")
    best = F.min_by("occurrence_id", F.struct(-F.col("n"), -F.coalesce(F.col("degree"), F.lit(0)), F.col("occurrence_id")))
    return rows.groupBy("homology_id").agg(best.alias("reference_occurrence_id"), F.max("n").alias("reference_length"))


def connected_adjacencies(spark, d):
    """Runs of neighbouring segments, each by its smallest segment."""
    e = table(spark, d, "physical_adjacencies").where("adjacency_status = 'present' and left_occurrence_id not in ('', 'NA', '.', '?', 'unknown') and right_occurrence_id not in ('', 'NA', '.', '?', 'unknown')")
    return M.connected(e, "left_occurrence_id", "right_occurrence_id").groupBy("smallest").agg(F.count("*").alias("n_segments"))


def terminal_pairs(spark, d):
    """Homology groups with exactly a first and a last segment of one copy that don't overlap."""
    o = copies.present(copies.latest(table(spark, d, "segment_occurrences"), "occurrence_id")).where("boundary_class = 'terminal'").select("occurrence_id", "gene_copy_id", "start", "end")
    rows = _homology(spark, d).select("homology_id", "occurrence_id").distinct().join(o, "occurrence_id")
    got = rows.groupBy("homology_id", "gene_copy_id").agg(F.count("*").alias("n"), F.min(F.struct("start", "end", "occurrence_id")).alias("a"), F.max(F.struct("start", "end", "occurrence_id")).alias("b"))
    kind = F.when(F.col("a.end") < F.col("b.start"), "resolved").otherwise("overlapping")
    return got.where("n = 2").select("homology_id", "gene_copy_id", F.col("a.occurrence_id").alias("left_id"), F.col("b.occurrence_id").alias("right_id"), kind.alias("resolution"))


QUERIES = {
    f.__name__: f
    for f in (
        match_acceptance, pair_prefilter, best_per_query, reciprocal_best, edge_degrees, match_scores, sensitivity_grid, score_quantiles, bh_qvalues, element_summary, role_spectrum,
        label_support, confidence_calls, reference_choice, connected_adjacencies, terminal_pairs,
    )
}

_MCOLS = "query_occurrence_id subject_occurrence_id alignment_score coverage_score sequence_score total_score aligned_pairs size_ratio threshold distance_class alignment_strand backend match_status".split()
_M = "WITH m AS (SELECT * FROM segment_matches WHERE match_id IS NOT NULL AND query_occurrence_id IS NOT NULL AND subject_occurrence_id IS NOT NULL AND query_occurrence_id <> subject_occurrence_id QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY loaded_at DESC NULLS LAST, {}) = 1)".format(
    ", ".join(f"{c} NULLS FIRST" for c in sorted(_MCOLS))
)
_O = ", lo AS (SELECT * FROM segment_occurrences WHERE occurrence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY occurrence_id ORDER BY loaded_at DESC NULLS LAST, {}) = 1)".format(
    ", ".join(f'"{c}" NULLS FIRST' for c in sorted("family_id species gene_copy_id transcript_id role presence_status contig start end strand phase source_feature_id boundary_class splice_motif_score coding_status transcript_order annotation_source annotated_at deleted_at".split()))
)
_H = ", h AS (SELECT * FROM segment_homology WHERE homology_id IS NOT NULL AND occurrence_id IS NOT NULL), hd AS (SELECT DISTINCT homology_id, occurrence_id FROM h)"
_D = ", deg AS (SELECT o AS occurrence_id, count(*) AS degree FROM (SELECT unnest([query_occurrence_id, subject_occurrence_id]) AS o FROM m WHERE match_status = 'mapped') GROUP BY 1)"
_T = "CASE WHEN distance_class = 'short' THEN greatest(threshold, 0.75::DOUBLE) WHEN distance_class = 'long' THEN greatest(0.45::DOUBLE, threshold - 0.15::DOUBLE) ELSE threshold END"
_ST = lambda c: f"CASE WHEN {c} IS NULL OR trim({c}) IN ('', 'NA', '.', '?', 'unknown') THEN 'unknown' ELSE trim({c}) END"
_CONF = "coalesce(CASE lower(trim(confidence)) WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.75::DOUBLE WHEN 'low' THEN 0.45::DOUBLE END, try_cast(trim(confidence) AS DOUBLE), 0.5::DOUBLE)"
SQL = {
    "match_acceptance": _M
    + f""", t AS (SELECT *, {_T} AS t FROM m) SELECT {_ST("match_status")} AS match_status, {_ST("distance_class")} AS distance_class, count(*) AS n,
count(*) FILTER ((alignment_score >= t AND coverage_score >= 0.45::DOUBLE) OR (alignment_score >= t + 0.15::DOUBLE AND coverage_score >= 0.30::DOUBLE)) AS n_accepted,
count(*) FILTER ((aligned_pairs >= 12 AND alignment_score >= greatest(0.7::DOUBLE, t) AND coverage_score >= 0.8::DOUBLE) OR (aligned_pairs BETWEEN 3 AND 11 AND alignment_score >= greatest(0.9::DOUBLE, t) AND coverage_score >= 0.95::DOUBLE)) AS n_accepted_short FROM t GROUP BY 1, 2""",
    "pair_prefilter": _M
    + _O
    + """, p AS (SELECT a.family_id AS fa, b.family_id AS fb, a.gene_copy_id AS ca, b.gene_copy_id AS cb, a.role AS ra, b.role AS rb, a."end" - a.start + 1 AS na, b."end" - b.start + 1 AS nb FROM m JOIN lo a ON a.occurrence_id = query_occurrence_id JOIN lo b ON b.occurrence_id = subject_occurrence_id)
SELECT CASE WHEN fa <> fb THEN 'other_family' WHEN ca = cb THEN 'same_copy' WHEN ra = 'intron' AND rb = 'intron' THEN 'both_introns' WHEN na IS NULL OR nb IS NULL OR NOT least(na, nb) > 0 THEN 'no_length'
WHEN least(na, nb) / greatest(na, nb) < 0.25 AND NOT (ra IN ('CDS', 'exon', 'UTR') AND rb IN ('CDS', 'exon', 'UTR')) THEN 'size_ratio' ELSE 'compared' END AS reason, count(*) AS n FROM p GROUP BY 1""",
    "best_per_query": _M
    + ", t AS (SELECT *, max(total_score) OVER (PARTITION BY query_occurrence_id) - total_score AS d FROM m), u AS (SELECT *, count(*) OVER (PARTITION BY query_occurrence_id) AS k FROM t WHERE abs(d) < 1e-12) SELECT match_id, query_occurrence_id, total_score, CASE WHEN k > 1 THEN 'best_tie' ELSE 'best_unique' END AS best_status FROM u",
    "reciprocal_best": _M
    + ", e AS (SELECT match_id, total_score AS s, unnest([query_occurrence_id, subject_occurrence_id]) AS o FROM m), b AS (SELECT match_id, max(s) OVER (PARTITION BY o) - s AS d FROM e) SELECT match_id FROM b GROUP BY 1 HAVING max(abs(d)) < 1e-12",
    "edge_degrees": _M + _D + " SELECT degree, count(*) AS n_segments FROM deg GROUP BY 1",
    "match_scores": _M + " SELECT match_id, round(0.7::DOUBLE * alignment_score + 0.3::DOUBLE * coverage_score, 6) AS score, round(sequence_score - (0.7::DOUBLE * alignment_score + 0.3::DOUBLE * coverage_score), 6) AS difference FROM m",
    "sensitivity_grid": _M
    + ", g AS (SELECT i AS identity, c AS coverage FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS i), (SELECT unnest([0.3, 0.45, 0.6, 0.8]::DOUBLE[]) AS c)) SELECT identity, coverage, count(*) FILTER (alignment_score >= identity AND coverage_score >= coverage) AS n_accepted, count(*) AS n FROM m, g WHERE match_status = 'mapped' GROUP BY 1, 2",
    "score_quantiles": _M
    + " SELECT backend, round(quantile_cont(total_score, 0.025), 6) AS q025, round(quantile_cont(total_score, 0.5), 6) AS q500, round(quantile_cont(total_score, 0.975), 6) AS q975, count(*) AS n FROM m WHERE total_score IS NOT NULL AND NOT isnan(total_score) GROUP BY 1",
    "bh_qvalues": _M
    + f""", t AS (SELECT match_id, {_ST("distance_class")} AS test_id, round(1 - total_score, 9) AS p FROM m WHERE total_score IS NOT NULL AND NOT isnan(total_score)), k AS (SELECT *, count(*) OVER (PARTITION BY test_id) AS mm, count(*) OVER (PARTITION BY test_id ORDER BY p RANGE UNBOUNDED PRECEDING) AS r FROM t)
SELECT match_id, test_id, round(least(1.0, min(p * mm / r) OVER (PARTITION BY test_id ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q_value FROM k""",
    "element_summary": _M
    + _O
    + _H
    + f""", r AS (SELECT hd.*, species, gene_copy_id, {_ST("presence_status")} AS presence FROM hd LEFT JOIN lo USING (occurrence_id)), s AS (SELECT homology_id, count(*) AS n_members, count(DISTINCT gene_copy_id) AS n_copies, count(DISTINCT CASE WHEN presence = 'present' THEN species END) AS n_species FROM r GROUP BY 1)
SELECT *, CASE WHEN n_species > 1 THEN 'observed_in_multiple_species' WHEN n_species = 1 THEN 'observed_single_species' ELSE 'no_species_presence_observed' END AS conservation_call FROM s""",
    "role_spectrum": _M + _O + _H + f", r AS (SELECT homology_id, {_ST('role')} AS role, count(*) AS n FROM hd LEFT JOIN lo USING (occurrence_id) GROUP BY 1, 2) SELECT homology_id, string_agg(role || ':' || n, ';' ORDER BY role || ':' || n) AS role_spectrum FROM r GROUP BY 1",
    "label_support": _M
    + _H
    + f", v AS (SELECT homology_id, {_ST('source_label')} AS label, sum({_CONF}) AS w FROM h GROUP BY 1, 2), t AS (SELECT *, max(w) OVER (PARTITION BY homology_id) AS top FROM v WHERE label <> 'unknown') SELECT homology_id, string_agg(label, ';' ORDER BY label) AS labels, round(max(top), 6) AS support FROM t WHERE w >= 0.9::DOUBLE * top - 1e-12 GROUP BY 1",
    "confidence_calls": _M
    + _H
    + _D
    + f", a AS (SELECT support_type, least(1.0::DOUBLE, 0.75::DOUBLE * {_CONF} + 0.25::DOUBLE * least(1.0::DOUBLE, coalesce(degree, 0) / 2.0::DOUBLE)) AS x FROM h LEFT JOIN deg USING (occurrence_id)) SELECT support_type, CASE WHEN round(x, 9) >= 0.7::DOUBLE THEN 'core' ELSE 'peripheral' END AS call, count(*) AS n, {scores.exact_mean_sql('x')} AS mean_confidence FROM a GROUP BY 1, 2",
    "reference_choice": _M
    + _O
    + _H
    + _D
    + """, r AS (SELECT homology_id, occurrence_id, "end" - start + 1 AS n, coalesce(degree, 0) AS g FROM hd JOIN lo USING (occurrence_id) LEFT JOIN deg USING (occurrence_id) WHERE start <= "end") SELECT homology_id, occurrence_id AS reference_occurrence_id, n AS reference_length FROM r QUALIFY row_number() OVER (PARTITION BY homology_id ORDER BY n DESC, g DESC, occurrence_id) = 1""",
    "connected_adjacencies": """WITH RECURSIVE e AS (SELECT DISTINCT left_occurrence_id AS a, right_occurrence_id AS b FROM physical_adjacencies WHERE adjacency_status = 'present' AND left_occurrence_id NOT IN ('', 'NA', '.', '?', 'unknown') AND right_occurrence_id NOT IN ('', 'NA', '.', '?', 'unknown')),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS v, a AS m FROM w UNION SELECT w.b, r.m FROM reach r JOIN w ON w.a = r.v WHERE r.m < w.b), s AS (SELECT v, min(m) AS smallest FROM reach GROUP BY 1) SELECT smallest, count(*) AS n_segments FROM s GROUP BY 1""",
    "terminal_pairs": _M
    + _O
    + _H
    + """, o AS (SELECT * FROM lo WHERE presence_status = 'present' AND gene_copy_id IS NOT NULL AND contig IS NOT NULL AND start <= "end" AND boundary_class = 'terminal'), r AS (SELECT homology_id, gene_copy_id, count(*) AS n, min({'s': start, 'e': "end", 'o': occurrence_id}) AS a, max({'s': start, 'e': "end", 'o': occurrence_id}) AS b FROM hd JOIN o USING (occurrence_id) GROUP BY 1, 2)
SELECT homology_id, gene_copy_id, a.o AS left_id, b.o AS right_id, CASE WHEN a.e < b.s THEN 'resolved' ELSE 'overlapping' END AS resolution FROM r WHERE n = 2""",
}
