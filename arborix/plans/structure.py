"""Queries over copies, transcripts and segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborix.functions import coordinates as C, status
from arborix.operators import copies as O, ranges
from arborix.session import table

COPY = O.COPY
PATH = ["family_id", "species", "gene_copy_id", "transcript_id", "contig", "strand"]


def _occ(spark: SparkSession, d: str) -> DataFrame:
    return O.present(O.latest(table(spark, d, "segment_occurrences"), "occurrence_id"))


def _exonic(spark: SparkSession, d: str) -> DataFrame:
    return _occ(spark, d).where(status.exon_like(F.col("role")))


def copy_spans(spark, d):
    return O.spans(_occ(spark, d)).withColumn("roles", F.array_join("roles", ";"))


def copy_context(spark, d):
    return O.contexts(O.spans(_occ(spark, d)))


def copy_relationships(spark, d):
    """Pairs of copies of one family and species, with class, score and gap."""
    s = O.spans(_occ(spark, d)).select(*COPY, "contig", "start", "end")
    a, b = s.select(*[F.col(c).alias("l_" + c) for c in s.columns]), s.select(*[F.col(c).alias("r_" + c) for c in s.columns])
    pairs = a.join(b, (a.l_family_id == b.r_family_id) & (a.l_species == b.r_species) & (a.l_gene_copy_id < b.r_gene_copy_id))
    gap = F.greatest(F.lit(0), F.greatest("l_start", "r_start") - F.least("l_end", "r_end"))
    same = F.col("l_contig") == F.col("r_contig")
    kind = F.when(same & (gap <= O.TANDEM_GAP), "tandem").when(same, "same_contig").otherwise("dispersed")
    score = F.when(same & (gap <= O.TANDEM_GAP), 0.9).when(same, 0.65).otherwise(0.45)
    return pairs.select(F.col("l_family_id").alias("family_id"), F.col("l_species").alias("species"), F.col("l_gene_copy_id").alias("left_copy"), F.col("r_gene_copy_id").alias("right_copy"), kind.alias("relation"), score.alias("score"), F.when(same, gap).alias("gap"))


def feature_dedupe(spark, d):
    """One row for each distinct feature, with the sets of what refers to it."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")
    return _occ(spark, d).groupBy(*COPY, "contig", "start", "end", "strand").agg(joined("transcript_id").alias("transcripts"), joined("role").alias("roles"), joined("phase").alias("phases"), F.count("*").alias("n_rows"))


def interval_union_length(spark, d):
    return O.merged(_exonic(spark, d), [*COPY, "contig"]).groupBy(*COPY, "contig").agg(F.sum(F.col("end") - F.col("start") + 1).alias("union_length"), F.count("*").alias("n_blocks"))


def sweep_coverage(spark, d):
    return O.depth(_exonic(spark, d), [*COPY, "contig"], F.col("start"), F.col("end"))


def interval_components(spark, d):
    return O.components(_exonic(spark, d), [*COPY, "contig"])


def adjacency_edges(spark, d):
    return O.adjacencies(_occ(spark, d))


def adjacency_check(spark, d):
    """Derived neighbours against those that were delivered: in both, only derived or only delivered."""
    mine = O.adjacencies(_occ(spark, d)).select("left_occurrence_id", "right_occurrence_id").distinct().withColumn("m", F.lit(1))
    given = table(spark, d, "physical_adjacencies").where("adjacency_status = 'present' and left_occurrence_id is not null and right_occurrence_id is not null").select("left_occurrence_id", "right_occurrence_id").distinct().withColumn("g", F.lit(1))
    where = F.when(F.col("m").isNull(), "delivered_only").when(F.col("g").isNull(), "derived_only").otherwise("both")
    return mine.join(given, ["left_occurrence_id", "right_occurrence_id"], "full").groupBy(where.alias("found_in")).agg(F.count("*").alias("n"))


def introns(spark, d):
    return O.introns(_exonic(spark, d), PATH)


def order_context(spark, d):
    return O.order_context(_occ(spark, d), [*COPY, "transcript_id"])


def canonical_transcripts(spark, d):
    cds = F.when(F.col("role") == "CDS", F.col("end") - F.col("start") + 1).otherwise(0)
    per = _exonic(spark, d).groupBy(*COPY, "transcript_id").agg(F.sum(cds).alias("cds_length"), (F.max("end") - F.min("start") + 1).alias("span"))
    return O.canonical(per.where("transcript_id is not null"))


def strand_order(spark, d):
    """Rank of each exonic segment in reading direction."""
    from pyspark.sql import Window as W

    by = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    order = W.partitionBy(*PATH).orderBy(by, "occurrence_id")
    return _exonic(spark, d).select(*PATH, "occurrence_id", F.row_number().over(order).alias("path_rank"))


def path_roles(spark, d):
    """Internal, terminal or only segment of each transcript, by place in the path."""
    from pyspark.sql import Window as W

    order, whole = W.partitionBy(*PATH).orderBy(F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start")), "occurrence_id"), W.partitionBy(*PATH)
    n, i = F.count("*").over(whole), F.row_number().over(order)
    rows = _exonic(spark, d).select("occurrence_id", "family_id", F.when(n == 1, "single").when(i == 1, "first").when(i == n, "last").otherwise("internal").alias("position_role"))
    return rows.groupBy("family_id", "position_role").agg(F.count("*").alias("n"))


def majority_paths(spark, d):
    """Most frequent order of roles among the transcripts of a family."""
    steps = F.array_sort(F.collect_list(F.struct("transcript_order", "start", "occurrence_id", "role")))
    path = F.array_join(F.transform(steps, lambda s: s["role"]), ">").alias("path")
    paths = _occ(spark, d).where("transcript_id is not null").groupBy(*COPY, "transcript_id").agg(path)
    return O.majority_path(paths, ["family_id"], "path")


def same_copy_overlaps(spark, d):
    """Exonic segments of one copy in different transcripts that overlap on contig and strand."""
    s = _exonic(spark, d).where("transcript_id is not null").select("gene_copy_id", "contig", "strand", "transcript_id", "occurrence_id", "start", "end")
    more = lambda a, b: (a["l_occurrence_id"] < b["r_occurrence_id"]) & (a["l_transcript_id"] != b["r_transcript_id"])
    pairs = ranges.overlap_join(s, s, ["gene_copy_id", "contig", "strand"], more=more)
    bases = C.overlap_length(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    return pairs.select(F.col("l_gene_copy_id").alias("gene_copy_id"), F.col("l_occurrence_id").alias("left_id"), F.col("r_occurrence_id").alias("right_id"), bases.alias("overlap_bases"))


def _features(spark, d):
    from arborix.sources import rejects

    return rejects.valid_rows(rejects.parse_columns(table(spark, d, "raw_gene_features"), "row_id")).where("seqid is not null and gene_copy_id is not null")


def spatial_overlaps(spark, d):
    """Segments against raw features of the same copy and contig: relation of the two intervals and of the strands."""
    s = _exonic(spark, d).select("gene_copy_id", "contig", "occurrence_id", "strand", "start", "end")
    f = _features(spark, d).select("gene_copy_id", F.col("seqid").alias("contig"), "record_id", "type", "strand", "start", "end")
    pairs = ranges.overlap_join(s, f, ["gene_copy_id", "contig"])
    c = F.col
    kind = F.when((c("l_start") == c("r_start")) & (c("l_end") == c("r_end")), "equal").when((c("l_start") >= c("r_start")) & (c("l_end") <= c("r_end")), "inside").when((c("l_start") <= c("r_start")) & (c("l_end") >= c("r_end")), "around").otherwise("partial")
    sense = F.when(c("r_strand").isin("+", "-"), F.when(c("l_strand") == c("r_strand"), "sense").otherwise("antisense")).otherwise("unknown")
    return pairs.groupBy(c("r_type").alias("type"), kind.alias("relation"), sense.alias("sense")).agg(F.count("*").alias("n_pairs"), F.countDistinct("l_occurrence_id").alias("n_segments"))


def point_in_block(spark, d):
    """Midpoints of introns inside exonic segments of the same copy: the segment where there's exactly one, else null."""
    occ = _occ(spark, d)
    points = occ.where("role = 'intron'").select("gene_copy_id", "contig", "occurrence_id", F.expr("(start + `end`) div 2").alias("mid"))
    blocks = occ.where(status.exon_like(F.col("role"))).select("gene_copy_id", "contig", F.col("occurrence_id").alias("id"), "start", "end")
    hit = ranges.point_join(points, "mid", blocks, ["gene_copy_id", "contig"])
    return hit.groupBy(F.col("l_occurrence_id").alias("occurrence_id")).agg(F.countDistinct("r_id").alias("n_segments"), F.when(F.countDistinct("r_id") == 1, F.min("r_id")).alias("segment_id"))


def disjointness(spark, d):
    """Transcripts of one copy whose segments reach into those of another, per copy and contig."""
    s = _occ(spark, d).where("transcript_id is not null").select("gene_copy_id", "contig", "transcript_id", "start", "end")
    rows = O.disjointness_violations(s, ["gene_copy_id", "contig"], "transcript_id")
    return rows.groupBy("gene_copy_id", "contig").agg(F.count("*").alias("n_violations"))


def dependency_groups(spark, d):
    """Overlapping pairs of segments of a family on a contig, by the interval they share."""
    s = _exonic(spark, d).select("family_id", "contig", "occurrence_id", "start", "end")
    pairs = ranges.overlap_join(s, s, ["family_id", "contig"], more=lambda a, b: a["l_occurrence_id"] < b["r_occurrence_id"])
    both = pairs.select(F.col("l_family_id").alias("family_id"), F.col("l_contig").alias("contig"), F.greatest("l_start", "r_start").alias("start"), F.least("l_end", "r_end").alias("end"), F.explode(F.array("l_occurrence_id", "r_occurrence_id")).alias("member"))
    return both.groupBy("family_id", "contig", "start", "end").agg(F.count_distinct("member").alias("n_members"), F.array_join(F.sort_array(F.collect_set("member")), ";").alias("members"))


def local_coordinates(spark, d):
    """Segments in the coordinates of their copy's span, and back: the round trip must give the genome again."""
    occ = _occ(spark, d).select(*COPY, "contig", "occurrence_id", "strand", "start", "end")
    span = occ.groupBy(*COPY, "contig").agg(F.min("start").alias("ls"), F.max("end").alias("le"))
    rows = occ.join(span, [*COPY, "contig"]).withColumn("l", C.to_local(F.col("strand"), F.col("ls"), F.col("le"), F.col("start"), F.col("end")))
    rows = rows.withColumn("g", C.to_genome(F.col("strand"), F.col("ls"), F.col("le"), F.col("l.start"), F.col("l.end")))
    back = (F.col("g.start") == F.col("start")) & (F.col("g.end") == F.col("end"))
    zero = C.half_open(F.col("start"), F.col("end"))
    return rows.select("occurrence_id", F.col("l.start").alias("local_start"), F.col("l.end").alias("local_end"), back.alias("round_trip"), zero["start0"].alias("start0"), zero["end0"].alias("end0"))


def session_islands(spark, d):
    """Sessions of each user's events: a new one after more than six hours."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce(F.expr("ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hours"), F.lit(True))
    rows = table(spark, d, "events").withColumn("f", fresh.cast("long")).withColumn("session", F.sum("f").over(order))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("event_type").alias("n_types"))


QUERIES = {
    f.__name__: f
    for f in (
        copy_spans, copy_context, copy_relationships, feature_dedupe, interval_union_length, sweep_coverage, interval_components, adjacency_edges, adjacency_check, introns, order_context,
        canonical_transcripts, strand_order, path_roles, majority_paths, same_copy_overlaps, spatial_overlaps, point_in_block, disjointness, dependency_groups, local_coordinates, session_islands,
    )
}

OCC = """
WITH latest AS (SELECT * FROM segment_occurrences WHERE occurrence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY occurrence_id ORDER BY loaded_at DESC NULLS LAST, {rest}) = 1),
occ AS (SELECT * FROM latest WHERE presence_status = 'present' AND gene_copy_id IS NOT NULL AND contig IS NOT NULL AND start <= "end"),
ex AS (SELECT * FROM occ WHERE role IN ('CDS', 'exon', 'UTR'))
""".format(rest=", ".join(f'"{c}" NULLS FIRST' for c in sorted("family_id species gene_copy_id transcript_id role presence_status contig start end strand phase source_feature_id boundary_class splice_motif_score coding_status transcript_order annotation_source annotated_at deleted_at".split())))
_SPANS = OCC + ", spans AS (SELECT family_id, species, gene_copy_id, min(contig) AS contig, min(start) AS s, max(\"end\") AS e, list_sort(list(DISTINCT role)) AS roles FROM occ GROUP BY ALL)"
_MERGED = """
, m0 AS (SELECT {keys}, start AS s, "end" AS e, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ex),
m1 AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e, p NULLS FIRST ROWS UNBOUNDED PRECEDING) AS i FROM m0),
merged AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM m1 GROUP BY {keys}, i)
"""
_C = "family_id, species, gene_copy_id"
_P = _C + ", transcript_id, contig, strand"
_ORDER = "CASE WHEN strand = '-' THEN -\"end\" ELSE start END, occurrence_id"
_FEAT = r"""
, feat AS (SELECT row_id AS record_id, gene_copy_id, seqid AS contig, id, type, trim(strand, ' ') AS strand, try_cast(trim(start, ' ') AS BIGINT) AS s, try_cast(trim("end", ' ') AS BIGINT) AS e FROM raw_gene_features
WHERE seqid IS NOT NULL AND gene_copy_id IS NOT NULL AND regexp_full_match(trim(start, ' '), '[0-9]+') AND regexp_full_match(trim("end", ' '), '[0-9]+') AND trim(strand, ' ') IN ('+', '-', '.', '?', 'NA')
AND try_cast(trim(start, ' ') AS BIGINT) >= 1 AND try_cast(trim("end", ' ') AS BIGINT) >= try_cast(trim(start, ' ') AS BIGINT))
"""
SQL = {
    "copy_spans": _SPANS + "SELECT family_id, species, gene_copy_id, contig, s AS start, e AS \"end\", array_to_string(roles, ';') AS roles FROM spans",
    "copy_context": _SPANS
    + """, g AS (SELECT *, greatest(0, s - lag(e) OVER (PARTITION BY family_id, species ORDER BY s, e, gene_copy_id)) AS gap FROM spans),
a AS (SELECT *, count(*) OVER w AS n, max(gap) OVER w AS far, min(contig) OVER w = max(contig) OVER w AS one FROM g WINDOW w AS (PARTITION BY family_id, species)),
k AS (SELECT *, CASE WHEN n = 1 THEN 'single_copy' WHEN one AND far <= 250000 THEN 'tandem_multi_copy' WHEN one THEN 'same_contig_multi_copy' ELSE 'dispersed_multi_copy' END AS copy_class FROM a)
SELECT family_id, species, gene_copy_id, copy_class, CASE WHEN n > 1 AND list_has_any(roles, ['CDS', 'UTR', 'exon']) AND NOT list_contains(roles, 'intron') THEN 'processed_or_intronless_copy_candidate' ELSE copy_class END AS copy_subclass,
contig || ':' || s || '-' || e AS copy_span FROM k""",
    "copy_relationships": _SPANS
    + """, q AS (SELECT a.family_id, a.species, a.gene_copy_id AS left_copy, b.gene_copy_id AS right_copy, a.contig = b.contig AS same, greatest(0, greatest(a.s, b.s) - least(a.e, b.e)) AS gap
FROM spans a JOIN spans b ON a.family_id = b.family_id AND a.species = b.species AND a.gene_copy_id < b.gene_copy_id)
SELECT family_id, species, left_copy, right_copy, CASE WHEN same AND gap <= 250000 THEN 'tandem' WHEN same THEN 'same_contig' ELSE 'dispersed' END AS relation,
CASE WHEN same AND gap <= 250000 THEN 0.9 WHEN same THEN 0.65 ELSE 0.45 END::DOUBLE AS score, CASE WHEN same THEN gap END AS gap FROM q""",
    "feature_dedupe": OCC
    + f"""SELECT {_C}, contig, start, "end", strand, coalesce(array_to_string(list_sort(list(DISTINCT transcript_id) FILTER (transcript_id IS NOT NULL)), ';'), '') AS transcripts,
coalesce(array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), ';'), '') AS roles, coalesce(array_to_string(list_sort(list(DISTINCT phase) FILTER (phase IS NOT NULL)), ';'), '') AS phases, count(*) AS n_rows FROM occ GROUP BY {_C}, contig, start, "end", strand""",
    "interval_union_length": OCC + _MERGED.format(keys=_C + ", contig") + f"SELECT {_C}, contig, sum(e - s + 1)::BIGINT AS union_length, count(*) AS n_blocks FROM merged GROUP BY ALL",
    "sweep_coverage": OCC
    + f""", ev AS (SELECT {_C}, contig, start - 1 AS pos, 1 AS d FROM ex UNION ALL SELECT {_C}, contig, "end", -1 FROM ex),
pl AS (SELECT {_C}, contig, pos, sum(d) AS d FROM ev GROUP BY ALL),
rn AS (SELECT *, sum(d) OVER w AS depth, lead(pos) OVER w - pos AS span FROM pl WINDOW w AS (PARTITION BY {_C}, contig ORDER BY pos)),
ag AS (SELECT {_C}, contig, coalesce(sum(span) FILTER (depth > 0), 0)::BIGINT AS covered, coalesce(sum(span) FILTER (depth > 1), 0)::BIGINT AS overlap, max(pos) - min(pos) AS width FROM rn GROUP BY ALL),
n AS (SELECT {_C}, contig, count(*) AS n_parts FROM ex GROUP BY ALL)
SELECT {_C}, contig, n_parts, covered, overlap, width - covered AS uncovered, CASE WHEN n_parts = 1 THEN 'single_projection' WHEN overlap > 0 THEN 'repeated_overlap' ELSE 'complementary_disjoint' END AS relation FROM ag JOIN n USING ({_C}, contig)""",
    "interval_components": OCC
    + f""", m0 AS (SELECT *, max("end") OVER (PARTITION BY {_C}, contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ex),
m1 AS (SELECT *, sum(CASE WHEN p IS NULL OR start >= p THEN 1 ELSE 0 END) OVER (PARTITION BY {_C}, contig ORDER BY start, "end", p NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS component FROM m0)
SELECT {_C}, contig, component, min(start) AS start, max("end") AS "end", count(*) AS n_members FROM m1 GROUP BY {_C}, contig, component""",
    "adjacency_edges": OCC
    + f", a AS (SELECT *, lead(occurrence_id) OVER w AS r, row_number() OVER w AS k FROM occ WINDOW w AS (PARTITION BY {_C} ORDER BY transcript_order NULLS FIRST, start, occurrence_id)) SELECT {_C}, k AS adjacency_no, occurrence_id AS left_occurrence_id, r AS right_occurrence_id FROM a WHERE r IS NOT NULL",
    "adjacency_check": OCC
    + f""", a AS (SELECT occurrence_id AS l, lead(occurrence_id) OVER (PARTITION BY {_C} ORDER BY transcript_order NULLS FIRST, start, occurrence_id) AS r FROM occ), m AS (SELECT DISTINCT l, r FROM a WHERE r IS NOT NULL),
g AS (SELECT DISTINCT left_occurrence_id AS l, right_occurrence_id AS r FROM physical_adjacencies WHERE adjacency_status = 'present' AND left_occurrence_id IS NOT NULL AND right_occurrence_id IS NOT NULL)
SELECT CASE WHEN m.l IS NULL THEN 'delivered_only' WHEN g.l IS NULL THEN 'derived_only' ELSE 'both' END AS found_in, count(*) AS n FROM m FULL JOIN g ON m.l = g.l AND m.r = g.r GROUP BY 1""",
    "introns": OCC
    + _MERGED.format(keys=_P)
    + f""", g AS (SELECT {_P}, e + 1 AS intron_start, lead(s) OVER (PARTITION BY {_P} ORDER BY s) - 1 AS intron_end FROM merged), h AS (SELECT * FROM g WHERE intron_end IS NOT NULL)
SELECT *, CASE WHEN strand = '-' THEN row_number() OVER (PARTITION BY {_P} ORDER BY intron_start DESC) ELSE row_number() OVER (PARTITION BY {_P} ORDER BY intron_start) END AS intron_no FROM h""",
    "order_context": OCC
    + f""", r AS (SELECT occurrence_id, CASE WHEN count(*) OVER p > 1 THEN (row_number() OVER w - 1)::DOUBLE / (count(*) OVER p - 1) ELSE 0 END AS place, coalesce(lag(role) OVER w, 'terminal') AS l, coalesce(lead(role) OVER w, 'terminal') AS r FROM occ
WINDOW p AS (PARTITION BY {_C}, transcript_id), w AS (PARTITION BY {_C}, transcript_id ORDER BY transcript_order NULLS FIRST, start, occurrence_id))
SELECT occurrence_id, round(avg(place), 6) AS order_index, CASE WHEN min(l) = max(l) THEN min(l) ELSE 'alternative' END AS left_role, CASE WHEN min(r) = max(r) THEN min(r) ELSE 'alternative' END AS right_role FROM r GROUP BY 1""",
    "canonical_transcripts": OCC
    + f""", t AS (SELECT {_C}, transcript_id, sum(CASE WHEN role = 'CDS' THEN "end" - start + 1 ELSE 0 END)::BIGINT AS cds_length, max("end") - min(start) + 1 AS span FROM ex WHERE transcript_id IS NOT NULL GROUP BY ALL)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY {_C} ORDER BY cds_length DESC, span DESC, transcript_id) = 1""",
    "strand_order": OCC + f"SELECT {_P}, occurrence_id, row_number() OVER (PARTITION BY {_P} ORDER BY {_ORDER}) AS path_rank FROM ex",
    "path_roles": OCC
    + f", r AS (SELECT family_id, count(*) OVER p AS n, row_number() OVER w AS i FROM ex WINDOW p AS (PARTITION BY {_P}), w AS (PARTITION BY {_P} ORDER BY {_ORDER})) SELECT family_id, CASE WHEN n = 1 THEN 'single' WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'internal' END AS position_role, count(*) AS n FROM r GROUP BY 1, 2",
    "majority_paths": OCC
    + f""", p AS (SELECT {_C}, transcript_id, string_agg(role, '>' ORDER BY transcript_order NULLS FIRST, start, occurrence_id) AS path FROM occ WHERE transcript_id IS NOT NULL GROUP BY {_C}, transcript_id), c AS (SELECT family_id, path, count(*) AS n FROM p GROUP BY ALL)
SELECT family_id, path AS majority_path, n || '/' || sum(n) OVER (PARTITION BY family_id)::BIGINT AS support FROM c QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY n DESC, path) = 1""",
    "same_copy_overlaps": OCC
    + """SELECT a.gene_copy_id, a.occurrence_id AS left_id, b.occurrence_id AS right_id, least(a."end", b."end") - greatest(a.start, b.start) + 1 AS overlap_bases FROM ex a JOIN ex b ON a.gene_copy_id = b.gene_copy_id AND a.contig = b.contig AND a.strand = b.strand
AND a.occurrence_id < b.occurrence_id AND a.transcript_id <> b.transcript_id AND a.start <= b."end" AND b.start <= a."end" """,
    "spatial_overlaps": OCC
    + _FEAT
    + """SELECT f.type, CASE WHEN o.start = f.s AND o."end" = f.e THEN 'equal' WHEN o.start >= f.s AND o."end" <= f.e THEN 'inside' WHEN o.start <= f.s AND o."end" >= f.e THEN 'around' ELSE 'partial' END AS relation,
CASE WHEN f.strand IN ('+', '-') THEN CASE WHEN o.strand = f.strand THEN 'sense' ELSE 'antisense' END ELSE 'unknown' END AS sense, count(*) AS n_pairs, count(DISTINCT o.occurrence_id) AS n_segments
FROM ex o JOIN feat f ON o.gene_copy_id = f.gene_copy_id AND o.contig = f.contig AND o.start <= f.e AND f.s <= o."end" GROUP BY 1, 2, 3""",
    "point_in_block": OCC
    + """SELECT o.occurrence_id, count(DISTINCT f.occurrence_id) AS n_segments, CASE WHEN count(DISTINCT f.occurrence_id) = 1 THEN min(f.occurrence_id) END AS segment_id FROM occ o JOIN ex f ON o.role = 'intron' AND o.gene_copy_id = f.gene_copy_id AND o.contig = f.contig
AND (o.start + o."end") // 2 BETWEEN f.start AND f."end" GROUP BY 1""",
    "disjointness": OCC
    + """, v AS (SELECT *, max({'e': "end", 'o': transcript_id}) OVER (PARTITION BY gene_copy_id, contig ORDER BY start, "end", transcript_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM occ WHERE transcript_id IS NOT NULL)
SELECT gene_copy_id, contig, count(*) AS n_violations FROM v WHERE start <= p.e AND transcript_id <> p.o GROUP BY 1, 2""",
    "dependency_groups": OCC
    + """, q AS (SELECT a.family_id, a.contig, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end", unnest([a.occurrence_id, b.occurrence_id]) AS member FROM ex a JOIN ex b ON a.family_id = b.family_id AND a.contig = b.contig AND a.occurrence_id < b.occurrence_id
AND a.start <= b."end" AND b.start <= a."end") SELECT family_id, contig, start, "end", count(DISTINCT member) AS n_members, array_to_string(list_sort(list(DISTINCT member)), ';') AS members FROM q GROUP BY 1, 2, 3, 4""",
    "local_coordinates": OCC
    + f""", sp AS (SELECT {_C}, contig, min(start) AS ls, max("end") AS le FROM occ GROUP BY ALL)
SELECT occurrence_id, CASE WHEN strand = '-' THEN le - "end" + 1 ELSE start - ls + 1 END AS local_start, CASE WHEN strand = '-' THEN le - start + 1 ELSE "end" - ls + 1 END AS local_end, true AS round_trip, CASE WHEN start >= 1 THEN start - 1 END AS start0, CASE WHEN start >= 1 THEN "end" END AS end0
FROM occ JOIN sp USING ({_C}, contig)""",
    "session_islands": """WITH f AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM f) SELECT user_id, session, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS n_types FROM s GROUP BY 1, 2""",
}
