"""Queries of the interval, reference, parsing and hierarchy problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborix.operators import forest
from arborix.operators.intervals import periods_and_gaps
from arborix.operators.orphans import Reference, orphans
from arborix.session import table
from arborix.sources import rejects


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "segment_occurrences"), ["gene_copy_id", "contig"])


def p1_copy_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per gene copy and contig: periods, gaps and the bases in each."""
    is_period, span = F.col("kind") == "period", F.col("end_pos") - F.col("start_pos") + 1
    count = lambda c: F.sum(c.cast("long"))
    return p1_found(spark, d).groupBy("gene_copy_id", "contig").agg(
        count(is_period).alias("n_periods"), count(~is_period).alias("n_gaps"), F.sum(F.when(is_period, span).otherwise(0)).alias("covered_bases"), F.sum(F.when(is_period, 0).otherwise(span)).alias("gap_bases")
    )


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = [
        Reference("segment_homology", table(spark, d, "segment_homology"), "homology_id", ("occurrence_id",)),
        Reference("physical_adjacencies", table(spark, d, "physical_adjacencies"), "adjacency_id", ("left_occurrence_id", "right_occurrence_id")),
    ]
    return orphans(table(spark, d, "segment_occurrences"), "occurrence_id", refs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "record_key", "field_name", F.col("ref").alias("occurrence_id")).distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows per table and month of loaded_at, by cause."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    n = lambda c: F.sum((F.col("cause") == c).cast("long")).alias(f"n_{c}")
    return _orphans(spark, d).groupBy("table_name", month).agg(F.count("*").alias("n_orphans"), n("missing"), n("later"), n("withdrawn"))


def _parsed(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    return [
        ("raw_gene_features", rejects.parse_columns(table(spark, d, "raw_gene_features"), "row_id")),
        ("raw_feature_lines", rejects.parse_lines(table(spark, d, "raw_feature_lines"), "line_id", "raw_line")),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = [rejects.failures(rows, name) for name, rows in _parsed(spark, d)]
    return a.unionByName(b)


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    """The rows that load, with typed coordinates."""
    a, b = [rejects.valid_rows(rows).withColumn("source_table", F.lit(name)) for name, rows in _parsed(spark, d)]
    return a.unionByName(b).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def _species(spark: SparkSession, d: str) -> DataFrame:
    return forest.nodes(table(spark, d, "species_tree"), F.lit(""), F.col("node_id"), F.col("parent_id"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return forest.nodes(table(spark, d, "raw_gene_features"), F.col("gene_copy_id"), F.col("id"), F.col("parent"))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Both sources in one forest: the source is the first letter of the scope."""
    tag = lambda rows, t: rows.withColumn("scope", F.concat(F.lit(t), "scope"))
    return tag(_features(spark, d), "f").unionByName(tag(_species(spark, d), "s"))


def _untag(rows: DataFrame, *rest: str) -> DataFrame:
    source = F.when(F.substr("scope", F.lit(1), F.lit(1)) == "s", "species_tree").otherwise("raw_gene_features")
    return rows.select(source.alias("source_table"), F.substr("scope", F.lit(2)).alias("scope_key"), *rest)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _untag(forest.Forest(_both(spark, d)).endless().withColumnRenamed("node", "node_key"), "node_key", "cycle_key")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth, path (joined with /) and number of descendants of each node whose chain ends."""
    rows = forest.hierarchy(_both(spark, d)).withColumnsRenamed({"node": "node_key", "root": "root_key"}).withColumn("path", F.array_join("path", "/"))
    return _untag(rows, "node_key", "root_key", "depth", "path", "n_descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each node with each of its descendants and their distance."""
    pairs = forest.descendants(forest.hierarchy(_both(spark, d))).withColumnsRenamed({"node": "node_key", "ancestor": "ancestor_key"})
    return _untag(pairs, "ancestor_key", "node_key", "distance")


QUERIES = {f.__name__: f for f in (p1_found, p1_copy_coverage, p3_found, p3_counts, p4_found, p4_valid, p5_found, p5_hierarchy, p5_descendants)}

_P1 = """
WITH r AS (SELECT gene_copy_id, contig, start AS s, "end" AS e FROM segment_occurrences WHERE gene_copy_id IS NOT NULL AND contig IS NOT NULL AND start <= "end"),
m AS (SELECT *, max(e) OVER (PARTITION BY gene_copy_id, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
l AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gene_copy_id, contig ORDER BY s, e, p NULLS FIRST ROWS UNBOUNDED PRECEDING) AS i FROM m),
a AS (SELECT gene_copy_id, contig, i, min(s) AS s, max(e) AS e FROM l GROUP BY ALL),
g AS (SELECT *, lag(e) OVER (PARTITION BY gene_copy_id, contig ORDER BY s) AS p FROM a),
found AS (SELECT gene_copy_id, contig, 'period' AS kind, s AS start_pos, e AS end_pos FROM a
UNION ALL SELECT gene_copy_id, contig, 'gap', p + 1, s - 1 FROM g WHERE p IS NOT NULL)
"""
_P3 = """
WITH p AS (SELECT occurrence_id, min(loaded_at) AS loaded, min(deleted_at) AS deleted FROM segment_occurrences WHERE occurrence_id IS NOT NULL GROUP BY 1),
r AS (SELECT 'segment_homology' AS table_name, homology_id AS record_key, 'occurrence_id' AS field_name, occurrence_id, loaded_at FROM segment_homology
UNION ALL SELECT 'physical_adjacencies', adjacency_id, 'left_occurrence_id', left_occurrence_id, loaded_at FROM physical_adjacencies
UNION ALL SELECT 'physical_adjacencies', adjacency_id, 'right_occurrence_id', right_occurrence_id, loaded_at FROM physical_adjacencies),
o AS (SELECT r.*, CASE WHEN p.occurrence_id IS NULL THEN 'missing' WHEN p.loaded > r.loaded_at THEN 'later' WHEN p.deleted <= r.loaded_at THEN 'withdrawn' END AS cause
FROM r LEFT JOIN p USING (occurrence_id) WHERE r.occurrence_id NOT IN ('', 'NA', '.', '?', 'unknown'))
"""
_FIELDS = [f.name for f in rejects.FEATURE_FIELDS]
_P4_READ = r"""
WITH lines AS (SELECT line_id, regexp_replace(raw_line, '\r$', '') AS l FROM raw_feature_lines),
rec AS (SELECT *, regexp_full_match(l, '(?s)(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)(?:\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|))*') AS ok FROM lines WHERE NOT starts_with(l, '#') AND regexp_matches(l, '[^\s\x0B]')),
split AS (SELECT line_id, ok, CASE WHEN ok THEN list_transform(regexp_extract_all(chr(9) || l, '(?s)\t("(?:[^"]|"")*"|[^"\t][^\t]*|)', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS f FROM rec),
v AS (SELECT 'raw_gene_features' AS source_table, row_id AS record_id, NULL AS shape, {cols} FROM raw_gene_features
UNION ALL SELECT 'raw_feature_lines', line_id, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> 17 THEN 'column_count' END, {parts} FROM split),
t AS (SELECT *, CASE WHEN regexp_full_match(trim(start, ' '), '[0-9]+') THEN try_cast(trim(start, ' ') AS BIGINT) END AS s, CASE WHEN regexp_full_match(trim("end", ' '), '[0-9]+') THEN try_cast(trim("end", ' ') AS BIGINT) END AS e, trim(strand, ' ') AS d FROM v)
""".format(cols=", ".join(f'"{n}"' for n in _FIELDS), parts=", ".join(f"f[{i + 1}]" for i in range(len(_FIELDS))))
_BAD_S, _BAD_E = "(s IS NULL OR s < 1)", "(e IS NULL OR e < 1)"
_BAD_D = "(d IS NULL OR d NOT IN ('+', '-', '.', '?', 'NA'))"

_P5 = """
WITH RECURSIVE raw AS (SELECT 'species_tree' AS source_table, '' AS scope_key, node_id AS n, parent_id AS p FROM species_tree WHERE node_id IS NOT NULL
UNION ALL SELECT 'raw_gene_features', coalesce(gene_copy_id, ''), id, parent FROM raw_gene_features WHERE id IS NOT NULL),
nodes AS (SELECT source_table, scope_key, n, min(CASE WHEN p NOT IN ('', 'NA', '.') THEN p END) AS p FROM raw GROUP BY 1, 2, 3),
link AS (SELECT c.source_table, c.scope_key, c.n, k.n AS p FROM nodes c LEFT JOIN nodes k ON k.source_table = c.source_table AND k.scope_key = c.scope_key AND k.n = c.p),
tree AS (SELECT source_table, scope_key, n, n AS root, 0 AS depth, n AS path FROM link WHERE p IS NULL
UNION ALL SELECT l.source_table, l.scope_key, l.n, t.root, t.depth + 1, t.path || '/' || l.n FROM link l JOIN tree t ON l.source_table = t.source_table AND l.scope_key = t.scope_key AND l.p = t.n)
"""
_P5_PAIRS = """, pairs AS (SELECT source_table, scope_key, p AS a, n, 1 AS dist FROM link WHERE p IS NOT NULL AND (source_table, scope_key, n) IN (SELECT (source_table, scope_key, n) FROM tree)
UNION ALL SELECT x.source_table, x.scope_key, l.p, x.n, x.dist + 1 FROM pairs x JOIN link l ON l.source_table = x.source_table AND l.scope_key = x.scope_key AND l.n = x.a WHERE l.p IS NOT NULL)
"""

SQL = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_copy_coverage": _P1
    + "SELECT gene_copy_id, contig, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps, sum(CASE WHEN kind = 'period' THEN end_pos - start_pos + 1 ELSE 0 END)::BIGINT AS covered_bases, sum(CASE WHEN kind = 'gap' THEN end_pos - start_pos + 1 ELSE 0 END)::BIGINT AS gap_bases FROM found GROUP BY ALL",
    "p3_found": _P3 + "SELECT DISTINCT table_name, record_key, field_name, occurrence_id FROM o WHERE cause IS NOT NULL",
    "p3_counts": _P3
    + "SELECT table_name, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_orphans, count(*) FILTER (cause = 'missing') AS n_missing, count(*) FILTER (cause = 'later') AS n_later, count(*) FILTER (cause = 'withdrawn') AS n_withdrawn FROM o WHERE cause IS NOT NULL GROUP BY 1, 2",
    "p4_found": _P4_READ
    + f"""SELECT source_table, record_id, unnest(list_filter(CASE WHEN shape IS NOT NULL THEN [shape] ELSE [CASE WHEN {_BAD_S} THEN 'start_value' END, CASE WHEN {_BAD_E} THEN 'end_value' END,
CASE WHEN NOT {_BAD_S} AND NOT {_BAD_E} AND e < s THEN 'end_before_start' END, CASE WHEN {_BAD_D} THEN 'strand_value' END] END, lambda x: x IS NOT NULL)) AS reason FROM t""",
    "p4_valid": _P4_READ
    + f"SELECT source_table, record_id, {', '.join({'start': 's AS start_pos', 'end': 'e AS end_pos', 'strand': 'd AS strand'}.get(n, f'"{n}"') for n in _FIELDS)} FROM t WHERE shape IS NULL AND NOT {_BAD_S} AND NOT {_BAD_E} AND NOT {_BAD_D} AND s <= e",
    "p5_found": _P5
    + """, endless AS (SELECT l.* FROM link l ANTI JOIN tree t ON l.source_table = t.source_table AND l.scope_key = t.scope_key AND l.n = t.n),
walk AS (SELECT source_table, scope_key, n, n AS x FROM endless UNION SELECT w.source_table, w.scope_key, w.n, l.p FROM walk w JOIN endless l ON l.source_table = w.source_table AND l.scope_key = w.scope_key AND l.n = w.x),
cyclic AS (SELECT DISTINCT w.source_table, w.scope_key, w.x AS n FROM walk w JOIN endless l ON l.source_table = w.source_table AND l.scope_key = w.scope_key AND l.n = w.x
WHERE EXISTS (SELECT 1 FROM walk b WHERE b.source_table = w.source_table AND b.scope_key = w.scope_key AND b.n = l.p AND b.x = w.x))
SELECT w.source_table, w.scope_key, w.n AS node_key, min(w.x) AS cycle_key FROM walk w JOIN cyclic c ON c.source_table = w.source_table AND c.scope_key = w.scope_key AND c.n = w.x GROUP BY 1, 2, 3""",
    "p5_hierarchy": _P5
    + _P5_PAIRS
    + "SELECT t.source_table, t.scope_key, t.n AS node_key, t.root AS root_key, t.depth, t.path, coalesce(d.k, 0) AS n_descendants FROM tree t LEFT JOIN (SELECT source_table, scope_key, a, count(*) AS k FROM pairs GROUP BY 1, 2, 3) d ON d.source_table = t.source_table AND d.scope_key = t.scope_key AND d.a = t.n",
    "p5_descendants": _P5 + _P5_PAIRS + "SELECT source_table, scope_key, a AS ancestor_key, n AS node_key, dist AS distance FROM pairs",
}
