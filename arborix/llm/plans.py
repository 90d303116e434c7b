"""Queries of the training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborix.llm import personal
from arborix.llm.groups import groups
from arborix.llm.leaks import leaks
from arborix.llm.tokens import encode
from arborix.llm.topn import top_n
from arborix.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    linked = table(spark, d, "segment_matches").where(F.col("match_status") == "mapped")
    return groups(linked, "query_occurrence_id", "subject_occurrence_id").withColumnRenamed("member", "occurrence_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "ancestral_state_probabilities"), "object_id", ["node_id", "state"], "probability").drop("probability")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim and paraphrased passages of evaluation items in documents."""
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text", reworded=False)
    return found.select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item that leaked: its set and the documents it stands in."""
    n = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    return p8_leaks(spark, d).groupBy("item_id").agg(n("verbatim"), n("paraphrase")).join(table(spark, d, "eval_items").select("item_id", "set_name"), "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(table(spark, d, "documents"), "doc_id", "text")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p6_found, p7_ids, p8_found, p8_leaks, p8_items, p9_found, p9_redacted)}

SQL = {
    "p2_found": """
WITH RECURSIVE e AS (SELECT DISTINCT query_occurrence_id AS a, subject_occurrence_id AS b FROM segment_matches WHERE match_status = 'mapped' AND query_occurrence_id <> subject_occurrence_id),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS v, a AS m FROM w UNION SELECT w.b, r.m FROM reach r JOIN w ON w.a = r.v WHERE r.m < w.b)
SELECT v AS occurrence_id, min(m) AS group_id FROM (SELECT v, m FROM reach UNION ALL SELECT a, a FROM w) GROUP BY v""",
    "p6_found": """
WITH i AS (SELECT object_id, node_id, state, max(probability) AS p FROM ancestral_state_probabilities
WHERE object_id IS NOT NULL AND node_id IS NOT NULL AND state IS NOT NULL AND probability IS NOT NULL AND NOT isnan(probability) GROUP BY ALL)
SELECT object_id, node_id, state FROM i QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY p DESC, node_id, state) <= 5""",
}
