"""Queries that need a kernel: alignment, chains, clusters, state spaces, chains of several states; with SQL where it can say it."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from arborix.functions import scores, status
from arborix.kernels import alignment, chains, configurations as X, markov
from arborix.operators import copies
from arborix.operators.asof import asof_join
from arborix.operators.clusters import greedy_cluster_sizes
from arborix.operators.grouped import LARGEST, by_group
from arborix.plans.matches import _M, _T, _matches
from arborix.plans.sequences import _seq, neighbours
from arborix.plans.structure import COPY, OCC, _exonic, _occ
from arborix.plans.trees import INNER, OUTER, _cells, _edges, _tips
from arborix.operators import sites
from arborix.session import Scratch, table

RATES = tuple(float(round(x, 6)) for x in np.geomspace(0.05, 5, 12))
#: Matches between two copies that one task chains (40 MB); the sweep takes n log n steps.
LARGEST_CHAIN = 1_000_000
COST = ((0, 1, 2), (1, 0, 1), (2, 1, 0))


def neighbour_alignments(spark, d):
    """Optimal global alignments of each sequence with the one before it in its source; long pairs are refused."""
    pairs = neighbours(_seq(spark, d)).select("doc_id", "seq", "before").repartition(4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, a, b in pdf.itertuples(index=False):
                got = alignment.align(a, b)
                one = alignment.statistics(a, b, got["alignments"][0]) if got["alignments"] else {}
                rows.append((k, got["status"], got["score"], len(got["alignments"]) or None, one.get("identity"), one.get("coverage")))
            yield pd.DataFrame(rows, columns=["doc_id", "status", "score", "n_optimal", "identity", "coverage"]).astype({"score": "Int64", "n_optimal": "Int64"})

    return pairs.mapInPandas(run, "doc_id long, status string, score long, n_optimal long, identity double, coverage double")


def colinear_chains(spark, d):
    """Best chain of the accepted matches between two copies, and what stays near it."""
    o = _occ(spark, d).select("occurrence_id", "gene_copy_id", "start", "end")
    side = lambda p: o.select(*[F.col(c).alias(p + c) for c in o.columns])
    m = _matches(spark, d).where("match_status = 'mapped' and alignment_strand = '+' and total_score is not null")
    rows = m.join(side("q_"), F.col("query_occurrence_id") == F.col("q_occurrence_id")).join(side("t_"), F.col("subject_occurrence_id") == F.col("t_occurrence_id")).where("q_gene_copy_id <> t_gene_copy_id")
    rows = rows.select(F.col("q_gene_copy_id").alias("left_copy"), F.col("t_gene_copy_id").alias("right_copy"), "q_start", "q_end", "t_start", "t_end", (F.col("total_score") * F.col("aligned_pairs")).alias("score")).where("score is not null")

    def kernel(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values(["q_start", "q_end", "t_start", "t_end", "score"])
        got = chains.chain(*(pdf[c].to_numpy() for c in ("q_start", "q_end", "t_start", "t_end", "score")))
        return {"n_candidates": len(pdf), "best_score": round(got["best"], 6), "n_in_chain": len(got["path"]), "n_retained": int(got["retained"].sum()), "n_obligatory": int(got["obligatory"].sum())}

    return by_group(rows, ["left_copy", "right_copy"], kernel, "n_candidates long, best_score double, n_in_chain long, n_retained long, n_obligatory long", largest=LARGEST_CHAIN)


def greedy_clusters(spark, d, largest: int = LARGEST):
    """Clusters of each family's segments in which all members are of different copies and directly linked.

    Families of more than ``largest`` rows go through rounds over the cluster, with the same result.
    """
    o = copies.latest(table(spark, d, "segment_occurrences"), "occurrence_id").select("occurrence_id", "family_id", "gene_copy_id")
    side = lambda p: o.select(*[F.col(c).alias(p + c) for c in o.columns])
    m = _matches(spark, d).where("match_status = 'mapped' and total_score is not null")
    rows = m.join(side("q_"), F.col("query_occurrence_id") == F.col("q_occurrence_id")).join(side("t_"), F.col("subject_occurrence_id") == F.col("t_occurrence_id"))
    far = F.when(F.col("distance_class") == "short", 0).when(F.col("distance_class") == "medium", 1).otherwise(2)
    rows = rows.select(F.col("q_family_id").alias("family_id"), far.alias("far"), "total_score", "query_occurrence_id", "subject_occurrence_id", "q_gene_copy_id", "t_gene_copy_id")
    rows = Scratch(spark, "linked").write(rows, "rows")  # read for the sizes and again for the groups

    def kernel(pdf: pd.DataFrame) -> dict:
        owner = dict(zip(pdf["query_occurrence_id"], pdf["q_gene_copy_id"])) | dict(zip(pdf["subject_occurrence_id"], pdf["t_gene_copy_id"]))
        got = chains.greedy_clusters(list(zip(pdf["far"], pdf["total_score"], pdf["query_occurrence_id"], pdf["subject_occurrence_id"])), owner)
        sizes = pd.Series(list(got.values())).value_counts()
        return {"n_segments": len(got), "n_clusters": len(sizes), "largest": int(sizes.iloc[0])}

    large = rows.dropna(subset=["family_id"]).groupBy("family_id").agg(F.count("*").alias("_size")).where(F.col("_size") > largest).select("family_id")
    if not large.take(1):
        return by_group(rows, ["family_id"], kernel, "n_segments long, n_clusters long, largest long", largest)
    done = by_group(rows.join(large, "family_id", "left_anti"), ["family_id"], kernel, "n_segments long, n_clusters long, largest long", largest)
    names = {"query_occurrence_id": "left", "subject_occurrence_id": "right", "q_gene_copy_id": "left_owner", "t_gene_copy_id": "right_owner"}
    sizes = greedy_cluster_sizes(rows.join(large, "family_id", "left_semi").withColumnsRenamed(names), "family_id")
    return done.unionByName(sizes.withColumn("status", F.lit("complete")))


@functools.lru_cache(maxsize=4096)
def _space(order: tuple[int, ...]) -> tuple[str, int | None, int | None, int | None]:
    """The space of exons whose borders have the given ranks (start, end, start, end...)."""
    exons = tuple(zip(order[::2], order[1::2]))
    whole = (exons[0][0], exons[-1][1])
    spans = (whole, *exons) if len(exons) > 1 else exons
    space = X.enumerate_space(X.Catalogue(whole[1], spans, tuple((a[1], b[0]) for a, b in zip(exons, exons[1:])), (), spans))
    return (space.status, space.geometries, len(space.states), len(space.edits)) if space.status == "complete" else (space.status, None, None, None)


def state_spaces(spark, d):
    """Size of the configuration space of each copy's merged exons; one that exceeds a declared limit is refused, with nulls.

    The space depends on the order of the borders alone, so they are ranked and copies of one order share a computation.
    A copy of more exons than any space within the limit of spans can have (every exon start with every later end) is
    refused before its exons are gathered.
    """
    keys = [*COPY, "contig"]
    merged = copies.merged(_exonic(spark, d), keys)
    n = merged.groupBy(*keys).agg(F.count("*").alias("n_exons"))
    feasible = F.col("n_exons") * (F.col("n_exons") + 1) / 2 <= X.SPANS
    exons = n.where(feasible).join(merged, keys).groupBy(*keys, "n_exons").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))
    borders = F.flatten(F.transform("exons", lambda x: F.array(x["start"], x["end"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_space(tuple(np.unique(b, return_inverse=True)[1].tolist())) for b in pdf["borders"]]
            out = pdf.drop(columns="borders").assign(status=[g[0] for g in got])
            for i, c in enumerate(("n_geometries", "n_states", "n_edits"), 1):
                out[c] = pd.array([g[i] for g in got], "Int64")
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in n.schema)
    done = exons.select(*keys, "n_exons", borders.alias("borders")).mapInPandas(run, kinds + ", status string, n_geometries long, n_states long, n_edits long")
    none = [F.lit(None).cast("long").alias(c) for c in ("n_geometries", "n_states", "n_edits")]
    return done.unionByName(n.where(~feasible).select(*keys, "n_exons", F.lit("state_space_incomplete: spans").alias("status"), *none))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """part, nation, state: the most frequent return flag (A 0, N 1, R 2), ties by the smaller."""
    sup = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("tip"))
    code = F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1
    n = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", code.alias("code")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey", "tip", "code").agg(F.count("*").alias("n"))
    seen = n.groupBy(F.col("l_partkey").alias("p_partkey"), "tip").agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("state"))
    return sites.complete(seen, table(spark, d, "part"), _tips(spark, d), "p_partkey")


def _tree(spark: SparkSession, d: str) -> list[tuple[str, str, float]]:
    """The 30 edges of root, regions and nations, children first."""
    return [(r.child, r.parent, r.length) for r in _edges(spark, d).orderBy("level", "child").collect()]


def _compatibilities(patterns: pd.Series, tips: list[str], size: int) -> dict[str, np.ndarray]:
    letters = np.array([list(p) for p in patterns])
    return {t: np.stack([(letters[:, i] == str(s)) | (letters[:, i] == "?") for s in range(size)]).astype(float) for i, t in enumerate(tips)}


def _per_pattern(found: DataFrame, fields: str, compute) -> DataFrame:
    """A kernel over batches of distinct patterns, joined back to the characters."""
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"pattern": pdf["pattern"]} | dict(zip(names, compute(pdf["pattern"]))))

    return found.join(found.select("pattern").distinct().mapInPandas(run, f"pattern string, {fields}"), "pattern").drop("pattern")


def nstate_parsimony(spark, d):
    """Least cost of three ordered states and the number of states that the root can have."""
    tips, edges, cost = _tips(spark, d), _tree(spark, d), np.array(COST, float)

    def compute(patterns):
        best, states = markov.sankoff(edges, _compatibilities(patterns, tips, 3), cost)
        return best.astype(int), states[edges[-1][1]].sum(0)

    return _per_pattern(sites.patterns(_flags(spark, d), "p_partkey"), "min_cost long, n_root_states long", compute)


def mk_rate_grid(spark, d):
    """Log-likelihood of all characters at each of twelve rates of an equal-rates model of three states."""
    tips, edges = _tips(spark, d), _tree(spark, d)
    found = sites.patterns(_flags(spark, d), "p_partkey").groupBy("pattern").agg(F.count("*").alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                t = _compatibilities(pdf["pattern"], tips, 3)
                ll = [float((markov.log_likelihood(edges, t, lambda x, r=r: markov.expm(markov.equal_rates(3, r) * x), np.full(3, 1 / 3)) * pdf["w"]).sum()) for r in RATES]
                yield pd.DataFrame({"rate": RATES, "ll": ll})

    return found.mapInPandas(run, "rate double, ll double").groupBy("rate").agg(scores.exact_sum(F.col("ll")).alias("log_likelihood"))


def _rate_fit():
    """The fit of one brand, as a generator that asks for log-likelihoods at rates."""
    best = yield from markov.maximise_asking(0.01, 20, brackets=10, steps=25)
    low, high = yield from markov.profile_interval_asking(best["x"], best["value"], 0.01, 20)
    (one,) = yield [1.0]
    return {"fit": best["status"], "rate": round(best["x"], 4), "low": low and round(low, 4), "high": high and round(high, 4), "log_likelihood": round(best["value"], 3), "p_value": round(markov.chi2_tail(2 * (best["value"] - one)), 6)}


def _large_rate_fits(rows: DataFrame, tips: list[str], edges: list[tuple[str, str, float]]) -> list[tuple]:
    """The fits of all brands of the rows; a step of all of them is one sum over the patterns in the cluster."""
    kind = rows.schema["p_brand"].dataType.simpleString()

    def sums(asked: dict[str, list[float]]) -> dict[str, list[float]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for brand, own in pdf.groupby("p_brand"):
                    t = _compatibilities(own["pattern"], tips, 3)
                    ll = [_weighted(edges, t, own["w"].to_numpy(), r) for r in asked[brand]]
                    yield pd.DataFrame({"p_brand": brand, "nth": range(len(ll)), "ll": ll})

        out = {b: [0.0] * len(rates) for b, rates in asked.items()}
        for r in rows.where(F.col("p_brand").isin(list(asked))).mapInPandas(run, f"p_brand {kind}, nth int, ll double").groupBy("p_brand", "nth").agg(F.sum("ll").alias("ll")).collect():
            out[r.p_brand][r.nth] = r.ll
        return out

    going = {r.p_brand: _rate_fit() for r in rows.select("p_brand").distinct().collect()}
    asked, done = {b: [float(x) for x in next(g)] for b, g in going.items()}, []
    while asked:
        values, asked = sums(asked), {}
        for brand, v in values.items():
            try:
                asked[brand] = [float(x) for x in going[brand].send(v)]
            except StopIteration as end:
                done.append((brand, "complete", *end.value.values()))
    return done


def _weighted(edges, tips: dict[str, np.ndarray], w: np.ndarray, rate: float) -> float:
    return float((markov.log_likelihood(edges, tips, lambda x: markov.expm(markov.equal_rates(3, rate) * x), np.full(3, 1 / 3)) * w).sum())


def mk_rate_fit(spark, d, largest: int = LARGEST):
    """Rate of each brand by maximum likelihood, with a 95 % profile interval and a test against rate 1.

    A brand of more than ``largest`` patterns is fitted by sums over the cluster.
    """
    tips, edges = _tips(spark, d), _tree(spark, d)
    rows = sites.patterns(_flags(spark, d), "p_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    rows = Scratch(spark, "rates").write(rows.groupBy("p_brand", "pattern").agg(F.count("*").alias("w")), "rows")

    def kernel(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("pattern")
        t, w = _compatibilities(pdf["pattern"], tips, 3), pdf["w"].to_numpy()
        return markov.answered_by(lambda r: _weighted(edges, t, w, r), _rate_fit())

    fields = "fit string, rate double, low double, high double, log_likelihood double, p_value double"
    large = rows.dropna(subset=["p_brand"]).groupBy("p_brand").agg(F.count("*").alias("_size")).where(F.col("_size") > largest).select("p_brand")
    if not large.take(1):
        return by_group(rows, ["p_brand"], kernel, fields, largest)
    done = by_group(rows.join(large, "p_brand", "left_anti"), ["p_brand"], kernel, fields, largest)
    fits = _large_rate_fits(rows.join(large, "p_brand", "left_semi"), tips, edges)
    return done.unionByName(spark.createDataFrame(fits, f"p_brand {rows.schema['p_brand'].dataType.simpleString()}, status string, {fields}"))


def tract_likelihood(spark, d):
    """Log-likelihood of each part's pattern as one DNA tract that arrives once and can be lost, over all its origins."""
    space = X.enumerate_space(X.Catalogue(10, ((0, 10),), (), (("m", 0, 10),), ((0, 10),)))
    there, gone = X.compatible(space, ((0, 10),), (1,)), X.compatible(space, (), (0,))
    table_of = np.stack([gone, there, np.ones_like(there)])
    tips, edges, rates = _tips(spark, d), _tree(spark, d), {"dna_insertion": 0.3, "dna_deletion": 0.2}

    def compute(patterns):
        letters = np.array([[{"0": 0, "1": 1}.get(c, 2) for c in p] for p in patterns])
        return (np.round(X.log_likelihoods(space, edges, {t: table_of[letters[:, i]].T for i, t in enumerate(tips)}, rates), 6),)

    return _per_pattern(sites.patterns(_cells(spark, d), "p_partkey"), "log_likelihood double", compute)


def bootstrap_changes(spark, d, draws: int = 200, seed: int = 11):
    """Interval of the mean cost of a brand's characters, by resampling characters with Poisson(1) multiplicities.

    Characters of one brand and cost are alike, and the sum of n such multiplicities is Poisson(n), so a draw needs the
    counts of each cost alone: the characters are counted once, and a brand is as many rows as it has costs.
    """
    rows = nstate_parsimony(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand", "min_cost").agg(F.count("*").alias("n"))

    def kernel(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("min_cost")
        rng = np.random.default_rng([seed, zlib.crc32(str(pdf["p_brand"].iloc[0]).encode())])
        k = rng.poisson(pdf["n"].to_numpy(), (draws, len(pdf)))
        means = (k @ pdf["min_cost"].to_numpy())[k.sum(1) > 0] / k.sum(1)[k.sum(1) > 0]
        low, median, high = np.quantile(means, (0.025, 0.5, 0.975)) if len(means) else (None,) * 3
        return {"low": round(float(low), 6), "median": round(float(median), 6), "high": round(float(high), 6)} if len(means) else {"low": None, "median": None, "high": None}

    return by_group(rows, ["p_brand"], kernel, "low double, median double, high double").drop("status")


def precision_recall(spark, d):
    """Acceptance rule against the delivered status: hits, false and missed ones by distance class."""
    t = scores.pair_threshold(F.col("threshold"), F.col("distance_class"))
    said = F.coalesce(scores.accepted(F.col("alignment_score"), F.col("coverage_score"), t), F.lit(False))
    true = F.coalesce(F.col("match_status") == "mapped", F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    rows = _matches(spark, d).groupBy(status.state(F.col("distance_class")).alias("distance_class")).agg(n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & true).alias("fn"))
    c = F.col
    return rows.select("distance_class", "tp", "fp", "fn", F.round(F.try_divide(c("tp"), c("tp") + c("fp")), 6).alias("precision"), F.round(F.try_divide(c("tp"), c("tp") + c("fn")), 6).alias("recall"), F.round(F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), 6).alias("f1"))


def intron_flanks(spark, d):
    """Nearest exonic segments strictly before and after each intron's start on its copy and contig."""
    occ = _occ(spark, d)
    keys = ["gene_copy_id", "contig"]
    exons = occ.where(status.exon_like(F.col("role"))).select(*keys, F.col("start").alias("s"), "occurrence_id")
    i = occ.where("role = 'intron'").select(*keys, F.col("occurrence_id").alias("intron_id"), F.col("start").alias("at"))
    left = asof_join(i, exons, keys, "at", "s", "occurrence_id", strict=True, name="left_id")
    return asof_join(left, exons, keys, "at", "s", "occurrence_id", after=True, strict=True, name="right_id").select("intron_id", "left_id", "right_id")


QUERIES = {
    f.__name__: f
    for f in (neighbour_alignments, colinear_chains, greedy_clusters, state_spaces, nstate_parsimony, mk_rate_grid, mk_rate_fit, tract_likelihood, bootstrap_changes, precision_recall, intron_flanks)
}

_FLAGS = """
WITH sup AS (SELECT s_suppkey, n_name AS tip FROM supplier JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT l_partkey, tip, instr('ANR', l_returnflag) - 1 AS code, count(*) AS n FROM lineitem JOIN sup ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
seen AS (SELECT l_partkey, tip, code AS state FROM k QUALIFY row_number() OVER (PARTITION BY l_partkey, tip ORDER BY n DESC, code) = 1),
cells AS (SELECT p_partkey, n_name AS tip, r_name AS region, state FROM part CROSS JOIN nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN seen ON l_partkey = p_partkey AND seen.tip = n_name)
"""
_V = "CASE WHEN state IS NULL THEN 0 ELSE abs(state - {}) END"
_G = "CASE WHEN state IS NULL THEN 0 WHEN state = {} THEN ln(so) ELSE ln(co) END"
SQL = {
    "nstate_parsimony": _FLAGS
    + f""", a AS (SELECT p_partkey, region, sum({_V.format(0)}) AS v0, sum({_V.format(1)}) AS v1, sum({_V.format(2)}) AS v2 FROM cells GROUP BY 1, 2),
b AS (SELECT p_partkey, sum(least(v0, v1 + 1, v2 + 2)) AS r0, sum(least(v0 + 1, v1, v2 + 1)) AS r1, sum(least(v0 + 2, v1 + 1, v2)) AS r2 FROM a GROUP BY 1)
SELECT p_partkey, least(r0, r1, r2)::BIGINT AS min_cost, ((r0 = least(r0, r1, r2))::BIGINT + (r1 = least(r0, r1, r2))::BIGINT + (r2 = least(r0, r1, r2))::BIGINT) AS n_root_states FROM b""",
    "mk_rate_grid": _FLAGS
    + f""", g AS (SELECT r AS rate, 1.0::DOUBLE / 3 + 2.0::DOUBLE / 3 * exp(-1.5::DOUBLE * r * {OUTER}) AS so, 1.0::DOUBLE / 3 - 1.0::DOUBLE / 3 * exp(-1.5::DOUBLE * r * {OUTER}) AS co, 1.0::DOUBLE / 3 + 2.0::DOUBLE / 3 * exp(-1.5::DOUBLE * r * {INNER}) AS si, 1.0::DOUBLE / 3 - 1.0::DOUBLE / 3 * exp(-1.5::DOUBLE * r * {INNER}) AS ci FROM (SELECT unnest({list(RATES)}::DOUBLE[]) AS r)),
a AS (SELECT rate, p_partkey, region, any_value(si) AS si, any_value(ci) AS ci, exp(sum({_G.format(0)})) AS v0, exp(sum({_G.format(1)})) AS v1, exp(sum({_G.format(2)})) AS v2 FROM cells, g GROUP BY 1, 2, 3),
b AS (SELECT rate, p_partkey, sum(ln(si * v0 + ci * (v1 + v2))) AS r0, sum(ln(si * v1 + ci * (v0 + v2))) AS r1, sum(ln(si * v2 + ci * (v0 + v1))) AS r2 FROM a GROUP BY 1, 2)
SELECT rate, round(sum(ln((exp(r0) + exp(r1) + exp(r2)) / 3)), 3) AS log_likelihood FROM b GROUP BY 1""",
    "precision_recall": _M
    + f""", t AS (SELECT *, {_T} AS t FROM m), s AS (SELECT CASE WHEN distance_class IS NULL OR trim(distance_class) IN ('', 'NA', '.', '?', 'unknown') THEN 'unknown' ELSE trim(distance_class) END AS distance_class,
coalesce((alignment_score >= t AND coverage_score >= 0.45::DOUBLE) OR (alignment_score >= t + 0.15::DOUBLE AND coverage_score >= 0.30::DOUBLE), false) AS said, coalesce(match_status = 'mapped', false) AS yes FROM t),
c AS (SELECT distance_class, count(*) FILTER (said AND yes) AS tp, count(*) FILTER (said AND NOT yes) AS fp, count(*) FILTER (NOT said AND yes) AS fn FROM s GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
    "intron_flanks": OCC
    + """, i AS (SELECT gene_copy_id, contig, occurrence_id AS intron_id, start AS at_ FROM occ WHERE role = 'intron')
SELECT intron_id, (SELECT max({'s': e.start, 'o': e.occurrence_id}).o FROM ex e WHERE e.gene_copy_id = i.gene_copy_id AND e.contig = i.contig AND e.start < at_) AS left_id,
(SELECT arg_max(e.occurrence_id, {'s': -e.start, 'o': e.occurrence_id}) FROM ex e WHERE e.gene_copy_id = i.gene_copy_id AND e.contig = i.contig AND e.start > at_) AS right_id FROM i""",
}
