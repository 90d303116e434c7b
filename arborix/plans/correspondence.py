"""Queries of correspondence and observation: scored pairs, eligible edges, what is missing, site cells, native paths; with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from arborix.functions import evidence as E, scores, status
from arborix.kernels import rates
from arborix.operators import copies as O, matching as M, sites as S
from arborix.operators.grouped import by_group
from arborix.operators.scenarios import robust as O_robust
from arborix.plans.matches import _M, _O, _T, _homology, _matches
from arborix.plans.structure import COPY, OCC, _exonic, _occ
from arborix.plans.trees import _CELLS, INNER, OUTER, _cells, _costs, _edges, _tips
from arborix.session import table

c = F.col


def _latest(spark, d) -> DataFrame:
    return O.latest(table(spark, d, "segment_occurrences"), "occurrence_id")


def _sides(m: DataFrame, o: DataFrame) -> DataFrame:
    """Matches with the columns of both ends, q_ and t_; ends that are no known occurrence are left out."""
    side = lambda p: o.select(*[c(x).alias(p + x) for x in o.columns])
    return m.join(side("q_"), c("query_occurrence_id") == c("q_occurrence_id")).join(side("t_"), c("subject_occurrence_id") == c("t_occurrence_id"))


def pair_evidence(spark, d):
    """The terms of each match's score and their weighted sum, from the alignment and from both ends' place in their paths."""
    ctx = O.order_context(_occ(spark, d), [*COPY, "transcript_id"])
    o = _latest(spark, d).select("occurrence_id", "role", "phase", "splice_motif_score", F.greatest(F.lit(1), c("end") - c("start") + 1).alias("n")).join(ctx, "occurrence_id", "left")
    rows = _sides(_matches(spark, d).select("match_id", "query_occurrence_id", "subject_occurrence_id", "alignment_score", "coverage_score", "alignment_strand"), o)
    left, right = E.context(c("q_left_role"), c("t_left_role")), E.context(c("q_right_role"), c("t_right_role"))
    identity, coverage = F.coalesce("alignment_score", F.lit(0.0)), F.coalesce("coverage_score", F.lit(0.0))
    terms = {
        "left_context": left, "right_context": right, "boundary_score": E.boundary(c("q_role"), c("t_role")), "phase_score": E.phase(c("q_phase"), c("t_phase")), "order_score": E.nearness(c("q_order_index"), c("t_order_index")),
        "strand_score": F.when(c("alignment_strand") == "-", 0.0).otherwise(1.0), "splice_score": E.nearness(c("q_splice_motif_score"), c("t_splice_motif_score")),
    }
    rows = rows.select("match_id", identity.alias("i"), coverage.alias("v"), (F.least("q_n", "t_n") / F.greatest("q_n", "t_n")).alias("r"), *[t.alias(n) for n, t in terms.items()])
    return rows.select(
        "match_id", "left_context", "right_context", "boundary_score", "phase_score", "strand_score", E.micro(c("order_score")).alias("order_score"), E.micro(c("splice_score")).alias("splice_score"), E.micro(c("r")).alias("size_ratio"),
        E.micro(scores.sequence_score(c("i"), c("v"))).alias("sequence_score"), E.micro(0.5 * c("left_context") + 0.5 * c("right_context")).alias("structural_context_score"), E.micro(E.total(c("i"), c("v"), *[c(n) for n in terms])).alias("total_score"),
    )


def edge_eligibility(spark, d):
    """Which matches may join records (membership) and fix a place (position), and why the others don't.

    Membership: mapped, accepted, compatible roles, other copies. Position: the only best match of its query in that copy.
    """
    o = _latest(spark, d).select("occurrence_id", "role", "gene_copy_id")
    rows = _sides(_matches(spark, d), o)
    best = rows.groupBy("query_occurrence_id", "t_gene_copy_id").agg(F.max("total_score").alias("best"))
    rows = rows.join(best, ["query_occurrence_id", "t_gene_copy_id"], "left")
    n = rows.where(c("total_score") == c("best")).groupBy("query_occurrence_id", "t_gene_copy_id").agg(F.count("*").alias("n_best"))
    rows = rows.join(n, ["query_occurrence_id", "t_gene_copy_id"], "left")
    t = scores.pair_threshold(c("threshold"), c("distance_class"))
    ok = F.coalesce(scores.accepted(c("alignment_score"), c("coverage_score"), t), F.lit(False))
    reason = (
        F.when(~F.coalesce(c("match_status") == "mapped", F.lit(False)), "not_mapped").when(~F.coalesce(c("q_gene_copy_id") != c("t_gene_copy_id"), F.lit(False)), "not_two_copies").when(~E.roles_compatible(c("q_role"), c("t_role")), "incompatible_roles")
        .when(~ok, "sequence_not_accepted").when(~F.coalesce(c("total_score") == c("best"), F.lit(False)), "not_best_in_copy").when(c("n_best") > 1, "several_placements").otherwise("position")
    )
    member = reason.isin("not_best_in_copy", "several_placements", "position")
    return rows.select("match_id", reason.alias("reason"), member.alias("membership_eligible"), (reason == "position").alias("position_eligible"))


def missing_elements(spark, d):
    """Elements of a family that a species with one copy lacks: where a search for them would begin."""
    o = _occ(spark, d).select("occurrence_id", "family_id", "species", "gene_copy_id")
    single = o.groupBy("family_id", "species").agg(F.count_distinct("gene_copy_id").alias("n"), F.min("gene_copy_id").alias("gene_copy_id")).where("n = 1")
    seen = _homology(spark, d).select("homology_id", "occurrence_id").distinct().join(o, "occurrence_id").select("homology_id", "family_id", "species").distinct()
    wanted = seen.select("homology_id", "family_id").distinct().join(single, "family_id")
    return wanted.join(seen, ["homology_id", "family_id", "species"], "left_anti").select("family_id", "homology_id", "species", "gene_copy_id")


def site_matrix(spark, d):
    """A presence and a role cell for each element and each species of its family, with applicability and reason.

    Present if a member is, absent if all known members are, otherwise unknown; species without a member are completed.
    The role of an absent element is inapplicable; exonic and other roles together conflict.
    """
    o = _latest(spark, d).where("family_id is not null and species is not null").select("occurrence_id", "family_id", "species", "role", status.state(c("presence_status")).alias("presence"))
    h = _homology(spark, d).select("homology_id", "occurrence_id").distinct().join(o, "occurrence_id")
    panel = o.select("family_id", "species").distinct()
    some = lambda x: F.max(F.coalesce(x, F.lit(False)).cast("int"))
    here = c("presence") == "present"
    cells = h.groupBy("homology_id", "family_id", "species").agg(
        some(here).alias("p"), some(c("presence") == "absent").alias("a"), some(c("presence") == "unknown").alias("u"), some(here & status.exon_like(c("role"))).alias("x"), some(here & ~status.exon_like(c("role"))).alias("z"), some(here & c("role").isNull()).alias("w")
    )
    rows = cells.select("homology_id", "family_id").distinct().join(panel, "family_id").join(cells, ["homology_id", "family_id", "species"], "left")
    presence = F.when(c("p") == 1, "present").when((c("a") == 1) & (c("u") == 0), "absent").otherwise("unknown")
    role = F.when(c("presence") == "absent", "inapplicable").when(c("presence") == "unknown", "undetermined").when((c("x") == 1) & (c("z") == 1), "conflict").when(c("x") == 1, "exonic").when(c("w") == 1, "undetermined").otherwise("not_exonic")
    why = F.when(c("p").isNull(), "no_member_in_species").when(c("presence") == "unknown", "presence_not_established").when((c("x") == 1) & (c("z") == 1), "roles_disagree").otherwise("observed")
    rows = rows.withColumn("presence", presence).select("family_id", "homology_id", "species", "presence", role.alias("role"), why.alias("reason"))
    layer = lambda name, state, usable: F.struct(F.lit(name).alias("layer"), state.alias("state"), usable.alias("applicable"))
    both = F.array(layer("exon_presence", c("presence"), F.lit(True)), layer("exon_role", c("role"), c("presence") != "absent"))
    return rows.select("family_id", "homology_id", "species", "reason", F.explode(both).alias("r")).select("family_id", "homology_id", "species", "r.layer", "r.state", "r.applicable", "reason")


def universe_validation(spark, d):
    """Whether every element has a cell for every species of its family, in each layer, and which states are masked."""
    m = site_matrix(spark, d)
    panel = _latest(spark, d).where("family_id is not null and species is not null").groupBy("family_id").agg(F.count_distinct("species").alias("n_species"))
    known = c("state").isin("present", "absent", "exonic", "not_exonic")
    rows = m.groupBy("family_id", "homology_id", "layer").agg(F.count_distinct("species").alias("n_cells"), F.sum(known.cast("long")).alias("n_known"))
    rows = rows.join(panel, "family_id")
    verdict = F.when(c("n_cells") != c("n_species"), "incomplete").when(c("n_known") == 0, "all_masked").when(c("n_known") < c("n_species"), "complete_with_masks").otherwise("complete")
    return rows.groupBy("layer", verdict.alias("verdict")).agg(F.count("*").alias("n_elements"))


def ancestral_consistency(spark, d):
    """Presence against role in a family at a node: an exonic or other role of absent DNA is a conflict."""
    rows = table(spark, d, "ancestral_state_probabilities").where("object_id is not null and node_id is not null and state in ('0', '1') and probability >= 0.5 and not isnan(probability)")
    rows = rows.withColumn("family_id", F.regexp_extract("object_id", "(FAM[0-9]+)", 1))
    sets = rows.groupBy("family_id", "node_id", "layer").agg(F.array_join(F.sort_array(F.collect_set("state")), ";").alias("states"))
    dna = sets.where("layer = 'exon_presence'").select("family_id", "node_id", c("states").alias("dna"))
    role = sets.where("layer = 'exon_role'").select("family_id", "node_id", c("states").alias("role"))
    call = F.when((c("dna") == "0") & c("role").isin("0", "1"), "incompatible_singleton_states").when(c("dna") != "1", "dna_presence_unresolved").otherwise("no_applicability_conflict")
    return role.join(dna, ["family_id", "node_id"]).select("family_id", "node_id", c("dna").alias("sequence_states"), c("role").alias("role_states"), call.alias("status"))


def event_tiers(spark, d):
    """Support of each change along a branch of the species trees: of the changed state's probabilities and of tests within a layer."""
    from arborix.plans.evidence import _states

    s = _states(spark, d)
    up = table(spark, d, "species_tree").where("node_id is not null and parent_id not in ('', 'NA', '.')").groupBy("node_id").agg(F.min("parent_id").alias("parent_id"))
    parent = s.select("layer", "object_id", c("node_id").alias("parent_id"), c("state").alias("was"), c("p").alias("up"))
    rows = s.join(up, "node_id").join(parent, ["layer", "object_id", "parent_id"]).where("was <> state")
    rows = rows.select("layer", "object_id", "node_id", (c("p") * c("up")).alias("both"), F.least("p", "up").alias("least"), F.round(1 - F.least("p", "up"), 9).alias("p_value"))
    rows = M.bh_adjust(rows, ["layer"], "p_value")
    none = F.lit(None).cast("double")
    tier = E.support_tier(c("both"), none, c("least"), c("p_value"), c("q_value"), none)
    return rows.groupBy("layer", tier.alias("tier")).agg(F.count("*").alias("n_changes"), F.count_distinct("object_id").alias("n_objects"))


def history_witness(spark, d):
    """One history of least changes of each character: the smaller state of the root, and a parent's state wherever it can stay."""
    found, costs = _costs(spark, d)
    root = costs.where("node = 'root'").select("pattern", F.when(c("v0") <= c("v1"), 0).otherwise(1).alias("root_state"), F.least("v0", "v1").cast("long").alias("min_changes"))
    inner = costs.join(F.broadcast(_edges(spark, d).where("level = 2").select(c("child").alias("node"))), "node").join(root, "pattern")
    own = F.when(c("root_state") == 0, F.when(c("v0") <= c("v1") + 1, 0).otherwise(1)).otherwise(F.when(c("v1") <= c("v0") + 1, 1).otherwise(0))
    inner = inner.withColumn("state", own).withColumn("below", F.when(c("state") == 0, c("v0")).otherwise(c("v1")))
    got = inner.groupBy("pattern", "root_state", "min_changes").agg(F.sum((c("state") != c("root_state")).cast("long")).alias("n_inner_changes"), F.sum("below").cast("long").alias("n_tip_changes"))
    rows = found.join(got, "pattern")
    return rows.select("p_partkey", "root_state", "n_inner_changes", "n_tip_changes", (c("n_inner_changes") + c("n_tip_changes") == c("min_changes")).alias("attains_minimum"))


def path_completeness(spark, d):
    """Transcripts all of whose segments are whole, internal ones between two terminal borders."""
    rows = _exonic(spark, d).where("transcript_id is not null")
    ends = F.sum((c("boundary_class") == "terminal").cast("long"))
    per = rows.groupBy(*COPY, "transcript_id").agg(F.count("*").alias("n"), F.max(E.partial(c("boundary_class"), c("source_feature_id")).cast("int")).alias("cut"), F.sum((status.state(c("boundary_class")) == "unknown").cast("long")).alias("open"), ends.alias("ends"))
    call = F.when(c("cut") == 1, "partial").when(c("open") > 0, "unassessed").when(c("ends") == 0, "no_terminal_border").otherwise("complete")
    return per.groupBy(call.alias("call")).agg(F.count("*").alias("n_transcripts"), F.sum("n").alias("n_segments"))


def input_validation(spark, d):
    """Rows that break a rule of the input, by rule."""
    o = table(spark, d, "segment_occurrences")
    one = o.where("family_id is not null and species is not null and gene_copy_id is not null").groupBy("family_id", "species").agg(F.count_distinct("gene_copy_id").alias("n"))
    tests = {
        "no_family": c("family_id").isNull(), "no_species": c("species").isNull(), "no_copy": c("gene_copy_id").isNull(), "no_contig": c("contig").isNull(), "bad_strand": ~F.coalesce(c("strand").isin("+", "-"), F.lit(False)),
        "no_coordinates": c("start").isNull() | c("end").isNull(), "below_one": F.coalesce(c("start") < 1, F.lit(False)), "inverted": F.coalesce(c("start") > c("end"), F.lit(False)), "bad_phase": ~F.coalesce(c("phase").isin("0", "1", "2", "."), F.lit(False)),
    }
    got = o.agg(*[F.coalesce(F.sum(t.cast("long")), F.lit(0)).alias(n) for n, t in tests.items()]).unpivot([], list(tests), "rule", "n_rows")
    return got.unionByName(one.agg(F.lit("several_copies_of_a_species").alias("rule"), F.coalesce(F.sum((c("n") > 1).cast("long")), F.lit(0)).alias("n_rows")))


def backend_baselines(spark, d):
    """Accepted matches and mean score of each backend, and how far it is below the best one."""
    t = scores.pair_threshold(c("threshold"), c("distance_class"))
    ok = F.coalesce(scores.accepted(c("alignment_score"), c("coverage_score"), t), F.lit(False))
    rows = _matches(spark, d).where("total_score is not null and not isnan(total_score)").groupBy("backend").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_accepted"), scores.exact_mean(c("total_score")).alias("mean_score"))
    best = rows.agg(F.max("mean_score").alias("best"))  # one row
    return rows.crossJoin(F.broadcast(best)).select("backend", "n", "n_accepted", "mean_score", E.micro(c("best") - c("mean_score")).alias("below_best"))


def native_paths(spark, d):
    """Native locus of each family and species with one copy: exons by span, and each transcript as their numbers in reading order.

    A copy on two contigs or strands has no locus of its own; families with several copies of a species are told apart.
    """
    x = _exonic(spark, d).where("transcript_id is not null")
    loci = x.groupBy("family_id", "species").agg(F.count_distinct("gene_copy_id").alias("n"), F.count_distinct("contig").alias("k"), F.count_distinct("strand").alias("s"))
    why = F.when(c("n") > 1, "several_copies").when(c("k") > 1, "several_contigs").when(c("s") > 1, "several_strands").otherwise("native")
    rows = x.join(loci.withColumn("status", why), ["family_id", "species"]).where("status = 'native'").select(*COPY, "transcript_id", "strand", "start", "end").distinct()
    spans = rows.select(*COPY, "start", "end").distinct()
    numbered = spans.withColumn("exon", F.row_number().over(W.partitionBy(*COPY).orderBy("start", "end")))
    paths = rows.join(numbered, [*COPY, "start", "end"]).groupBy(*COPY, "transcript_id", "strand").agg(F.sort_array(F.collect_list("exon")).alias("e"), F.sum(c("end") - c("start") + 1).alias("path_bases"))
    ordered = F.when(c("strand") == "-", F.reverse("e")).otherwise(c("e"))
    return paths.select(*COPY, "transcript_id", F.array_join(F.transform(ordered, lambda v: v.cast("string")), ",").alias("exon_path"), F.size("e").alias("n_exons"), "path_bases")


def catalogue_axes(spark, d):
    """Catalogue of each native locus: its axis, the spans and junctions that its transcripts declare, and whether it stands alone.

    Coordinates are half-open from the first base of the locus. A catalogue whose native region reaches into another
    family's on the contig breaks the collection.
    """
    x = _exonic(spark, d).where("transcript_id is not null")
    keys = [*COPY, "contig"]
    order = W.partitionBy(*keys, "transcript_id").orderBy("start", "end")
    rows = x.select("family_id", "species", "gene_copy_id", "contig", "transcript_id", "start", "end").distinct().withColumn("next", F.lead("start").over(order))
    axis = rows.groupBy(*keys).agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.count_distinct("start", "end").alias("n_spans"), F.count_distinct(F.when(c("next") > c("end"), F.struct("end", "next"))).alias("n_junctions"), F.count_distinct("transcript_id").alias("n_transcripts"))
    reach = F.max(F.struct(c("hi").alias("hi"), c("family_id").alias("family_id"))).over(W.partitionBy("species", "contig").orderBy("lo", "hi", "family_id", "gene_copy_id").rowsBetween(W.unboundedPreceding, -1))
    rows = axis.withColumn("p", reach)
    clash = F.coalesce((c("lo") <= c("p.hi")) & (c("p.family_id") != c("family_id")), F.lit(False))
    return rows.select(*keys, (c("hi") - c("lo") + 1).alias("length"), "n_spans", "n_junctions", "n_transcripts", F.when(clash, "overlaps_another_family").otherwise("disjoint").alias("validation"))


def projection_compatibility(spark, d):
    """Segments of one copy in one element: mergeable if their comparable intervals are disjoint and in the order of the genome.

    Both orders are compared by neighbours and a running maximum, without pairs.
    """
    o = _occ(spark, d).select("occurrence_id", "gene_copy_id", "contig", "strand", "start", "end")
    h = _homology(spark, d).where("comparable_start >= 1 and comparable_start <= comparable_end").groupBy("homology_id", "occurrence_id").agg(F.min("comparable_start").alias("s"), F.max("comparable_end").alias("e"))
    rows = h.join(o, "occurrence_id").withColumn("at", F.when(c("strand") == "-", -c("end")).otherwise(c("start")))
    w = W.partitionBy("homology_id", "gene_copy_id").orderBy("s", "e", "occurrence_id")
    reach, before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.max("at").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("meets", F.coalesce(c("s") <= reach, F.lit(False))).withColumn("turns", F.coalesce(c("at") <= before, F.lit(False)))
    got = rows.groupBy("homology_id", "gene_copy_id").agg(F.count("*").alias("n"), F.max("meets").alias("meets"), F.max("turns").alias("turns"), F.count_distinct("contig", "strand").alias("k"))
    call = F.when(c("k") > 1, "several_places").when(c("meets"), "overlapping_projections").when(c("turns"), "order_disagrees").otherwise("mergeable")
    return got.where("n > 1").select("homology_id", "gene_copy_id", c("n").alias("n_segments"), call.alias("call"))


def anchor_cover(spark, d):
    """Introns whose two flanks lie in one continuous segment of each transcript that reaches there: all must span them."""
    x = _exonic(spark, d).where("transcript_id is not null")
    keys = ["gene_copy_id", "contig"]
    i = _occ(spark, d).where("role = 'intron'").select(*keys, c("occurrence_id").alias("intron_id"), (c("start") - 1).alias("start"), (c("end") + 1).alias("end"))
    from arborix.operators import ranges

    hit = ranges.overlap_join(i, x.select(*keys, "transcript_id", "start", "end"), keys)
    spans = (c("r_start") <= c("l_start")) & (c("r_end") >= c("l_end"))
    per = hit.groupBy(c("l_intron_id").alias("intron_id"), c("r_transcript_id").alias("t")).agg(F.max(spans).alias("spans"))
    got = per.groupBy("intron_id").agg(F.count("*").alias("n_transcripts"), F.min("spans").alias("all_span"))
    return got.select("intron_id", "n_transcripts", F.coalesce("all_span", F.lit(False)).alias("covered_by_all"))


def model_fits(spark, d):
    """Equal rates against separate gain and loss, both fitted to each brand's patterns: likelihood ratio and choice by AIC.

    The root's state is a parameter too. A brand whose patterns show one state alone isn't fitted.
    """
    tips, edges = _tips(spark, d), [(r.child, r.parent, r.length) for r in _edges(spark, d).orderBy("level", "child").collect()]
    rows = S.patterns(_cells(spark, d), "p_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    rows = rows.groupBy("p_brand", "pattern").agg(F.count("*").alias("w"))

    def kernel(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("pattern")  # one order of sums
        return rates.compare(edges, tips, list(pdf["pattern"]), pdf["w"].to_numpy(float))

    return by_group(rows, ["p_brand"], kernel, "fit string, er_rate double, er_loglik double, gain double, loss double, ard_loglik double, p_value double, chosen string", largest=1_000_000)


def foreground_fits(spark, d, region: str = "ASIA"):
    """Whether the rates of each brand differ on the branches of a declared region from those of the rest of the tree."""
    found = _edges(spark, d).orderBy("level", "child").collect()
    tips, edges = _tips(spark, d), [(r.child, r.parent, r.length) for r in found]
    foreground = frozenset(r.child for r in found if region in (r.child, r.parent))
    rows = S.patterns(_cells(spark, d), "p_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    rows = rows.groupBy("p_brand", "pattern").agg(F.count("*").alias("w"))

    def kernel(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values("pattern")
        return rates.compare_foreground(edges, tips, list(pdf["pattern"]), pdf["w"].to_numpy(float), foreground)

    return by_group(rows, ["p_brand"], kernel, "fit string, gain double, loss double, times double, null_loglik double, foreground_loglik double, p_value double", largest=1_000_000)


def _views(spark, d) -> DataFrame:
    """Inner changes of the witness of each character and region, under three readings of what is unknown (a scenario each)."""
    cells = _cells(spark, d)
    edges = F.broadcast(_edges(spark, d).where("level = 1").select(c("child").alias("tip"), c("parent").alias("region")))
    readings = F.array(*[F.struct(F.lit(n).alias("scenario"), s.alias("s")) for n, s in (("as_observed", c("state")), ("unknown_absent", F.coalesce("state", F.lit(0))), ("unknown_present", F.coalesce("state", F.lit(1))))])
    rows = cells.join(edges, "tip").select("p_partkey", "region", F.explode(readings).alias("r")).select("p_partkey", "region", "r.*")
    n = lambda v: F.sum(F.coalesce(c("s") == v, F.lit(False)).cast("long"))
    per = rows.groupBy("p_partkey", "region", "scenario").agg(n(0).alias("n0"), n(1).alias("n1"))
    return per.select("p_partkey", "region", "scenario", F.least("n0", "n1").alias("least"), F.when(c("n0") * c("n1") > 0, F.least("n0", "n1") + 1).otherwise(F.least("n0", "n1")).alias("most"), F.when(c("n0") + c("n1") == 0, "none").when(c("n0") > c("n1"), "gain").otherwise("loss").alias("consequence"))


def robust_events(spark, d):
    """Changes within a region over all readings of what is unknown: required if every reading has them, possible if some has."""
    return O_robust(_views(spark, d).where("most > 0"), ["p_partkey", "region"], "scenario", 3)


def gene_summaries(spark, d):
    """Brands' characters: those with one number of changes under every reading are resolved, and only their changes are summed."""
    rows = O_robust(_views(spark, d), ["p_partkey", "region"], "scenario", 3).groupBy("p_partkey").agg(F.sum("minimum_count").alias("lo"), F.sum("maximum_count").alias("hi"))
    rows = rows.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    ok = c("lo") == c("hi")
    n = lambda x: F.sum(x.cast("long"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n_units"), n(ok).alias("n_resolved"), n(~ok).alias("n_unresolved"), F.sum(F.when(ok, c("lo"))).alias("edits_of_resolved"))


def element_assignment(spark, d):
    """Elements of each occurrence by its source label, else by occurrence alone; several make it ambiguous, with the set kept."""
    h = _homology(spark, d).select("homology_id", "occurrence_id", status.state(c("source_label")).alias("label")).distinct()
    o = _latest(spark, d).select("occurrence_id", status.state(c("annotation_source")).alias("annotation"))
    elements = lambda rows: F.array_join(F.sort_array(F.collect_set(rows)), ";")
    exact = h.where("label <> 'unknown'").groupBy("occurrence_id").agg(elements(c("homology_id")).alias("by_label"), F.count_distinct("homology_id").alias("n_label"))
    every = h.groupBy("occurrence_id").agg(elements(c("homology_id")).alias("by_id"), F.count_distinct("homology_id").alias("n_id"))
    rows = o.join(every, "occurrence_id", "left").join(exact, "occurrence_id", "left")
    n = F.coalesce("n_label", "n_id", F.lit(0))
    return rows.select("occurrence_id", "annotation", F.coalesce("by_label", "by_id").alias("elements"), n.alias("n_elements"), F.when(n == 0, "unassigned").when(n > 1, "ambiguous").when(c("n_label").isNotNull(), "by_label").otherwise("by_occurrence").alias("assignment"))


QUERIES = {
    f.__name__: f
    for f in (
        pair_evidence, edge_eligibility, missing_elements, site_matrix, universe_validation, ancestral_consistency, event_tiers, history_witness, path_completeness, input_validation, backend_baselines, native_paths,
        catalogue_axes, projection_compatibility, anchor_cover, model_fits, foreground_fits, robust_events, gene_summaries, element_assignment,
    )
}

_AND = lambda more: ", " + more.removeprefix("WITH ").strip()
_C = "family_id, species, gene_copy_id"
_CTX = lambda a, b: f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} IN ('alternative', 'unknown') OR {b} IN ('alternative', 'unknown') THEN 0.5 WHEN {a} = {b} THEN 1 WHEN 'terminal' IN ({a}, {b}) THEN 0.5 ELSE 0.25 END::DOUBLE"
_EX = "('CDS', 'exon', 'UTR', 'noncoding_exon')"
_NO = "('intron', 'intergenic')"
_ST = lambda x: f"CASE WHEN {x} IS NULL OR trim({x}) IN ('', 'NA', '.', '?', 'unknown') THEN 'unknown' ELSE trim({x}) END"
_OK = "((alignment_score >= tt AND coverage_score >= 0.45::DOUBLE) OR (alignment_score >= tt + 0.15::DOUBLE AND coverage_score >= 0.30::DOUBLE))"
_HD = "hd AS (SELECT DISTINCT homology_id, occurrence_id FROM segment_homology WHERE homology_id IS NOT NULL AND occurrence_id IS NOT NULL)"
_MATRIX = (
    OCC
    + f""", {_HD}, lo AS (SELECT occurrence_id, family_id, species, role, {_ST("presence_status")} AS presence FROM latest WHERE family_id IS NOT NULL AND species IS NOT NULL),
k AS (SELECT homology_id, family_id, species, bool_or(presence = 'present') AS p, bool_or(presence = 'absent') AS a, bool_or(presence = 'unknown') AS u, coalesce(bool_or(presence = 'present' AND role IN ('CDS', 'exon', 'UTR')), false) AS x,
coalesce(bool_or(presence = 'present' AND role NOT IN ('CDS', 'exon', 'UTR')), false) AS z, bool_or(presence = 'present' AND role IS NULL) AS w FROM hd JOIN lo USING (occurrence_id) GROUP BY 1, 2, 3),
g AS (SELECT e.family_id, e.homology_id, q.species, p, x, z, w, CASE WHEN p THEN 'present' WHEN a AND NOT u THEN 'absent' ELSE 'unknown' END AS presence FROM (SELECT DISTINCT homology_id, family_id FROM k) e JOIN (SELECT DISTINCT family_id, species FROM lo) q ON q.family_id = e.family_id
LEFT JOIN k ON k.homology_id = e.homology_id AND k.family_id = e.family_id AND k.species = q.species),
cells AS (SELECT *, CASE presence WHEN 'absent' THEN 'inapplicable' WHEN 'unknown' THEN 'undetermined' ELSE CASE WHEN x AND z THEN 'conflict' WHEN x THEN 'exonic' WHEN w THEN 'undetermined' ELSE 'not_exonic' END END AS role,
CASE WHEN p IS NULL THEN 'no_member_in_species' WHEN presence = 'unknown' THEN 'presence_not_established' WHEN x AND z THEN 'roles_disagree' ELSE 'observed' END AS reason FROM g),
mat AS (SELECT family_id, homology_id, species, 'exon_presence' AS layer, presence AS state, true AS applicable, reason FROM cells UNION ALL SELECT family_id, homology_id, species, 'exon_role', role, presence <> 'absent', reason FROM cells)
"""
)
_STATES = """
WITH r AS (SELECT layer, object_id, node_id, state, max(probability) AS p FROM ancestral_state_probabilities WHERE layer IS NOT NULL AND object_id IS NOT NULL AND node_id IS NOT NULL AND state IN ('0', '1', '2', '3') AND probability IS NOT NULL AND NOT isnan(probability) GROUP BY ALL),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY layer, object_id, node_id ORDER BY p DESC, state) = 1)
"""
_VIEWS = (
    _CELLS
    + """, v AS (SELECT p_partkey, region, sc, count(*) FILTER (s = 0) AS n0, count(*) FILTER (s = 1) AS n1 FROM (SELECT p_partkey, region, 'as_observed' AS sc, state AS s FROM cells UNION ALL SELECT p_partkey, region, 'unknown_absent', coalesce(state, 0) FROM cells UNION ALL SELECT p_partkey, region, 'unknown_present', coalesce(state, 1) FROM cells) GROUP BY 1, 2, 3),
w AS (SELECT p_partkey, region, sc, least(n0, n1) AS lo, CASE WHEN n0 * n1 > 0 THEN least(n0, n1) + 1 ELSE least(n0, n1) END AS hi, CASE WHEN n0 + n1 = 0 THEN 'none' WHEN n0 > n1 THEN 'gain' ELSE 'loss' END AS co FROM v)
"""
)
SQL = {
    "robust_events": _VIEWS
    + "SELECT p_partkey, region, CASE WHEN count(*) < 3 THEN 0 ELSE min(lo) END::BIGINT AS minimum_count, max(hi)::BIGINT AS maximum_count, CASE WHEN CASE WHEN count(*) < 3 THEN 0 ELSE min(lo) END > 0 THEN 'required' ELSE 'possible' END AS support, string_agg(DISTINCT co, ';' ORDER BY co) AS consequences FROM w WHERE hi > 0 GROUP BY 1, 2",
    "gene_summaries": _VIEWS
    + ", u AS (SELECT p_partkey, sum(lo) AS lo, sum(hi) AS hi FROM (SELECT p_partkey, region, min(lo) AS lo, max(hi) AS hi FROM w GROUP BY 1, 2) GROUP BY 1) SELECT p_brand, count(*) AS n_units, count(*) FILTER (lo = hi) AS n_resolved, count(*) FILTER (lo <> hi) AS n_unresolved, (sum(lo) FILTER (lo = hi))::BIGINT AS edits_of_resolved FROM u JOIN part USING (p_partkey) GROUP BY 1",
    "element_assignment": OCC
    + f""", h AS (SELECT DISTINCT homology_id, occurrence_id, {_ST("source_label")} AS label FROM segment_homology WHERE homology_id IS NOT NULL AND occurrence_id IS NOT NULL),
x AS (SELECT occurrence_id, string_agg(DISTINCT homology_id, ';' ORDER BY homology_id) AS bl, count(DISTINCT homology_id) AS nl FROM h WHERE label <> 'unknown' GROUP BY 1), y AS (SELECT occurrence_id, string_agg(DISTINCT homology_id, ';' ORDER BY homology_id) AS bi, count(DISTINCT homology_id) AS ni FROM h GROUP BY 1)
SELECT latest.occurrence_id, {_ST("annotation_source")} AS annotation, coalesce(bl, bi) AS elements, coalesce(nl, ni, 0) AS n_elements, CASE WHEN coalesce(nl, ni, 0) = 0 THEN 'unassigned' WHEN coalesce(nl, ni) > 1 THEN 'ambiguous' WHEN nl IS NOT NULL THEN 'by_label' ELSE 'by_occurrence' END AS assignment
FROM latest LEFT JOIN y USING (occurrence_id) LEFT JOIN x USING (occurrence_id)""",
    "pair_evidence": OCC
    + _AND(_M)
    + f""", pl AS (SELECT occurrence_id, CASE WHEN count(*) OVER p > 1 THEN (row_number() OVER w - 1)::DOUBLE / (count(*) OVER p - 1) ELSE 0 END AS place, coalesce(lag(role) OVER w, 'terminal') AS l, coalesce(lead(role) OVER w, 'terminal') AS r FROM occ
WINDOW p AS (PARTITION BY {_C}, transcript_id), w AS (PARTITION BY {_C}, transcript_id ORDER BY transcript_order NULLS FIRST, start, occurrence_id)),
cx AS (SELECT occurrence_id, round(avg(place), 6) AS idx, CASE WHEN min(l) = max(l) THEN min(l) ELSE 'alternative' END AS lr, CASE WHEN min(r) = max(r) THEN min(r) ELSE 'alternative' END AS rr FROM pl GROUP BY 1),
e AS (SELECT latest.occurrence_id AS id, role, phase, splice_motif_score AS sp, greatest(1, "end" - start + 1) AS n, idx, lr, rr FROM latest LEFT JOIN cx USING (occurrence_id)),
f AS (SELECT match_id, coalesce(alignment_score, 0) AS i, coalesce(coverage_score, 0) AS v, {_CTX("q.lr", "t.lr")} AS left_context, {_CTX("q.rr", "t.rr")} AS right_context,
CASE WHEN q.role IS NOT DISTINCT FROM t.role THEN 1 WHEN q.role IN {_EX} AND t.role IN {_EX} THEN 0.75 WHEN (q.role IN {_EX} AND t.role IN {_NO}) OR (q.role IN {_NO} AND t.role IN {_EX}) THEN 0.45 ELSE 0.25 END::DOUBLE AS boundary_score,
CASE WHEN q.phase IS NULL OR t.phase IS NULL OR q.phase IN ('', '.', 'NA') OR t.phase IN ('', '.', 'NA') THEN 0.6 WHEN q.phase = t.phase THEN 1 ELSE 0.1 END::DOUBLE AS phase_score, 1::DOUBLE - abs(coalesce(q.idx, 0.5) - coalesce(t.idx, 0.5)) AS order_score,
CASE WHEN alignment_strand = '-' THEN 0 ELSE 1 END::DOUBLE AS strand_score, 1::DOUBLE - abs(coalesce(q.sp, 0.5) - coalesce(t.sp, 0.5)) AS splice_score, least(q.n, t.n) / greatest(q.n, t.n) AS r FROM m JOIN e q ON q.id = query_occurrence_id JOIN e t ON t.id = subject_occurrence_id)
SELECT match_id, left_context, right_context, boundary_score, phase_score, strand_score, {E.micro_sql("order_score")} AS order_score, {E.micro_sql("splice_score")} AS splice_score, {E.micro_sql("r")} AS size_ratio, {E.micro_sql("0.7::DOUBLE * i + 0.3::DOUBLE * v")} AS sequence_score,
{E.micro_sql("0.5::DOUBLE * left_context + 0.5::DOUBLE * right_context")} AS structural_context_score, {E.micro_sql(" + ".join(f"{w}::DOUBLE * {n}" for w, n in zip(E.WEIGHTS, "i v left_context right_context boundary_score phase_score order_score strand_score splice_score".split())))} AS total_score FROM f""",
    "edge_eligibility": _M
    + _O
    + f""", p AS (SELECT m.*, a.role AS ra, b.role AS rb, a.gene_copy_id AS ca, b.gene_copy_id AS cb, {_T} AS tt FROM m JOIN lo a ON a.occurrence_id = query_occurrence_id JOIN lo b ON b.occurrence_id = subject_occurrence_id),
b AS (SELECT *, max(total_score) OVER (PARTITION BY query_occurrence_id, cb) AS best FROM p), n AS (SELECT *, CASE WHEN cb IS NOT NULL THEN count(*) FILTER (total_score = best) OVER (PARTITION BY query_occurrence_id, cb) END AS k FROM b),
r AS (SELECT match_id, CASE WHEN match_status IS DISTINCT FROM 'mapped' THEN 'not_mapped' WHEN NOT coalesce(ca <> cb, false) THEN 'not_two_copies' WHEN NOT coalesce(ra = rb OR (ra IN {_EX} AND rb IN {_EX}) OR (ra IN {_NO} AND rb IN {_NO}), false) THEN 'incompatible_roles'
WHEN NOT coalesce({_OK}, false) THEN 'sequence_not_accepted' WHEN NOT coalesce(total_score = best, false) THEN 'not_best_in_copy' WHEN k > 1 THEN 'several_placements' ELSE 'position' END AS reason FROM n)
SELECT match_id, reason, reason IN ('not_best_in_copy', 'several_placements', 'position') AS membership_eligible, reason = 'position' AS position_eligible FROM r""",
    "missing_elements": OCC
    + f""", {_HD}, one AS (SELECT family_id, species, min(gene_copy_id) AS gene_copy_id FROM occ GROUP BY 1, 2 HAVING count(DISTINCT gene_copy_id) = 1), seen AS (SELECT DISTINCT homology_id, family_id, species FROM hd JOIN occ USING (occurrence_id))
SELECT e.family_id, e.homology_id, one.species, gene_copy_id FROM (SELECT DISTINCT homology_id, family_id FROM seen) e JOIN one ON one.family_id = e.family_id ANTI JOIN seen s ON s.homology_id = e.homology_id AND s.family_id = e.family_id AND s.species = one.species""",
    "site_matrix": _MATRIX + "SELECT * FROM mat",
    "universe_validation": _MATRIX
    + """, n AS (SELECT family_id, count(DISTINCT species) AS n_species FROM lo GROUP BY 1), v AS (SELECT family_id, homology_id, layer, count(DISTINCT species) AS n_cells, count(*) FILTER (state IN ('present', 'absent', 'exonic', 'not_exonic')) AS n_known FROM mat GROUP BY 1, 2, 3)
SELECT layer, CASE WHEN n_cells <> n_species THEN 'incomplete' WHEN n_known = 0 THEN 'all_masked' WHEN n_known < n_species THEN 'complete_with_masks' ELSE 'complete' END AS verdict, count(*) AS n_elements FROM v JOIN n USING (family_id) GROUP BY 1, 2""",
    "ancestral_consistency": """WITH s AS (SELECT regexp_extract(object_id, '(FAM[0-9]+)', 1) AS family_id, node_id, layer, string_agg(DISTINCT state, ';' ORDER BY state) AS states FROM ancestral_state_probabilities WHERE object_id IS NOT NULL AND node_id IS NOT NULL AND state IN ('0', '1') AND probability >= 0.5 AND NOT isnan(probability) GROUP BY ALL)
SELECT r.family_id, r.node_id, p.states AS sequence_states, r.states AS role_states, CASE WHEN p.states = '0' AND r.states IN ('0', '1') THEN 'incompatible_singleton_states' WHEN p.states <> '1' THEN 'dna_presence_unresolved' ELSE 'no_applicability_conflict' END AS status
FROM s r JOIN s p ON p.family_id = r.family_id AND p.node_id = r.node_id WHERE r.layer = 'exon_role' AND p.layer = 'exon_presence'""",
    "event_tiers": _STATES
    + """, up AS (SELECT node_id, min(parent_id) AS parent_id FROM species_tree WHERE node_id IS NOT NULL AND parent_id NOT IN ('', 'NA', '.') GROUP BY 1),
j AS (SELECT a.layer, a.object_id, a.p * b.p AS both_p, least(a.p, b.p) AS le, round(1 - least(a.p, b.p), 9) AS pv FROM s a JOIN up USING (node_id) JOIN s b ON b.layer = a.layer AND b.object_id = a.object_id AND b.node_id = up.parent_id WHERE b.state <> a.state),
k AS (SELECT *, count(*) OVER (PARTITION BY layer) AS mm, count(*) OVER (PARTITION BY layer ORDER BY pv RANGE UNBOUNDED PRECEDING) AS rk FROM j), q AS (SELECT *, least(1.0, min(pv * mm / rk) OVER (PARTITION BY layer ORDER BY pv DESC RANGE UNBOUNDED PRECEDING)) AS qv FROM k)
SELECT layer, CASE WHEN both_p >= 0.8::DOUBLE OR qv <= 0.05::DOUBLE THEN 'high' WHEN both_p >= 0.5::DOUBLE OR le >= 0.5::DOUBLE OR pv <= 0.1::DOUBLE THEN 'moderate' ELSE 'qualitative' END AS tier, count(*) AS n_changes, count(DISTINCT object_id) AS n_objects FROM q GROUP BY 1, 2""",
    "history_witness": _CELLS
    + """, w AS (SELECT p_partkey, CASE WHEN r0 <= r1 THEN 0 ELSE 1 END AS rs, least(r0, r1) AS mc FROM c2), x AS (SELECT p_partkey, rs, mc, v0, v1, CASE WHEN rs = 0 THEN CASE WHEN v0 <= v1 + 1 THEN 0 ELSE 1 END ELSE CASE WHEN v1 <= v0 + 1 THEN 1 ELSE 0 END END AS st FROM c1 JOIN w USING (p_partkey)),
y AS (SELECT p_partkey, rs AS root_state, mc, count(*) FILTER (st <> rs) AS n_inner_changes, sum(CASE WHEN st = 0 THEN v0 ELSE v1 END)::BIGINT AS n_tip_changes FROM x GROUP BY 1, 2, 3) SELECT p_partkey, root_state, n_inner_changes, n_tip_changes, n_inner_changes + n_tip_changes = mc AS attains_minimum FROM y""",
    "path_completeness": OCC
    + f""", t AS (SELECT {_C}, transcript_id, count(*) AS n, bool_or(regexp_matches(lower(coalesce(boundary_class, '') || ';' || coalesce(source_feature_id, '')), 'partial|truncated|incomplete')) AS cut, count(*) FILTER ({_ST("boundary_class")} = 'unknown') AS op, count(*) FILTER (boundary_class = 'terminal') AS en
FROM ex WHERE transcript_id IS NOT NULL GROUP BY ALL) SELECT CASE WHEN cut THEN 'partial' WHEN op > 0 THEN 'unassessed' WHEN en = 0 THEN 'no_terminal_border' ELSE 'complete' END AS call, count(*) AS n_transcripts, sum(n)::BIGINT AS n_segments FROM t GROUP BY 1""",
    "input_validation": "WITH o AS (SELECT * FROM segment_occurrences) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER ({t}) AS n_rows FROM o"
        for n, t in {
            "no_family": "family_id IS NULL", "no_species": "species IS NULL", "no_copy": "gene_copy_id IS NULL", "no_contig": "contig IS NULL", "bad_strand": "NOT coalesce(strand IN ('+', '-'), false)", "no_coordinates": 'start IS NULL OR "end" IS NULL', "below_one": "start < 1",
            "inverted": 'start > "end"', "bad_phase": "NOT coalesce(phase IN ('0', '1', '2', '.'), false)",
        }.items()
    )
    + " UNION ALL SELECT 'several_copies_of_a_species', count(*) FROM (SELECT 1 FROM o WHERE family_id IS NOT NULL AND species IS NOT NULL AND gene_copy_id IS NOT NULL GROUP BY family_id, species HAVING count(DISTINCT gene_copy_id) > 1)",
    "backend_baselines": _M
    + f", t AS (SELECT *, {_T} AS tt FROM m WHERE total_score IS NOT NULL AND NOT isnan(total_score)), b AS (SELECT backend, count(*) AS n, count(*) FILTER ({_OK}) AS n_accepted, {scores.exact_mean_sql('total_score')} AS mean_score FROM t GROUP BY 1) SELECT *, {E.micro_sql('(SELECT max(mean_score) FROM b) - mean_score')} AS below_best FROM b",
    "native_paths": OCC
    + f""", x AS (SELECT * FROM ex WHERE transcript_id IS NOT NULL), l AS (SELECT family_id, species FROM x GROUP BY 1, 2 HAVING count(DISTINCT gene_copy_id) = 1 AND count(DISTINCT contig) = 1 AND count(DISTINCT strand) = 1),
r AS (SELECT DISTINCT {_C}, transcript_id, strand, start, "end" FROM x JOIN l USING (family_id, species)), s AS (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY start, "end") AS e FROM (SELECT DISTINCT {_C}, start, "end" FROM r))
SELECT {_C}, transcript_id, string_agg(e::VARCHAR, ',' ORDER BY CASE WHEN strand = '-' THEN -e ELSE e END) AS exon_path, count(*)::INT AS n_exons, sum("end" - start + 1)::BIGINT AS path_bases FROM r JOIN s USING ({_C}, start, "end") GROUP BY {_C}, transcript_id, strand""",
    "catalogue_axes": OCC
    + f""", x AS (SELECT DISTINCT {_C}, contig, transcript_id, start, "end" FROM ex WHERE transcript_id IS NOT NULL), y AS (SELECT *, lead(start) OVER (PARTITION BY {_C}, contig, transcript_id ORDER BY start, "end") AS nx FROM x),
a AS (SELECT {_C}, contig, min(start) AS lo, max("end") AS hi, count(DISTINCT [start, "end"]) AS n_spans, count(DISTINCT CASE WHEN nx > "end" THEN ["end", nx] END) AS n_junctions, count(DISTINCT transcript_id) AS n_transcripts FROM y GROUP BY ALL),
p AS (SELECT *, max({{'h': hi, 'f': family_id}}) OVER (PARTITION BY species, contig ORDER BY lo, hi, family_id, gene_copy_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM a)
SELECT {_C}, contig, hi - lo + 1 AS length, n_spans, n_junctions, n_transcripts, CASE WHEN coalesce(lo <= q.h AND q.f <> family_id, false) THEN 'overlaps_another_family' ELSE 'disjoint' END AS validation FROM p""",
    "projection_compatibility": OCC
    + """, h AS (SELECT homology_id, occurrence_id, min(comparable_start) AS s, max(comparable_end) AS e FROM segment_homology WHERE homology_id IS NOT NULL AND occurrence_id IS NOT NULL AND comparable_start >= 1 AND comparable_start <= comparable_end GROUP BY 1, 2),
r AS (SELECT h.*, gene_copy_id, contig, strand, CASE WHEN strand = '-' THEN -"end" ELSE start END AS at_ FROM h JOIN occ USING (occurrence_id)),
t AS (SELECT homology_id, gene_copy_id, count(*) AS n, count(DISTINCT contig || ' ' || strand) AS k FROM r GROUP BY 1, 2),
v AS (SELECT a.homology_id, a.gene_copy_id, bool_or(a.s <= b.e AND b.s <= a.e) AS meets, bool_or(({'s': a.s, 'e': a.e, 'o': a.occurrence_id} < {'s': b.s, 'e': b.e, 'o': b.occurrence_id}) AND b.at_ <= a.at_) AS turns
FROM r a JOIN r b ON a.homology_id = b.homology_id AND a.gene_copy_id = b.gene_copy_id AND a.occurrence_id <> b.occurrence_id GROUP BY 1, 2)
SELECT homology_id, gene_copy_id, n AS n_segments, CASE WHEN k > 1 THEN 'several_places' WHEN meets THEN 'overlapping_projections' WHEN turns THEN 'order_disagrees' ELSE 'mergeable' END AS call FROM t JOIN v USING (homology_id, gene_copy_id) WHERE n > 1""",
    "anchor_cover": OCC
    + """, p AS (SELECT i.occurrence_id AS intron_id, x.transcript_id, bool_or(x.start <= i.start - 1 AND x."end" >= i."end" + 1) AS s FROM occ i JOIN ex x ON x.gene_copy_id = i.gene_copy_id AND x.contig = i.contig AND x.start <= i."end" + 1 AND x."end" >= i.start - 1
WHERE i.role = 'intron' AND x.transcript_id IS NOT NULL GROUP BY 1, 2) SELECT intron_id, count(*) AS n_transcripts, bool_and(s) AS covered_by_all FROM p GROUP BY 1""",
}
