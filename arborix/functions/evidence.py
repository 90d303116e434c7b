"""Evidence terms, eligibility and calls as column expressions. Words and numbers are fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXON_LIKE = ("CDS", "exon", "UTR", "noncoding_exon")
NOT_EXONIC = ("intron", "intergenic")
#: Weights of identity, coverage, the contexts on both sides, boundary, phase, order, strand and splice sites.
WEIGHTS = (0.34, 0.14, 0.10, 0.10, 0.10, 0.08, 0.06, 0.04, 0.04)
OPEN_CONTEXT = ("alternative", "unknown")
ANCHORED = ("ordered_double_flank_bounded_interval", "ordered_double_flank_empty_interval")
PARTIAL_WORDS = ("partial", "truncated", "incomplete")


def micro(value: Column) -> Column:
    """Six digits, halves up, the same in SQL (``micro_sql``)."""
    return F.floor(value * 1_000_000 + 0.5).cast("long") / 1_000_000.0


def micro_sql(value: str) -> str:
    return f"floor(({value}) * 1000000 + 0.5::DOUBLE)::BIGINT / 1000000.0::DOUBLE"


def context(left: Column, right: Column) -> Column:
    """Two neighbouring roles: 1 if equal, 0.5 if one is open or an end of a transcript, otherwise 0.25."""
    unclear = left.isNull() | right.isNull() | left.isin(*OPEN_CONTEXT) | right.isin(*OPEN_CONTEXT)
    return F.when(unclear, 0.5).when(left == right, 1.0).when((left == "terminal") | (right == "terminal"), 0.5).otherwise(0.25)


def boundary(left: Column, right: Column) -> Column:
    """Equal roles 1, both exonic .75, an exonic and a non-coding one .45, otherwise .25."""
    exonic = lambda c: F.coalesce(c.isin(*EXON_LIKE), F.lit(False))
    other = lambda c: F.coalesce(c.isin(*NOT_EXONIC), F.lit(False))
    return F.when(left.eqNullSafe(right), 1.0).when(exonic(left) & exonic(right), 0.75).when(exonic(left) & other(right) | other(left) & exonic(right), 0.45).otherwise(0.25)


def phase(left: Column, right: Column) -> Column:
    """Equal phases 1, different ones .1, .6 where one isn't given."""
    unknown = lambda c: c.isNull() | c.isin("", ".", "NA")
    return F.when(unknown(left) | unknown(right), 0.6).when(left == right, 1.0).otherwise(0.1)


def nearness(left: Column, right: Column, default: float = 0.5) -> Column:
    """1 less the difference of two shares, an unknown one taken as one half."""
    return 1.0 - F.abs(F.coalesce(left, F.lit(default)) - F.coalesce(right, F.lit(default)))


def total(*terms: Column) -> Column:
    """The weighted sum of the nine terms, in their order."""
    out = WEIGHTS[0] * terms[0]
    for w, t in zip(WEIGHTS[1:], terms[1:], strict=True):
        out = out + w * t
    return out


def roles_compatible(left: Column, right: Column) -> Column:
    """Equal, both exonic, or both structural (an intron or what lies between genes)."""
    both = lambda words: left.isin(*words) & right.isin(*words)
    return F.coalesce((left == right) | both(EXON_LIKE) | both(NOT_EXONIC), F.lit(False))


def flag(value: Column, default: Column) -> Column:
    """A declared 1 or 0; where nothing is declared, what older rows imply."""
    return F.when(value == "1", True).when(value == "0", False).otherwise(default)


def membership_eligible(declared: Column, status: Column, resolution: Column, basis: Column, protein: Column) -> Column:
    """Whether a match may join two records: declared, or mapped and resolved; one based on protein needs its own flag."""
    open_ = flag(declared, (status == "mapped") & (F.coalesce(resolution, F.lit("resolved")) == "resolved"))
    by_protein = F.coalesce(basis.contains("annotated_CDS_protein"), F.lit(False))
    return F.coalesce(open_, F.lit(False)) & (~by_protein | F.coalesce(flag(protein, F.lit(False)), F.lit(False)))


def completion_support(identity: Column, coverage: Column, status: Column) -> Column:
    """The smaller of identity and coverage (1 if not given); none for evidence of absence."""
    return F.when(~F.coalesce(status == "supports_absence", F.lit(False)), F.least(F.coalesce(identity, F.lit(0.0)), F.coalesce(coverage, F.lit(1.0))))


def completion_call(row: dict[str, Column], score: Column, threshold: float = 0.55) -> Column:
    """One of eleven calls of a search for a missing element.

    ``row``: evidence_status, anchor_interval_status, inferred_event, frame_status, inferred_role, predicted_role,
    annotation_status. Without an interval between two ordered flanks every call is ambiguous.
    """
    enough = F.coalesce(score >= threshold, F.lit(False))
    status, event, role = row["evidence_status"], row["inferred_event"], row["inferred_role"]
    hidden, conflict = status == "supports_hidden_segment", status == "conflicts_annotation"
    edge = row["annotation_status"] == "protein_projection_boundary_conflict"
    predicted = row["predicted_role"].isin(*EXON_LIKE) & enough
    exonic = role.isin(*EXON_LIKE) & enough
    return (
        F.when(~F.coalesce(row["anchor_interval_status"].isin(*ANCHORED), F.lit(False)), "ambiguous_evidence")
        .when(hidden & (event == "protein_cds_projection") & predicted, "predicted_exon_candidate")
        .when(conflict & edge & (predicted | exonic), "boundary_conflict_candidate")
        .when(hidden & exonic & (event == "shifted_splice_site"), "shifted_splice_site_candidate")
        .when(hidden & exonic & (event == "intron_deletion_joined_exon"), "joined_exon_candidate")
        .when(hidden & exonic & (row["frame_status"] == "frameshift_or_stop_risk"), "hidden_segment_with_frame_disruption")
        .when(hidden & exonic, "hidden_segment_candidate")
        .when(conflict & exonic, "annotation_conflict_candidate")
        .when(status == "supports_annotation", "supports_annotation")
        .when(status == "supports_absence", "supports_true_absence")
        .when(status == "homologous_sequence_candidate", "homologous_sequence_candidate")
        .otherwise("ambiguous_evidence")
    )


def completion_presence(row: dict[str, Column]) -> Column:
    """present, absent or null: every given resolution must say `resolved`, and absence needs a deletion between ordered flanks.

    ``row``: candidate_resolution_status, correspondence_status, homologous_dna_presence, homologous_dna_evidence,
    completion_call, absence_evidence.
    """
    known = lambda c: F.when(~F.trim(c).isin("", "NA", "."), F.trim(c))
    given = F.array_compact(F.array(known(row["candidate_resolution_status"]), known(row["correspondence_status"])))
    resolved = (F.size(given) > 0) & F.forall(given, lambda x: x == "resolved")
    seen, how = row["homologous_dna_presence"], row["homologous_dna_evidence"]
    called = (row["completion_call"] == "supports_true_absence") & (row["absence_evidence"] == "ordered_flank_deletion")
    unknown = how.isNull() | how.isin("", "NA", ".", "?", "unknown")
    return F.when(
        resolved,
        F.when(seen == "absent", F.when(how == "ordered_flank_deletion", "absent"))
        .when(seen == "present", F.when(~unknown, "present"))
        .when(called, "absent"),
    )


def prediction_supported(call: Column, role: Column, has_blocks: Column, has_conflicts: Column, resolutions: list[Column], confidence: Column) -> Column:
    """Whether a predicted exon may be set against an annotated role: a call or blocks, an exonic role, nothing unresolved, no low confidence."""
    called = F.coalesce(call.isin("predicted_exon_candidate", "boundary_conflict_candidate"), F.lit(False))
    out = (called | has_blocks | has_conflicts) & (~(called | has_blocks) | F.coalesce(role.isin(*EXON_LIKE), F.lit(False)))
    for r in resolutions:
        out = out & F.coalesce(r.isin("", "NA", ".", "resolved"), F.lit(True))
    return out & ~F.coalesce(F.lower(confidence).isin("low", "unknown", "unresolved"), F.lit(False))


def support_tier(ctmc: Column, stochastic: Column, event: Column, p: Column, q: Column, empirical: Column) -> Column:
    """high, moderate or qualitative, by the best of what is known about a change."""
    no = F.lit(False)
    at = lambda c, x: F.coalesce(c >= x, no)
    under = lambda c, x: F.coalesce(c <= x, no)
    return F.when(at(ctmc, 0.8) | at(stochastic, 0.8) | under(empirical, 0.05) | under(q, 0.05), "high").when(at(ctmc, 0.5) | at(stochastic, 0.5) | at(event, 0.5) | under(p, 0.10), "moderate").otherwise("qualitative")


def partial(*texts: Column) -> Column:
    """Whether any of the texts says that a record isn't whole."""
    said = F.lower(F.concat_ws(";", *texts))
    out = F.lit(False)
    for w in PARTIAL_WORDS:
        out = out | said.contains(w)
    return out
