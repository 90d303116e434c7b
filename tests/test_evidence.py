import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from arborix.functions import coordinates as C, evidence as E
from arborix.kernels import columns as K, rates as R
from arborix.operators.scenarios import robust

FIELDS = ("evidence_status", "anchor_interval_status", "inferred_event", "frame_status", "inferred_role", "predicted_role", "annotation_status")


def test_completion_calls(spark):
    ok, hid, con = E.ANCHORED[0], "supports_hidden_segment", "conflicts_annotation"
    cases = [
        ((hid, "unknown", "", "", "exon", "exon", ""), 0.9, "ambiguous_evidence"), ((hid, ok, "protein_cds_projection", "", "other", "CDS", ""), 0.9, "predicted_exon_candidate"),
        ((con, ok, "", "", "other", "CDS", "protein_projection_boundary_conflict"), 0.9, "boundary_conflict_candidate"), ((con, ok, "", "", "exon", "other", "protein_projection_boundary_conflict"), 0.9, "boundary_conflict_candidate"),
        ((hid, ok, "shifted_splice_site", "", "exon", "", ""), 0.9, "shifted_splice_site_candidate"), ((hid, ok, "intron_deletion_joined_exon", "", "UTR", "", ""), 0.9, "joined_exon_candidate"),
        ((hid, ok, "", "frameshift_or_stop_risk", "CDS", "", ""), 0.9, "hidden_segment_with_frame_disruption"), ((hid, ok, "", "", "CDS", "", ""), 0.55, "hidden_segment_candidate"), ((hid, ok, "", "", "CDS", "", ""), 0.54, "ambiguous_evidence"),
        ((con, ok, "", "", "exon", "", ""), 0.9, "annotation_conflict_candidate"), (("supports_annotation", ok, "", "", "", "", ""), None, "supports_annotation"), (("supports_absence", E.ANCHORED[1], "", "", "", "", ""), None, "supports_true_absence"),
        (("homologous_sequence_candidate", ok, None, None, None, None, None), None, "homologous_sequence_candidate"), ((None, None, None, None, None, None, None), None, "ambiguous_evidence"),
    ]
    df = spark.createDataFrame([(i, *f, s) for i, (f, s, _) in enumerate(cases)], "i int, " + ", ".join(f"{f} string" for f in FIELDS) + ", score double")
    got = {r.i: r.call for r in df.select("i", E.completion_call({f: F.col(f) for f in FIELDS}, F.col("score")).alias("call")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)} and len(set(got.values())) == 11
    support = df.select(E.completion_support(F.lit(0.8), F.lit(None).cast("double"), F.lit("x")).alias("a"), E.completion_support(F.lit(0.8), F.lit(0.3), F.lit("supports_absence")).alias("b")).first()
    assert tuple(support) == (0.8, None)


def test_presence_and_flags(spark):
    names = ("candidate_resolution_status", "correspondence_status", "homologous_dna_presence", "homologous_dna_evidence", "completion_call", "absence_evidence")
    cases = [
        (("resolved", "resolved", "present", "aligned", None, None), "present"), (("resolved", "NA", "present", "NA", None, None), None), (("resolved", "ambiguous", "present", "aligned", None, None), None), (("", None, "present", "aligned", None, None), None),
        (("resolved", None, "absent", "ordered_flank_deletion", None, None), "absent"), (("resolved", None, "absent", "aligned", None, None), None), (("resolved", None, None, None, "supports_true_absence", "ordered_flank_deletion"), "absent"),
        (("resolved", None, None, None, "supports_true_absence", "other"), None),
    ]
    df = spark.createDataFrame([(i, *f) for i, (f, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} string" for n in names))
    assert {r.i: r.p for r in df.select("i", E.completion_presence({n: F.col(n) for n in names}).alias("p")).collect()} == {i: w for i, (_, w) in enumerate(cases)}
    rows = [(None, "mapped", None, None, None, True), ("0", "mapped", None, None, None, False), ("1", "candidate", None, None, None, True), (None, "mapped", "ambiguous", None, None, False), (None, "mapped", None, "annotated_CDS_protein", None, False), (None, "mapped", None, "annotated_CDS_protein", "1", True)]
    df = spark.createDataFrame(rows, "declared string, status string, resolution string, basis string, protein string, want boolean")
    assert df.where(E.membership_eligible(*[F.col(x) for x in ("declared", "status", "resolution", "basis", "protein")]) != F.col("want")).count() == 0
    tiers = [((0.9, None, None, None, None, None), "high"), ((None, None, None, None, 0.04, None), "high"), ((0.5, None, None, None, 0.2, None), "moderate"), ((None, None, None, 0.1, None, None), "moderate"), ((None,) * 6, "qualitative")]
    df = spark.createDataFrame([(*x, t) for x, t in tiers], ", ".join(f"c{i} double" for i in range(6)) + ", want string")
    assert df.where(E.support_tier(*[F.col(f"c{i}") for i in range(6)]) != F.col("want")).count() == 0
    supported = [("predicted_exon_candidate", "CDS", False, False, "resolved", "high", True), ("predicted_exon_candidate", "intron", False, False, None, "high", False), (None, None, False, True, None, "high", True), (None, None, False, False, None, "high", False), (None, "CDS", True, False, "open", "high", False), (None, "CDS", True, False, "NA", "LOW", False)]
    df = spark.createDataFrame(supported, "call string, role string, b boolean, x boolean, r string, conf string, want boolean")
    assert df.where(E.prediction_supported(F.col("call"), F.col("role"), F.col("b"), F.col("x"), [F.col("r")], F.col("conf")) != F.col("want")).count() == 0


def test_terms(spark):
    one = spark.range(1)
    get = lambda *x: tuple(one.select(*[c.alias(f"c{i}") for i, c in enumerate(x)]).first())
    lit = lambda *x: [F.lit(v).cast("string") for v in x]
    assert get(E.context(*lit("exon", "exon")), E.context(*lit("exon", "intron")), E.context(*lit("terminal", "exon")), E.context(*lit("alternative", "alternative")), E.context(*lit(None, "exon"))) == (1.0, 0.25, 0.5, 0.5, 0.5)
    assert get(E.boundary(*lit("CDS", "CDS")), E.boundary(*lit("CDS", "UTR")), E.boundary(*lit("intron", "UTR")), E.boundary(*lit("intron", "intergenic")), E.boundary(*lit(None, "CDS"))) == (1.0, 0.75, 0.45, 0.25, 0.25)
    assert get(E.phase(*lit("0", "0")), E.phase(*lit("0", "1")), E.phase(*lit(".", "1")), E.total(*[F.lit(1.0)] * 9)) == (1.0, 0.1, 0.6, 1.0)
    assert get(E.roles_compatible(*lit("CDS", "UTR")), E.roles_compatible(*lit("intron", "intergenic")), E.roles_compatible(*lit("CDS", "intron")), E.roles_compatible(*lit(None, None))) == (True, True, False, False)
    blocks = C.blocks_from_text(F.lit("1-3:5-7;6-9:8-11;x"))
    assert get(C.genomic_blocks(blocks, "q", F.lit("c:1"), F.lit(101), F.lit(120), F.lit("-"))) == ("c:1:112-115:-;c:1:118-120:-",)
    assert get(C.genomic_blocks(blocks, "t", F.lit("k"), F.lit(101), F.lit(120), F.lit("+"))) == ("k:105-107:+;k:108-111:+",)


def test_rows_of_a_cigar():
    assert K.aligned_rows("ACGTA", "ACTTAG", "2M1I1=1X2D") == ("ACGTA--", "AC-TTAG") and K.aligned_rows("NNACG", "ACG", "2S3M4H") == ("ACG", "ACG")
    rng = random.Random(1)
    for _ in range(50):
        ops = [(rng.choice("M=XIDNSHP"), rng.randrange(1, 5)) for _ in range(8)]
        q, t = "".join(rng.choices("ACGT", k=sum(n for o, n in ops if o in "M=XIS"))), "".join(rng.choices("ACGT", k=sum(n for o, n in ops if o in "M=XDN")))
        a, b = K.aligned_rows(q, t, "".join(f"{n}{o}" for o, n in ops))
        assert len(a) == len(b) == sum(n for o, n in ops if o in "M=XIDN") and b.replace("-", "") == t
        assert len(a.replace("-", "")) == sum(n for o, n in ops if o in "M=XI")


def test_robust_events(spark):
    rows = [("a", "s1", 1, 2, "gain"), ("a", "s2", 1, 1, "loss"), ("b", "s1", 2, 2, "gain")]
    got = {r.k: tuple(r)[1:] for r in robust(spark.createDataFrame(rows, "k string, s string, least long, most long, consequence string"), ["k"], "s", 2).collect()}
    assert got == {"a": (1, 2, "required", "gain;loss"), "b": (0, 2, "possible", "gain")}


def test_fits_against_a_grid():
    edges = [("a", "x", 0.7), ("b", "x", 0.7), ("c", "y", 0.7), ("d", "y", 0.7), ("x", "r", 0.4), ("y", "r", 0.4)]
    tips, rng = ["a", "b", "c", "d"], np.random.default_rng(3)
    patterns = ["".join(x) for x in itertools.product("01?", repeat=4)]
    weights = rng.integers(0, 9, len(patterns)).astype(float)
    letters = np.array([list(p) for p in patterns])
    known = {t: np.stack([letters[:, i] != "1", letters[:, i] != "0"]).astype(float) for i, t in enumerate(tips)}

    def brute(p, gain, loss, presence):
        total = 0.0
        for r, x, y in itertools.product((0, 1), repeat=3):
            states = {"r": r, "x": x, "y": y}
            m = presence if r else 1 - presence
            for child, parent, t in edges:
                moved = 1 - np.exp(-(gain + loss) * t)
                a, b = gain / (gain + loss) * moved, loss / (gain + loss) * moved
                row = [(1 - a, a), (b, 1 - b)][states[parent]]
                m *= row[states[child]] if child in states else sum(row[s] for s in (0, 1) if p[tips.index(child)] in (str(s), "?"))
            total += m
        return np.log(total)

    want = sum(w * brute(p, 0.4, 0.9, 0.3) for p, w in zip(patterns, weights))
    assert abs(R.log_likelihood(edges, known, weights, 0.4, 0.9, 0.3) - want) < 1e-8
    er, ard = R.fit(edges, known, weights, "ER"), R.fit(edges, known, weights, "ARD")
    grid = np.geomspace(0.01, 50, 25)
    assert er["log_likelihood"] >= max(R.log_likelihood(edges, known, weights, g, g, p) for g in grid for p in (0.1, 0.3, 0.5, 0.7, 0.9)) - 1e-6
    assert ard["log_likelihood"] >= max(R.log_likelihood(edges, known, weights, g, l, p) for g in grid for l in grid for p in (0.1, 0.5, 0.9)) - 1e-6
    assert ard["log_likelihood"] >= er["log_likelihood"] - 1e-6
    got = R.compare(edges, tips, patterns, weights)
    assert got["chosen"] in ("ER", "ARD", None) and R.compare(edges, tips, ["11?1"], np.ones(1))["fit"] == "no_observed_contrast"


def test_foreground_fits():
    edges = [("a", "x", 0.7), ("b", "x", 0.7), ("c", "y", 0.7), ("d", "y", 0.7), ("x", "r", 0.4), ("y", "r", 0.4)]
    tips, rng = ["a", "b", "c", "d"], np.random.default_rng(5)
    patterns = ["".join(x) for x in itertools.product("01", repeat=4)]
    letters = np.array([list(p) for p in patterns])
    known = {t: np.stack([letters[:, i] != "1", letters[:, i] != "0"]).astype(float) for i, t in enumerate(tips)}
    fore = frozenset("ab")
    chance = np.array([np.exp(R.log_likelihood(edges, {t: v[:, [k]] for t, v in known.items()}, np.ones(1), 0.2, 0.3, 0.4, 6.0, fore)) for k in range(16)])
    assert abs(chance.sum() - 1) < 1e-9
    weights = rng.multinomial(4_000, chance / chance.sum()).astype(float)
    got = R.compare_foreground(edges, tips, patterns, weights, fore)
    assert got["fit"] == "tested" and 3 < got["times"] < 12 and got["p_value"] < 0.001 and got["foreground_loglik"] > got["null_loglik"]
    assert R.compare_foreground(edges, tips, ["1111"], np.ones(1), fore)["fit"] == "no_observed_contrast"
