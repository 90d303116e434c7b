import math

import numpy as np
import pytest

from arborix.kernels import chains as C, columns as K, configurations as X, markov as M, reconstruction as R

SPLIT = X.Catalogue(100, ((0, 100), (0, 40), (60, 100)), ((40, 60),), (), ((0, 100), (0, 40), (60, 100)))
EDGES = [("A", "x", 0.3), ("B", "x", 0.3), ("x", "r", 0.2), ("C", "r", 0.5)]


def test_split_is_required_on_one_branch():
    space = X.enumerate_space(SPLIT)
    whole, parts = X.compatible(space, ((0, 100),), ()), X.compatible(space, ((0, 40), (60, 100)), ())
    got = R.reconstruct(space, EDGES, {"A": whole, "B": whole, "C": parts})
    assert got["min_edits"] == 1
    calls = {(e["branch"], e["kind"]): e["call"] for e in got["events"]}
    assert calls == {("C", "split"): "possible", ("x", "fusion"): "possible", ("C", "fusion"): "possible", ("x", "split"): "possible"} or set(calls.values()) == {"possible"}
    one = R.reconstruct(space, [("A", "r", 1.0), ("B", "r", 1.0), ("C", "r", 1.0)], {"A": whole, "B": whole, "C": parts})
    assert [(e["branch"], e["kind"], e["call"]) for e in one["events"]] == [("C", "split", "required")]


def test_tract_arrives_once():
    space = X.enumerate_space(X.Catalogue(10, ((0, 10),), (), (("m", 0, 10),), ((0, 10),)))
    there, gone = X.compatible(space, ((0, 10),), (1,)), X.compatible(space, (), (0,))
    got = R.reconstruct(space, EDGES, {"A": there, "B": gone, "C": gone})
    assert got["min_edits"] == 1 and [(e["branch"], e["kind"]) for e in got["events"]] == [("A", "dna_insertion")]
    tips = {"A": there, "B": gone, "C": gone}
    rates = {"dna_insertion": 0.3, "dna_deletion": 0.2}
    many = X.log_likelihoods(space, EDGES, {k: v[:, None] for k, v in tips.items()}, rates)
    assert many[0] == pytest.approx(X.configuration_log_likelihood(space, EDGES, tips, rates))


def test_scenarios():
    assert len(R.observation_scenarios({"A": [1, 2], "B": [3]})) == 2
    with pytest.raises(X.Refused):
        R.observation_scenarios({c: [1, 2] for c in "ABCDEFG"})


def test_sampled_histories_agree_with_expectations():
    q = np.array([[-0.7, 0.7], [0.4, -0.4]])
    rng = np.random.default_rng(5)
    p = M.expm(q * 2.0)
    want = R.expected_changes(q, 2.0) / p
    for i in range(2):
        for j in range(2):
            n = [len(R.sample_branch(q, 2.0, i, j, rng)) for _ in range(1500)]
            assert np.mean(n) == pytest.approx(want[i, j], abs=4 * np.std(n) / math.sqrt(1500) + 1e-3)
            assert all(x % 2 == (i != j) for x in n)
    tips = {"A": np.array([[1.0], [0]]), "B": np.array([[1.0], [1]]), "C": np.array([[0.0], [1]])}
    h = R.sample_history(EDGES, tips, q, np.array([0.5, 0.5]), rng)
    assert set(h) == {"A", "B", "x", "C"} and (not h["C"] or h["C"][-1][1] == 1)


def test_local_members_and_tracts():
    blocks = [("a", "s1", 1, 10), ("b", "s1", 8, 20), ("c", "s2", 1, 5), ("d", "s2", 6, 9), ("e", "s1", 21, 30)]
    assert C.local_members(blocks, [("b", "d"), ("e", "zz")]) == {"a": "a", "b": "a", "d": "a", "c": "c", "e": "e"}
    flank = "ACGTACGTACGT"
    got = K.tracts({"a": flank + "---" + flank, "b": flank + "GGG" + flank, "c": flank + "NNN" + flank})
    assert got == [(12, 15, {"a": 0, "b": 1, "c": None})]
