"""Clusters of large groups by rounds against the ordered pass."""

import random

from arborix.kernels.chains import greedy_clusters
from arborix.operators.clusters import greedy_cluster_sizes
from arborix.plans import kernels


def test_rounds_equal_the_ordered_pass(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(12):
        n = rng.randrange(2, 30)
        owner = {f"s{k}": rng.choice([None, *"abcdefgh"]) for k in range(n)}
        edges = [(rng.randrange(3), rng.choice([0.5, rng.random()]), f"s{rng.randrange(n)}", f"s{rng.randrange(n)}") for _ in range(rng.randrange(1, 8 * n))]
        rows += [(g, *e, owner[e[2]], owner[e[3]]) for e in edges]
        got = greedy_clusters(edges, owner)
        sizes = [list(got.values()).count(c) for c in set(got.values())]
        want[g] = (len(got), len(sizes), max(sizes))
    df = spark.createDataFrame([*rows, (None, 0, 1.0, "s0", "s1", "a", "b")], "family long, far int, total_score double, left string, right string, left_owner string, right_owner string")
    assert {r[0]: tuple(r)[1:] for r in greedy_cluster_sizes(df, "family").collect()} == want
    assert greedy_cluster_sizes(df.limit(0), "family").count() == 0


def test_large_families_are_computed(spark):
    d = "/root/testdata/sf0.001"
    rows = lambda df: sorted(tuple(r[c] for c in ("family_id", "status", "n_segments", "n_clusters", "largest")) for r in df.collect())
    got = rows(kernels.greedy_clusters(spark, d, largest=3))
    assert got == rows(kernels.greedy_clusters(spark, d)) and {r[1] for r in got} == {"complete"}
