from pathlib import Path

import pytest

from arborix.plans import kernels

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_intervals_hold_the_mean_and_are_the_same_at_every_run(spark):
    costs = {}
    parts = dict(spark.read.parquet(str(DATA / "part.parquet")).select("p_partkey", "p_brand").collect())
    for r in kernels.nstate_parsimony(spark, str(DATA)).collect():
        costs.setdefault(parts[r.p_partkey], []).append(r.min_cost)
    got = {r.p_brand: (r.low, r.median, r.high) for r in kernels.bootstrap_changes(spark, str(DATA)).collect()}
    assert set(got) == set(costs) and got == {r.p_brand: (r.low, r.median, r.high) for r in kernels.bootstrap_changes(spark, str(DATA)).collect()}
    for brand, c in costs.items():
        low, median, high = got[brand]
        assert low <= median <= high and abs(median - sum(c) / len(c)) <= max(0.35, high - low)
