"""Rates of large brands by sums over the cluster against the fit in one task."""

import pytest

from arborix.plans import kernels

D = "/root/testdata/sf0.001"


def test_large_brands_are_fitted(spark):
    want = {r.p_brand: r for r in kernels.mk_rate_fit(spark, D).collect()}
    got = {r.p_brand: r for r in kernels.mk_rate_fit(spark, D, largest=8).collect()}
    assert got.keys() == want.keys() and {r.status for r in got.values()} == {"complete"}
    for brand, r in got.items():
        w = want[brand]
        assert r.fit == w.fit
        for name in ("rate", "low", "high", "log_likelihood", "p_value"):
            assert r[name] == w[name] or r[name] == pytest.approx(w[name], abs=2e-3)
