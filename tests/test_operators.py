import random

import pandas as pd
from pyspark.sql import functions as F

from arborix.operators import copies, matching, ranges
from arborix.operators.asof import asof_join
from arborix.operators.grouped import by_group

RNG = random.Random(9)


def test_by_group_refuses_large_groups_and_keeps_the_rest(spark):
    rows = [("a", None, i) for i in range(30)] + [("b", "x", i) for i in range(5)] + [("b", "y", 7)] + [(f"k{i}", "z", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, g string, v long")
    seen = lambda pdf: {"n": len(pdf), "total": int(pdf["v"].sum())}
    got = {tuple(r)[:2]: tuple(r)[2:] for r in by_group(df, ["k", "g"], seen, "n long, total long", largest=4).collect()}
    assert got["b", "x"] == ("budget", None, None) and got["b", "y"] == ("complete", 1, 7) and ("a", None) not in got
    assert len(got) == 302 and all(got[f"k{i}", "z"] == ("complete", 1, i) for i in range(300))
    assert by_group(df.limit(0), ["k"], seen, "n long, total long").count() == 0


def test_groups_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(f"k{RNG.randrange(12)}", i) for i in range(400)]
        df = spark.createDataFrame(rows, "k string, v long")
        got = {r.k: r.total for r in by_group(df, ["k"], lambda p: {"total": int(p["v"].sum())}, "total long").collect()}
        assert got == pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].sum().to_dict()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_asof(spark):
    left = [("a", i, RNG.choice([None, RNG.randrange(20)])) for i in range(60)] + [("b", 99, 5)]
    right = [("a", RNG.randrange(20), f"v{i:02d}") for i in range(25)] + [("a", None, "never"), ("c", 1, "other")]
    lf, rf = spark.createDataFrame(left, "k string, id long, at long"), spark.createDataFrame(right, "k string, t long, v string")
    for after in (False, True):
        for strict in (False, True):
            got = {r.id: r.v for r in asof_join(lf, rf, ["k"], "at", "t", "v", after, strict).collect()}
            for k, i, at in left:
                ok = [(t if not after else -t, v) for rk, t, v in right if rk == k and t is not None and at is not None and ((t > at if strict else t >= at) if after else (t < at if strict else t <= at))]
                assert got[i] == (max(ok)[1] if ok else None), (after, strict, at)


def test_overlap_and_point_joins(spark):
    span = lambda: (lambda s: (s, s + RNG.choice([0, 3, 40, 5000])))(RNG.randrange(1, 60_000))
    a, b = [("x", i, *span()) for i in range(80)], [(RNG.choice("xy"), i, *span()) for i in range(80)]
    fa, fb = (spark.createDataFrame(r, "k string, id long, start long, `end` long") for r in (a, b))
    want = sorted((i, j) for k, i, s, e in a for q, j, t, f in b if k == q and s <= f and t <= e)
    for bits in (3, 10, 20):
        assert sorted((r.l_id, r.r_id) for r in ranges.overlap_join(fa, fb, ["k"], bits).collect()) == want
    hits = ranges.point_join(fa, "start", fb, ["k"], 8).collect()
    assert sorted((r.l_id, r.r_id) for r in hits) == sorted((i, j) for k, i, s, _ in a for q, j, t, f in b if k == q and t <= s <= f)


def test_bh_and_best(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.5, None]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(p)], "t string, i int, p double")
    got = {r.i: r.q_value for r in matching.bh_adjust(df, ["t"], "p").collect()}
    assert [round(got[i], 9) if got[i] is not None else None for i in range(6)] == [0.05, 0.05, 0.05, 0.05, 0.5, None]
    m = spark.createDataFrame([(1, "a", "x", 0.9), (2, "a", "y", 0.9), (3, "b", "x", 0.5), (4, "c", "z", 0.1), (5, "c", "q", None)], "id int, l string, r string, s double")
    assert {r.id: r.best_status for r in matching.best_with_ties(m, ["l"], "s").collect()} == {1: "best_tie", 2: "best_tie", 3: "best_unique", 4: "best_unique", 5: "not_best"}
    assert sorted(r.id for r in matching.reciprocal_best(m, "id", "l", "r", "s").collect()) == [1, 2, 4]


def test_connected(spark):
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z", "y"), ("y", "y"), (None, "q")]
    got = {r.record: r.smallest for r in matching.connected(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(61)} | {"z": "y", "y": "y"}


def test_depth_and_components_where_intervals_touch(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("b", 1, 5), ("b", 5, 9), ("c", 1, 3)], "k string, start long, `end` long")
    got = {r.k: (r.covered, r.overlap, r.uncovered, r.relation) for r in copies.depth(df, ["k"], F.col("start"), F.col("end")).collect()}
    assert got == {"a": (9, 0, 0, "complementary_disjoint"), "b": (9, 1, 0, "repeated_overlap"), "c": (3, 0, 0, "single_projection")}
    assert {(r.k, r.start, r.end) for r in copies.merged(df, ["k"]).collect()} == {("a", 1, 9), ("b", 1, 9), ("c", 1, 3)}
    assert copies.components(df, ["k"]).where("k = 'b'").count() == 2


def test_overlaps_of_any_length(spark):
    import random

    rng = random.Random(2)
    top = 2**63 - 1
    spans = [(1, top), (top, top), (1, 1), (5, 2**40), (2**39, 2**39 + 2**20), (16_384, 16_384)]
    spans += [(s, min(top, s + rng.choice([0, 10, 20_000, 3_000_000, 10**10]))) for s in (rng.randrange(1, 10**7) for _ in range(60))]
    df = spark.createDataFrame([(i, "k", s, e) for i, (s, e) in enumerate(spans)], "id long, key string, start long, end long")
    got = sorted((r.l_id, r.r_id) for r in ranges.overlap_join(df, df, ["key"]).collect())
    assert got == sorted((i, j) for i, (a, b) in enumerate(spans) for j, (c, d) in enumerate(spans) if a <= d and c <= b)
    points = spark.createDataFrame([(1, "k", 1), (2, "k", top), (3, "k", 2**39)], "id long, key string, at long")
    got = sorted((r.l_id, r.r_id) for r in ranges.point_join(points, "at", df, ["key"]).collect())
    assert got == sorted((i, j) for i, p in ((1, 1), (2, top), (3, 2**39)) for j, (a, b) in enumerate(spans) if a <= p <= b)


def test_one_family_of_tests_is_cut_in_chunks(spark):
    rng = random.Random(8)
    p = [round(rng.random() ** 2, 3) for _ in range(3000)]
    df = spark.createDataFrame([("hot", x, i) for i, x in enumerate(p)] + [("b", 0.5, -1), ("b", None, -2)], "t string, p double, i long")
    order = sorted(p)
    m, q, low = len(p), {}, 1.0
    for k in range(m - 1, -1, -1):
        if k == m - 1 or order[k] != order[k + 1]:
            low = min(low, order[k] * m / (k + 1))
        q[order[k]] = low
    got = {r.i: r.q_value for r in matching.bh_adjust(df, ["t"], "p").collect()}
    assert all(abs(got[i] - q[x]) < 1e-12 for i, x in enumerate(p)) and got[-1] == 0.5 and got[-2] is None
    one = matching.quantiles(df.where("t = 'hot'"), ["t"], "p", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).first()
    import numpy as np

    assert [round(one[x], 9) for x in ("lo", "mid", "hi")] == [round(float(v), 9) for v in np.quantile(p, [0.025, 0.5, 0.975])] and one.n == 3000
