import math
import random

from arborix.llm.topn import top_n

SCHEMA = "o string, n string, s string, p double, _g int, _t string"


def brute(rows, k):
    best = {}
    for o, n, s, p, *_ in rows:
        if None in (o, n, s, p) or math.isnan(p):
            continue
        best[o, n, s] = max(p, best.get((o, n, s), -math.inf))
    by = {}
    for (o, n, s), p in best.items():
        by.setdefault(o, []).append((-p, n, s))
    return {(o, n, s, -p) for o, x in by.items() for p, n, s in sorted(x)[:k]}


def run(spark, rows, k, salts=8):
    got = [tuple(r) for r in top_n(spark.createDataFrame(rows, SCHEMA), "o", ["n", "s"], "p", k, salts).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ties_repeats_and_a_hot_group(spark):
    rng = random.Random(2)
    any_of = lambda *x: rng.choice(x)
    rows = [(any_of("hot", "hot", f"o{rng.randrange(40)}", None), any_of(f"n{rng.randrange(30)}", None), any_of("0", "1", None, "é"), any_of(0.5, 0.5, 0.25, rng.random(), None, float("nan"), float("inf"), -0.0, 0.0), 1, "x") for _ in range(3000)]
    for k in (1, 5):
        assert run(spark, rows, k) == brute(rows, k)
    assert run(spark, rows, 5, 1) == brute(rows, 5)


def test_empty(spark):
    assert run(spark, [], 5) == set() and run(spark, [("a", None, "1", 0.5, 1, "")], 5) == set()
