import random

from pyspark.sql import functions as F

from arborix.operators import forest

SCHEMA = "scope string, n string, p string, id long, depth string"


def load(spark, rows):
    return forest.nodes(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), F.col("scope"), F.col("n"), F.col("p"))


def brute(rows):
    par = {}
    for s, n, p in rows:
        if n is not None:
            key = (s or "", n)
            real = p if p not in (None, "", "NA", ".") else None
            old = par.get(key)
            par[key] = min(x for x in (old, real) if x is not None) if old or real else None
    endless, tree = {}, {}
    for s, n in par:
        path, x = [], n
        while x is not None and (s, x) in par and x not in path:
            path.append(x)
            x = par[s, x]
        if x in path:
            endless[s, n] = min(path[path.index(x) :])
        else:
            tree[s, n] = path[::-1]
    return endless, tree


def check(spark, rows):
    endless, tree = brute(rows)
    got = {(r.scope, r.node): r.cycle_key for r in forest.Forest(load(spark, rows)).endless().collect()}
    assert got == endless
    h = forest.hierarchy(load(spark, rows)).collect()
    assert {(r.scope, r.node): r.path for r in h} == tree
    below = {}
    for (s, _), path in tree.items():
        for a in path[:-1]:
            below[s, a] = below.get((s, a), 0) + 1
    for r in h:
        assert r.root == r.path[0] and r.depth == len(r.path) - 1 and r.n_descendants == below.get((r.scope, r.node), 0)


def test_random_forests_with_cycles(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["", "a", None]), f"n{i}", rng.choice([None, "", "NA", ".", "gone"]) if rng.random() < 0.1 else f"n{rng.randrange(220)}") for i in rng.sample(range(220), 200)]
    check(spark, rows + rows[:20])


def test_chain_star_and_small_cycles(spark):
    rows = [("c", f"k{i:03d}", f"k{i - 1:03d}" if i else None) for i in range(120)]
    rows += [("s", f"l{i}", "hub") for i in range(50)] + [("s", "hub", ".")]
    rows += [("x", "me", "me"), ("x", "kid", "me"), ("y", "b", "a"), ("y", "a", "b"), ("y", "z", "b"), ("z", "p", "q"), ("z", "q", "r"), ("z", "r", "p"), ("z", None, "p"), ("z", "t", "p"), ("z", "u", "t")]
    check(spark, rows)


def test_empty(spark):
    df = load(spark, [])
    assert forest.Forest(df).endless().count() == 0 and forest.hierarchy(df).count() == 0
