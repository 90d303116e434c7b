import random

from arborix.llm.groups import groups


def brute(pairs):
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            up.setdefault(x, x)
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in up}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "m", 1) for a, b in pairs], "a string, b string, member string, c int")
    rows = groups(df, "a", "b").collect()
    assert len(rows) == len({r.member for r in rows})
    return {r.member: r.group_id for r in rows}


def test_chains_stars_and_random(spark):
    rng = random.Random(1)
    pairs = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(150)]
    pairs += [("hub", f"leaf{i}") for i in range(120)]
    pairs += [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(60)]
    pairs += [("é", "z"), ("Z", "z"), ("x", "x"), (None, "q"), ("q", None), ("p", "q"), ("q", "p"), ("p", "q"), ("", "empty")]
    rng.shuffle(pairs)
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [("a", "a"), (None, None)]) == {}
