import random
from datetime import datetime, timedelta

from arborix.operators.orphans import Reference, orphans

T0 = datetime(2031, 1, 1)


def run(spark, parents, refs):
    p = spark.createDataFrame(parents, "occ string, loaded_at timestamp, deleted_at timestamp, ref string, period int, id long")
    r = spark.createDataFrame(refs, "k string, a string, b string, loaded_at timestamp, known int")
    got = orphans(p, "occ", [Reference("t", r, "k", ("a", "b"))])
    return sorted((x.record_key, x.field_name, x.ref, x.cause) for x in got.collect())


def brute(parents, refs):
    first, gone = {}, {}
    for o, at, d, *_ in parents:
        if o is None:
            continue
        first.setdefault(o, None)
        if at and (first[o] is None or at < first[o]):
            first[o] = at
        if d and (o not in gone or d < gone[o]):
            gone[o] = d
    out = []
    for k, a, b, at, _ in refs:
        for f, x in (("a", a), ("b", b)):
            if x is None or x in ("", "NA", ".", "?", "unknown"):
                continue
            if x not in first:
                out.append((k, f, x, "missing"))
            elif at and first[x] and first[x] > at:
                out.append((k, f, x, "later"))
            elif at and gone.get(x) and gone[x] <= at:
                out.append((k, f, x, "withdrawn"))
    return sorted(out)


def test_random(spark):
    rng = random.Random(5)
    when = lambda p=0.05: None if rng.random() < p else T0 + timedelta(hours=rng.randrange(0, 4000))
    parents = [(rng.choice([f"o{rng.randrange(60)}", None]) if rng.random() < 0.1 else f"o{rng.randrange(60)}", when(), when(0.7), "x", 1, 2) for _ in range(150)]
    refs = [(f"r{i}", rng.choice([f"o{rng.randrange(80)}", "NA", "", None]), "o1" if rng.random() < 0.4 else f"o{rng.randrange(90)}", when(), 1) for i in range(400)]
    got = run(spark, parents, refs)
    assert got == brute(parents, refs) and len({c for *_, c in got}) == 3


def test_same_instant_and_empty(spark):
    at = datetime(2031, 5, 1, 12)
    assert run(spark, [("o", at, None, None, None, None)], [("r", "o", ".", at, 1)]) == []
    assert run(spark, [("o", at, at, None, None, None)], [("r", "o", "?", at, 1)]) == [("r", "a", "o", "withdrawn")]
    assert run(spark, [], [("r", "o", "unknown", at, 1)]) == [("r", "a", "o", "missing")]
    assert run(spark, [("o", at, at, None, None, None)], []) == []
