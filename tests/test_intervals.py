import random

from pyspark.sql import functions as F

from arborix.operators.intervals import periods_and_gaps

SCHEMA = "copy string, contig string, start long, `end` long, kind string, start_pos string, _s int"


def brute(rows):
    by = {}
    for c, g, s, e, *_ in rows:
        if None not in (c, g, s, e) and s <= e:
            by.setdefault((c, g), []).append((s, e))
    out = set()
    for (c, g), spans in by.items():
        spans.sort()
        lo, hi = spans[0]
        for s, e in spans[1:]:
            if s > hi + 1:
                out |= {(c, g, "period", lo, hi), (c, g, "gap", hi + 1, s - 1)}
                lo, hi = s, e
            else:
                hi = max(hi, e)
        out.add((c, g, "period", lo, hi))
    return out


def run(spark, rows, parts=None):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["copy", "contig"], parts=parts).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_spans_at_every_chunk_size(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        s = rng.randrange(1, 900) if rng.random() < 0.9 else rng.randrange(1, 10**6)
        rows.append((rng.choice("aab"), rng.choice(["x", "y"]), s, s + rng.choice([-3, 0, 1, 5, 40, 3000 if rng.random() < 0.01 else 2]), "k", "z", 1))
    for parts in (1, 4, 16, None):
        assert run(spark, rows, parts) == brute(rows)


def test_touching_nested_nulls_and_extremes(spark):
    top = 2**63 - 1
    rows = [
        ("a", "x", 1, 5, None, None, None), ("a", "x", 6, 9, None, None, None), ("a", "x", 2, 3, None, None, None), ("a", "x", 2, 3, None, None, None), ("a", "x", 11, 11, None, None, None),
        ("a", None, 1, 2, None, None, None), (None, "x", 1, 2, None, None, None), ("b", "x", None, 2, None, None, None), ("b", "x", 3, None, None, None, None), ("b", "x", 9, 8, None, None, None),
        ("c", "x", top - 1, top, None, None, None), ("c", "x", -(2**63), -5, None, None, None), ("", "", 4, 4, None, None, None),
    ]
    assert run(spark, rows) == {
        ("a", "x", "period", 1, 9), ("a", "x", "gap", 10, 10), ("a", "x", "period", 11, 11),
        ("c", "x", "period", -(2**63), -5), ("c", "x", "gap", -4, top - 2), ("c", "x", "period", top - 1, top), ("", "", "period", 4, 4),
    }


def test_empty(spark):
    assert run(spark, []) == set()


def test_one_sparse_entity_is_cut_in_even_chunks(spark):
    rows = [("hot", "x", i * 10**9, i * 10**9 + 5 + (2 * 10**9 if i % 7 == 0 else 0), None, None, None) for i in range(4000)]
    assert run(spark, rows, 8) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = [r["count"] for r in df.repartitionByRange(8, "copy", "contig", "start").groupBy(F.spark_partition_id().alias("c")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
