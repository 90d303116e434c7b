import random

import pytest

from pyspark.sql import functions as F

from arborix.operators import chunks, copies
from arborix.session import Scratch


@pytest.fixture
def small_chunks(spark):
    """Chunks as they are where rows are many: a small table's would be joined to one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_key_is_spread_over_tasks(spark, small_chunks):
    rng = random.Random(4)
    rows = [("hot", s, s + rng.randrange(0, 60), f"t{rng.randrange(3)}") for s in (rng.randrange(1, 20_000) for _ in range(2_000))] + [("b", 5, 5, "t0"), (None, 1, 2, "t0")]
    df = spark.createDataFrame(rows, "k string, start long, `end` long, t string")
    cut = chunks.chunked(df, ["k"], ["start", "end"], Scratch(spark, "x")).where("k = 'hot'").groupBy("chunk").count().collect()
    assert len(cut) >= 3 and max(r["count"] for r in cut) < 1_500

    spans = sorted((s, e) for k, s, e, _ in rows if k == "hot")
    islands, parts = [], []
    for s, e in spans:
        if not islands or s > islands[-1][1] + 1:
            islands.append([s, e, 0])
        islands[-1][1], islands[-1][2] = max(e, islands[-1][1]), islands[-1][2] + 1
        if not parts or s >= parts[-1][1]:
            parts.append([s, e, 0])
        parts[-1][1], parts[-1][2] = max(e, parts[-1][1]), parts[-1][2] + 1
    got = copies.merged(df, ["k"]).where("k = 'hot'").orderBy("start").collect()
    assert [[r.start, r.end, r.n_merged] for r in got] == islands
    got = copies.components(df, ["k"]).where("k = 'hot'").orderBy("component").collect()
    assert [[r.start, r.end, r.n_members] for r in got] == parts and [r.component for r in got] == list(range(1, len(parts) + 1))
    depth = copies.depth(df, ["k"], F.col("start"), F.col("end")).where("k = 'hot'").first()
    cover = [0] * 20_200
    for s, e in spans:
        for i in range(s, e + 1):
            cover[i] += 1
    assert (depth.covered, depth.overlap, depth.n_parts) == (sum(c > 0 for c in cover), sum(c > 1 for c in cover), 2_000)
    reach, want = None, 0
    for s, e, t in sorted((s, e, t) for k, s, e, t in rows if k == "hot"):
        want += reach is not None and s <= reach[0] and t != reach[1]
        reach = max(reach, (e, t)) if reach else (e, t)
    assert copies.disjointness_violations(df, ["k"], "t").where("k = 'hot'").count() == want
    assert copies.merged(df.limit(0), ["k"]).count() == 0
