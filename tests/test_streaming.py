from datetime import datetime, timedelta

from arborix.streaming import live
from tests.test_rejects import CASES

T0 = datetime(2031, 1, 1)


def run(spark, tmp_path, df, build, mode="append"):
    src, name = str(tmp_path / "in"), f"q{abs(hash(str(tmp_path)))}"
    df.coalesce(1).write.parquet(src)
    out = build(spark.readStream.schema(df.schema).parquet(src))
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_rejects(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES) if len(t) < 1000], "line_id long, raw_line string")
    got = run(spark, tmp_path, df, lambda s: live.parsed_lines(s, "line_id", "raw_line")[1])
    assert sorted(got) == sorted(("raw_feature_lines", i, r) for i, (t, rs) in enumerate(CASES) if len(t) < 1000 for r in rs)


def test_counts_and_first_deliveries(spark, tmp_path):
    rows = [(f"k{i % 7}", T0 + timedelta(minutes=i * 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, at timestamp")
    got = run(spark, tmp_path / "a", df, lambda s: live.windowed_counts(s, "at", [], late="0 seconds"), "complete")
    assert sum(n for *_, n in got) == 60 and len(got) == 10
    first = run(spark, tmp_path / "b", df, lambda s: live.first_deliveries(s, "k", "at"))
    assert sorted(k for k, _ in first) == sorted({k for k, _ in rows})


def test_running_reach(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 12, 13), ("b", 3, 3), ("a", 13, 20)], "k string, s long, e long")
    got = run(spark, tmp_path, df, lambda s: live.running_reach(s, "k", "s", "e"))
    assert sorted((k, s) for k, s, _, opens in got if opens) == [("a", 1), ("a", 12), ("b", 3)]
