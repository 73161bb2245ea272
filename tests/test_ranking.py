import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import ranking, runs


@pytest.fixture(scope="module")
def channels(spark):
    rnd = random.Random(4)
    names = ["CCTV-1", "CCTV-5", "CCTV-5+", "CCTV-17", "CCTV新闻", "中央x"]
    rows = [(i, "央视频道", rnd.choice(names), rnd.randrange(100), f"u{i}") for i in range(80)]
    rows += [(100 + i, "其他频道", f"n{rnd.randrange(9)}", rnd.randrange(100), f"v{i}") for i in range(40)]
    return spark.createDataFrame(rows, "seq long, category string, norm_name string, quality long, url string")


def test_natural_and_tier_orders(spark):
    rows = [("CCTV-10", 1, 0), ("CCTV-5+", 2, 1), ("CCTV-5", 3, 2), ("CCTV-1", 4, 3), ("新闻", 50, 4), ("中央", 60, 5), ("CCTV-18", 9, 6)]
    df = spark.createDataFrame(rows, "norm_name string, best long, first_seq long")
    order = [*ranking.natural_keys(F.col("norm_name"), F.col("best"), F.lit(True)), F.col("first_seq")]
    got = [r.norm_name for r in ranking.order_channels(df, order).orderBy("position").collect()]
    assert got == ["CCTV-1", "CCTV-5", "CCTV-5+", "CCTV-10", "CCTV-18", "中央", "新闻"]
    plain = [r.norm_name for r in df.orderBy(*ranking.natural_keys(F.col("norm_name"), F.col("best"), F.lit(False))).collect()]
    assert plain[:2] == ["中央", "新闻"]
    old = df.withColumn("name", F.replace("norm_name", F.lit("-"), F.lit("")))
    tiers = [*ranking.tier_keys(F.col("name"), F.col("best")), F.col("first_seq")]
    assert [r.name for r in old.orderBy(*tiers).collect()] == ["CCTV1", "CCTV5", "CCTV10", "CCTV5+", "CCTV18", "中央", "新闻"]


def test_topk_and_cap(channels):
    top = ranking.topk_per_name(channels, 2)
    assert top.groupBy("category", "norm_name").count().agg(F.max("count")).first()[0] == 2
    ranked = ranking.with_channel_stats(top, ranking.group_best(channels))
    for limit in (5, 0):
        out = ranking.global_cap(ranked, ranking.output_order(ranked), limit).orderBy("line_no").collect()
        assert [r.line_no for r in out] == list(range(1, (limit or ranked.count()) + 1))
        assert out[0].norm_name == "CCTV-1"
    full = ranking.global_cap(ranked, ranking.output_order(ranked), 0).orderBy("line_no").collect()
    cats = [r.category for r in full]
    assert cats == sorted(cats, key=["央视频道", "其他频道"].index)
    moved = channels.repartition(6, F.rand(1))
    again = ranking.with_channel_stats(ranking.topk_per_name(moved, 2), ranking.group_best(moved))
    assert [r.url for r in ranking.global_cap(again, ranking.output_order(again), 0).orderBy("line_no").collect()] == [r.url for r in full]


def test_quota(spark):
    rows = [("央视频道", f"a{i}") for i in range(45)] + [("其他频道", f"b{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "category string, norm_name string")
    q = {r.category: r.quota for r in ranking.proportional_quota(df, 100).collect()}
    assert q == {"其他频道": 30, "央视频道": 70}
    several = df.unionByName(spark.createDataFrame([("4K专区", f"c{i}") for i in range(7)], "category string, norm_name string"))
    q = {r.category: r.quota for r in ranking.proportional_quota(several, 1000).collect()}
    assert sum(q.values()) == 1000
    assert q["其他频道"] == 5 * 1000 // 57 and q["央视频道"] == 45 * (1000 - q["其他频道"]) // 52
    # Without other channels the other quota still counts at its floor, the remainder goes to the first.
    only = spark.createDataFrame([("卫视频道", "x")], "category string, norm_name string")
    assert [r.quota for r in ranking.proportional_quota(only, 100).collect()] == [100]


def test_enforced_quota_sums_to_limit(channels):
    quota = ranking.proportional_quota(channels, 60)
    kept = ranking.enforce_quota(channels, quota, [-F.col("quality"), F.col("seq")])
    want = {r.category: r.quota for r in quota.collect()}
    got = {r.category: r["count"] for r in kept.groupBy("category").count().collect()}
    assert got == {c: min(n, {"央视频道": 80, "其他频道": 40}[c]) for c, n in want.items()}


def test_fallback_fill(spark):
    rows = [("c", "a", 1, 50), ("c", "a", 2, 3), ("c", "a", 3, 2), ("c", "b", 4, 1), ("c", "d", 5, 60), ("c", "d", 6, 70), ("c", "d", 7, 80), ("c", "d", 8, 1)]
    df = spark.createDataFrame(rows, "category string, name string, seq long, quality long")
    got = {(r.name, r.seq, r.is_fallback) for r in ranking.fallback_fill(df, 2, 5).collect()}
    assert got == {("a", 1, False), ("a", 2, True), ("d", 7, False), ("d", 6, False)}


def test_cap_per_display_name(spark):
    rows = [(1, "g", i, "n", f"u{i}") for i in range(2, 8)] + [(1, "g", 9, "m", "x"), (10, "g", 11, "n", "y"), (10, "g", 12, "", "z"), (10, "g", 13, "q", "")]
    df = spark.createDataFrame(rows, "group_run long, category string, line_no long, name string, url string")
    got = ranking.cap_per_display_name(df, 3).orderBy("group_run", "name_at", "line_no").collect()
    assert [r.url for r in got] == ["u2", "u3", "u4", "x", "y"]


def test_category_counts_and_summary(spark, channels):
    counts = {r.category: r.n for r in runs.category_counts(channels).collect()}
    assert counts["央视频道"] == 80 and counts["音乐频道"] == 0 and len(counts) == 10
    empty = channels.limit(0).withColumn("alive", F.lit(True))
    row = runs.run_summary(empty).first()
    assert (row.total, row.success_rate) == (0, 0.0)


def test_run_history(spark):
    df = spark.createDataFrame([(i, 100 + i * i, 50) for i in range(15)], "run_no long, total long, valid long")
    got = runs.run_delta(df, "run_no", ["total", "valid"], block=4).orderBy("run_no").collect()
    assert [r.d_total for r in got] == [None] + [2 * i - 1 for i in range(1, 15)]
    assert [r.run_no for r in runs.keep_last_runs(df, [F.desc("run_no")], 10).collect()] == list(range(14, 4, -1))
