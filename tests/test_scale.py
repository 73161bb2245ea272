"""Blocked windows and distributed ranks against plain Python, with blocks much smaller than the data."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom import scale


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    # Key "a" holds most rows; positions have gaps.
    at = sorted(rnd.sample(range(400), 120))
    return [(rnd.choice("aaab"), i, rnd.choice([None, 1, 2, 3])) for i in at]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, o bigint, v int").repartition(5)


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_lag_fill_and_sums(df, rows, block):
    out = scale.lag_in_order(df, "o", F.col("v"), "before", ["k"], block=block)
    out = scale.fill_in_order(out, "o", F.col("v"), "filled", ["k"], block=block)
    out = scale.running_sums(out, "o", {"s": F.coalesce("v", F.lit(0))}, ["k"], block=block)
    out = scale.rank_in_order(out, "o", "n", ["k"], block=block)
    got = {(r.k, r.o): (r.before, r.filled, r.s, r.n) for r in out.collect()}
    want, state = {}, {}
    for k, o, v in rows:
        before, filled, s, n = state.get(k, (None, None, 0, 0))
        filled = v if v is not None else filled
        want[k, o] = (before, filled, s + (v or 0), n + 1)
        state[k] = (v, filled, s + (v or 0), n + 1)
    assert got == want


def test_without_keys(df, rows):
    out = scale.lag_in_order(df, "o", F.col("k"), "before", block=16)
    got = {r.o: r.before for r in out.collect()}
    order = [r[1] for r in rows]
    want = {o: (None if i == 0 else rows[i - 1][0]) for i, o in enumerate(order)}
    assert got == want


def test_rank_by_is_dense_and_total(df, rows):
    got = scale.rank_by(df, [F.col("k").desc(), F.asc("o")], "pos").collect()
    want = sorted(rows, key=lambda r: (-ord(r[0]), r[1]))
    assert [(r.k, r.o) for r in sorted(got, key=lambda r: r.pos)] == [(r[0], r[1]) for r in want]
    assert sorted(r.pos for r in got) == list(range(1, len(rows) + 1))


def test_first_rows(df, rows):
    got = scale.first_rows(df, [-F.col("o")], 5, "pos").orderBy("pos").collect()
    assert [r.o for r in got] == sorted((r[1] for r in rows), reverse=True)[:5]
    assert [r.pos for r in got] == [1, 2, 3, 4, 5]


def test_top_per_key_limits_before_the_shuffle(df):
    plan = scale.top_per_key(df, ["k"], [F.asc("o")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hot_key_is_split(spark):
    """One key with all rows is spread over several window groups."""
    hot = spark.range(1000).select(F.lit("x").alias("k"), F.col("id").alias("o"))
    out = scale.running_sums(hot, "o", {"n": F.lit(1)}, ["k"], block=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_blk" in plan
    assert out.agg(F.max("n")).first()[0] == 1000


def test_large_limits_are_cut_in_salted_parts(spark):
    hot = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    out = scale.top_per_key(hot, ["k"], [F.desc("o")], 1500, "rn")
    assert {(r.k, r.n, r.low) for r in out.groupBy("k").agg(F.count("*").alias("n"), F.min("o").alias("low")).collect()} == {(0, 1500, 2000), (1, 1500, 2001)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1, 7, 1000, 5000])
def test_first_rows_needs_no_sort_of_the_table(spark, limit):
    df = spark.range(0, 3000, 1, 8).select(((F.col("id") * 7919) % 3001).alias("o"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"))
    out = scale.first_rows(df, [F.col("k"), -F.col("o")], limit, "pos")
    got = [tuple(r) for r in out.select("pos", "k", "o").orderBy("pos").collect()]
    rows = sorted(((r.k is not None, r.k or 0, -r.o, r.k, r.o) for r in df.collect()))[:limit]
    assert got == [(i + 1, k, o) for i, (_, _, _, k, o) in enumerate(rows)]
    if limit < 3000:  # else Spark knows that nothing is cut
        assert "rangepartitioning" not in _plan(out) and "TakeOrderedAndProject" in _plan(out)


def test_first_rows_drops_losers_before_they_move(spark):
    df = spark.range(0, 200_000, 1, 8).select(((F.col("id") * 7919) % 200_003).alias("o"))
    assert 50 <= scale._near(df, [F.col("o")], 50).count() < 50 * 16 * 2
    assert [r.pos for r in scale.first_rows(df, [F.col("o")], 50, "pos").orderBy("o").collect()] == list(range(1, 51))


def test_first_rows_beyond_what_one_task_takes(spark, monkeypatch):
    monkeypatch.setattr(scale, "_TOGETHER", 10)
    df = spark.range(500).select((F.lit(500) - F.col("id")).alias("o"))
    assert [(r.pos, r.o) for r in scale.first_rows(df, [F.col("o")], 40, "pos").orderBy("pos").collect()] == [(i, i) for i in range(1, 41)]


@pytest.mark.parametrize("early", [1000, 1])
def test_first_per_key(spark, monkeypatch, early):
    monkeypatch.setattr(scale, "_EARLY", early)
    # One key holds a third of the rows, one is NULL, one has no quota, one has fewer rows than its quota.
    df = spark.range(0, 3000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).when(F.col("id") < 9, "few").when(F.col("id") % 2 == 0, "none").otherwise("k").alias("k"),
        ((F.col("id") * 7919) % 3001).alias("o"),
    )
    quotas = spark.createDataFrame([("hot", 50), (None, 3), ("few", 100), ("k", 0)], "k string, q long")
    got = sorted((str(r.k), r.n, r.o) for r in scale.first_per_key(df, ["k"], [F.col("o")], quotas, "q", "n").collect())
    by = {}
    for r in df.collect():
        by.setdefault(r.k, []).append(r.o)
    limits = {"hot": 50, None: 3, "few": 100, "k": 0}
    want = sorted((str(k), i + 1, o) for k, q in limits.items() for i, o in enumerate(sorted(by[k])[:q]))
    assert got == want
    empty = quotas.filter("false")
    assert scale.first_per_key(df, ["k"], [F.col("o")], empty, "q", "n").count() == 0


@pytest.mark.parametrize("block", [10_000, 100])
def test_rank_within_hot_and_other_keys(spark, block):
    df = spark.range(0, 2000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 90).cast("string")).alias("k"),
        ((F.col("id") * 7919) % 2003).alias("o"),
    )
    got = sorted((str(r.k), r.n, r.o) for r in scale.rank_within(df, ["k"], [F.desc("o")], "n", block).collect())
    by = {}
    for r in df.collect():
        by.setdefault(r.k, []).append(r.o)
    assert got == sorted((str(k), i + 1, o) for k, v in by.items() for i, o in enumerate(sorted(v, reverse=True)))
    assert scale.rank_within(df.filter("false"), ["k"], [F.desc("o")], "n", block).count() == 0
