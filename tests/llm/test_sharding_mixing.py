import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import mixing, sharding

SCHEMA = "doc_id bigint, text string, source string, shard int, target string"


def corpus(spark, n=3000):
    rng = random.Random(2)
    rows = [(i, "a text that occurs very often", "hot", 1, "x") if i % 3 == 0 else
            (i, " ".join("w%d" % rng.randrange(99) for _ in range(rng.randrange(0, 60))), f"s{i % 7}", None, None) for i in range(n)]
    rows += [(9000, None, None, 1, "x"), (9001, "", None, 1, "x"), (9002, "x" * 40_000, "é", 1, "x"), (9003, "null source here", None, 1, "x"),
             (None, "a null id", "s1", 1, "x"), (4, rows[4][1], "s4", 1, "x"), (4, rows[4][1], "s4", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(6), rows


def test_shards(spark):
    docs, rows = corpus(spark)
    out = sharding.place(docs, 24).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted(
        (i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    sizes, slots = {}, {}
    for r in out:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    total, largest = sum(sizes.values()), 40_008
    assert set(sizes) <= set(range(24))
    assert all(abs(s - total / 24) <= largest for s in sizes.values())
    assert sorted(sizes.values())[12] < total / 24 * 1.05
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.place(docs.repartition(3), 24).collect() if r["doc_id"] != 4}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in out if r["doc_id"] != 4}
    assert sharding.place(docs.limit(0), 24).count() == 0


def test_shards_need_no_python(spark):
    docs, _ = corpus(spark, 50)
    plan = sharding.place(docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_equal_texts_are_neighbours(spark):
    docs, _ = corpus(spark)
    by_text = {}
    for r in sharding.place(docs, 5).collect():
        by_text.setdefault((r["text_crc32"], r["size"]), []).append((r["shard"], r["slot"]))
    for at in by_text.values():
        at.sort()
        for a, b in zip(at, at[1:]):
            assert b == (a[0], a[1] + 1) or (b[0] > a[0] and b[1] == 0)


def test_written_shards(spark, tmp_path):
    docs, rows = corpus(spark, 300)
    once = docs.dropDuplicates(["doc_id"])
    assert once.filter("doc_id is null").count() == 1
    sharding.write_shards(once, sharding.place(once, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == once.count() and set(docs.columns) <= set(back.columns)


def spread(sizes, weights, budget, cap):
    """Water filling by bisection."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < budget else (low, mid)
    return [min(cap * s, low * w) for s, w in zip(sizes, weights)]


def test_mix(spark):
    docs, rows = corpus(spark)
    out = mixing.mix(docs, mixing.five_two_one).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in out) == sorted((i or -1, count(t)) for i, t, *_ in rows)
    names = sorted({s for _, _, s, *_ in rows if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(count(t) for _, t, s, *_ in rows if s == n) for n in names]
    want = spread(sizes, [mixing.five_two_one(i) for i in range(len(names))], 1.5 * sum(sizes), 2)
    for n, size, goal in zip(names, sizes, want):
        own = [r for r in out if r["source"] == n]
        assert {r["source_size"] for r in own} == {size}
        assert all(abs(r["target"] - goal) < 1e-6 * max(goal, 1) for r in own)
        assert abs(sum(r["taken"] for r in own) - goal) <= 60
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    again = mixing.mix(docs.repartition(2), mixing.five_two_one).collect()
    key = lambda rs: sorted((r["doc_id"] or -1, r["taken"]) for r in rs)
    assert key(out) == key(again)
    assert mixing.mix(docs.limit(0), mixing.five_two_one).count() == 0
    repeated = mixing.repeat(docs, mixing.five_two_one)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r["copies"] for r in out)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 6)), min_size=1, max_size=12, unique_by=lambda p: p[0]), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_subset_sums_are_the_nearest_below(items, share):
    lengths, counts = map(np.array, zip(*items))
    total = int((lengths * counts).sum())
    budget = int(share * total)
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    got = int((take * lengths).sum())
    bulk = np.array([int(c) * budget // max(total, 1) if n else 0 for n, c in items])
    reach = {int((bulk * lengths).sum())} if budget < total else {total}
    for n, c, b in zip(lengths, counts, bulk):
        reach = {r + int(n) * k for r in reach for k in range(int(c - b) + 1) if r + int(n) * k <= budget}
    assert got == max(reach)


def test_large_budgets_are_met():
    rng = np.random.default_rng(0)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 10**6, len(lengths))
    for share in (0.1, 0.5, 0.9):
        budget = int(share * int((lengths * counts).sum()))
        assert int((mixing.fit_counts(lengths, counts, budget) * lengths).sum()) == budget
    few = mixing.fit_counts(np.array([10**9, 10**9 + 7]), np.array([5, 5]), 3 * 10**9)
    assert int((few * np.array([10**9, 10**9 + 7])).sum()) <= 3 * 10**9


@pytest.mark.parametrize("seed", range(3))
def test_targets_of_tables_equal_those_of_arrays(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:05d}": [rng.choice([0, 1, 50, rng.randrange(10**6)]) for _ in range(rng.randrange(1, 3))] for k in range(400)}
    sized = spark.createDataFrame([(s, n) for s, v in sizes.items() for n in v] + [(None, 70)], "source string, size bigint").repartition(5)
    weight = lambda i: 1 + (i * i) % 17 / 7
    got = mixing.source_targets(sized, weight, 1.5, 2.0).orderBy("src").collect()
    names = sorted(sizes) + [None]
    totals = [sum(sizes[s]) for s in sorted(sizes)] + [70]
    want = mixing.targets(np.array(totals), np.array([weight(i) for i in range(401)]), 1.5 * sum(totals), 2.0)
    assert [(r["src"], r["source"], r["source_size"]) for r in got] == list(zip(range(401), names, totals))
    assert [r["target"] for r in got] == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_copies_of_shared_ids_and_clashing_columns(spark):
    rows = [(None, "no id " * (k % 5 + 1), f"s{k % 4}", k, "x", 1) for k in range(90)] + [(7, "seven", "s0", k, "y", 2) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _id int, copies string, size int").repartition(3)
    took = mixing.mix(docs, mixing.five_two_one)
    out = mixing.repeat(docs, mixing.five_two_one)
    assert out.columns == docs.columns
    count = lambda text: len(text.split())
    want, got = {}, {}
    for r in took.collect():
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["copies"]
    for r in out.collect():
        key = (r["doc_id"], r["source"], count(r["text"]))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_hot_lengths_are_dealt_by_bucket(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "'four words of text' text", "'hot' source")
    plan = mixing.mix(docs, mixing.five_two_one)._jdf.queryExecution().executedPlan().toString()
    dealt = [re.sub(r"#\w+", "", d) for d in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]
    assert dealt and all("bucket" in d or "_s" in d or "source" in d for d in dealt), dealt


def test_targets_share_the_excess():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 315, 2).tolist() == pytest.approx([20, 196.6666667, 98.3333333])
    assert mixing.targets([0, 0], [1, 1], 0, 2).tolist() == [0, 0]
