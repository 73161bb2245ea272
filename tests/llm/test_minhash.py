import itertools
import random
import re

import numpy as np
import pytest

from linkloom.llm import minhash


def brute(rows, width, percent):
    """Component of every id by all pairs."""
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        n = min(width, len(words))
        sets.append((i, {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if n else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i in parent}, [(i, len(s)) for i, s in sets]


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):  # a chain of edits: ends may be far apart
            base = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append(" ".join(base).upper() if rng.random() < 0.2 else "  ".join(base))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "É one"), (1006, "é one"), (None, "w1 w2"), (1007, "one\x0btwo")]
    rows += [(1008, "a b " * 50_000), (1009, "a b " * 50_000 + "c"), (5, rows[5][1]), (5, rows[5][1]), (7, "other text of the same id"), (2000, "other text of the same id")]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, width):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, component string, n int").repartition(7)
    out = minhash.near_duplicates(docs, width=width).collect()
    want, sizes = brute(rows, width, 80)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in out) == sorted((i or -1, n) for i, n in sizes)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_links_between_parts_of_a_bucket(spark):
    """Neighbours in a chain link, ends do not, and the smallest document is linked with few."""
    words = [f"v{k}" for k in range(140)]
    rows = [(k, " ".join(words[3 * k:3 * k + 80])) for k in range(20)]
    rows = [(19 - i if i % 2 else i, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, _ = brute(rows, 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, width=2).collect()} == want


def test_one_of_each_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id bigint, text string, kept string, _id bigint")
    out = minhash.keep_first(docs, width=2)
    assert out.columns == docs.columns
    want, _ = brute(rows, 2, 80)
    assert sorted(r["doc_id"] for r in out.filter("doc_id is not null").collect()) == sorted(set(want.values()))
    assert minhash.keep_first(docs.limit(0)).count() == 0
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_posterior_bounds():
    for n in (10, 50, 130):
        m = minhash.least_matches(n, 0.8, 1e-3)
        grid = np.linspace(0, 1, 20001)
        for k, kept in ((m, True), (m - 1, False)):
            if k >= 0:
                density = grid**k * (1 - grid) ** (n - k)
                assert (density[grid >= 0.8].sum() / density.sum() >= 1e-3) == kept


def test_survivors_are_judged_batchwise():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (50, 130), np.uint32)
    b = np.where(rng.random((50, 130)) < np.linspace(0, 1, 50)[:, None], a, a + np.uint32(1))
    alive = set(minhash.survivors(a, b, 0.8, 1e-5))
    for i in range(50):
        same = np.cumsum(a[i] == b[i])
        assert (i in alive) == all(same[e - 1] >= minhash.least_matches(e, 0.8, 1e-5) for e in range(10, 131, 10))
