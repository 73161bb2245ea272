import numpy as np
import pytest

from linkloom.llm import graph, pq, topk

NAN, INF = float("nan"), float("inf")
EDGE = [
    (900, None), (901, []), (902, [0.0] * 8), (903, [NAN] + [0.1] * 7), (904, [INF] + [0.1] * 7), (905, [None] + [0.1] * 7),
    (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e30] * 8), (None, [0.5] * 8),
]


def vectors(n=400, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 10):  # families close to the threshold
        x[i + 1:i + 5] = x[i] + rng.normal(size=(4, dim)) * np.linalg.norm(x[i]) * np.array([0.05, 0.1, 0.17, 0.2])[:, None]
        x[i + 5] = x[i]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score int, id string").repartition(5)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def test_top_k_equals_brute_force(spark):
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors())] + [e for e in EDGE if e[0] != 908] + [(950, [0.25] * 8), (950, [0.25] * 8), (951, [0.25] * 8)]
    from pyspark.sql import functions as F

    got = topk.top_k(frame(spark, rows), (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == 906), 5)
    live = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and usable(v)]
    want, seen = [], set()
    for i, v in live:
        if (i % 50 == 0 or i == 906) and i not in seen:
            seen.add(i)
            scores = sorted((-int(v @ w), j) for j, w in live if j != i and len(w) == len(v))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted(want)
    assert topk.top_k(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_over_blocks_and_ties(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows = [(i, [1.0, 0.5, -0.25, 0.125]) for i in range(200)] + [(i, [float(i % 7), -1.0, 0.5, 2.0]) for i in range(200, 420)]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    live = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    want = []
    for i, v in live:
        if i % 20 == 0:
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted((-int(v @ w), j) for j, w in live if j != i)[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def brute_links(rows, cosine):
    live = [(i, np.array(v, float)) for i, v in rows if usable(v) and any(v)]
    links = {k: set() for k in range(len(live))}
    for a in range(len(live)):
        for b in range(a):
            u, v = live[a][1], live[b][1]
            if len(u) == len(v) and (u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= cosine:
                links[a].add(b)
                links[b].add(a)
    return live, links


@pytest.mark.parametrize("dim", [8, 33])
def test_links_equal_brute_force(spark, dim):
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors(400, dim))] + EDGE
    out = pq.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    live, links = brute_links(rows, 0.9)
    label = list(range(len(live)))
    for _ in range(20):
        label = [min([label[k], *(label[j] for j in links[k])], key=lambda x: (live[x][0] is None, live[x][0] or 0)) for k in range(len(live))]
    want = {live[k][0]: (len(links[k]), live[label[k]][0]) for k in range(len(live))}
    found = sum(r["n_links"] for r in out)
    true = sum(map(len, links.values()))
    assert 0.99 * true <= found <= true
    for r in out:
        n, component = want.get(r["vec_id"], (0, r["vec_id"]))
        assert r["n_links"] <= n
        if r["vec_id"] is not None and r["n_links"] == n:
            assert r["component_id"] == component
            assert r["kept"] == (r["vec_id"] == component)
    assert pq.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["low-dimensional", "clustered"])
def test_recall_over_many_lists(spark, monkeypatch, kind):
    monkeypatch.setattr(pq, "LIST_ROWS", 32)
    rng = np.random.default_rng(7)
    n, dim, inner = 4000, 64, 6
    x = rng.normal(size=(n, inner)) @ rng.normal(size=(inner, dim)) / np.sqrt(inner)
    if kind == "clustered":
        x = rng.normal(size=(80, dim))[rng.integers(0, 80, n)] + 0.4 * x
    x += (0.2 if kind == "low-dimensional" else 0.1) * rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = x @ x.T
    near = np.triu((cosines >= 0.9) & (cosines < 0.92), 1).sum()
    true = (cosines >= 0.9).sum() - n
    out = pq.near_duplicates(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    found = out.groupBy().sum("n_links").first()[0]
    assert n // pq.LIST_ROWS > 100 and near > 1000
    assert 2 * near > 0.01 * true and true - found < 0.005 * 2 * near and found <= true


def test_blocks_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", 32)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = [(i, list(map(float, centre + rng.normal(size=8) * 0.05))) for i in range(200)]
    out = pq.near_duplicates(frame(spark, rows)).collect()
    _, links = brute_links(rows, 0.9)
    assert {r["vec_id"]: r["n_links"] for r in out} == {i: len(links[i]) for i in links}
    assert {r["component_id"] for r in out} == {0}


def test_looked_up_distances_bound_the_true_ones():
    x = vectors(500, 16)
    index = pq.fit(x, 6, 0.9)
    home = index.distances(x).argmin(1)
    codes, error = index.code(x, home)
    for which in range(len(index.centres)):
        at = np.flatnonzero(home == which)
        if len(at):
            table = np.sqrt(index.looked_up(x[:50], which, codes[at]))
            true = np.sqrt(pq._squared(x[:50], x[at]))
            assert (np.abs(table - true) <= error[at][None, :] + 1e-3).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300), (None, 4), (2, 1), (1, 2)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert out == {**{i: 0 for i in range(101)}, **{i: 200 for i in range(200, 260)}}


def test_scores_held_at_once_are_bounded():
    for n_q, n_x, slices in ((2048, 16384, 4), (5, 0, 4), (1, 10**9, 1), (0, 10, 2)):
        parts = topk._groups(n_q, n_x, slices)
        assert [i for p in parts for i in range(*p.indices(n_q))] == list(range(n_q))
        assert all(len(range(*p.indices(n_q))) == 1 or len(range(*p.indices(n_q))) * n_x * slices * 8 <= topk.SCORE_BYTES for p in parts)
