import zlib

import numpy as np
import pytest

from linkloom.llm import byteident
from linkloom.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred string, id string"


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    return byteident.fresh(("a", "b", "c"), 5, rng)


def plain(net, raw):
    """The network, position by position."""
    def sig(x):
        return 1 / (1 + np.exp(-x))

    def run(layer, seq):
        h, out = np.zeros(layer.state.shape[1]), []
        for c in seq:
            u = [h @ layer.state[g] for g in range(3)]
            r, z = sig(layer.byte[0, c] + u[0]), sig(layer.byte[1, c] + u[1])
            n = np.tanh(layer.byte[2, c] + r * u[2])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    f, b = run(net.forward, raw), run(net.backward, raw[::-1])[::-1]
    logits = np.array([np.concatenate(p) @ net.out + net.bias for p in zip(f, b)])
    e = np.exp(logits)
    return e / e.sum(1, keepdims=True)


def test_positions_equal_the_plain_network(net):
    windows = [b"hello", b"x", "äöü and more".encode(), bytes(range(100)), b"hello"]
    for w, got in zip(windows, byteident.positions(net, windows)):
        assert np.allclose(got, plain(net, w), atol=1e-5)


def test_documents_pool_all_positions(net):
    text = "".join(chr(97 + i * i % 26) for i in range(1000)) + " é"
    raw = text.encode()
    p = np.concatenate([plain(net, raw[i:i + byteident.WINDOW]) for i in range(0, len(raw), byteident.WINDOW)]).mean(0)
    names, scores = byteident.documents(net, [None, text, "", "12 34 !", text])
    assert names == ["und", net.languages[p.argmax()], "und", "und", net.languages[p.argmax()]]
    assert scores[0] == scores[2] == scores[3] == 0 and abs(scores[1] - p.max()) < 1e-5 and scores[1] == scores[4]


def test_gradients_by_differences(net):
    rng = np.random.default_rng(2)
    x, sizes, y = rng.integers(0, 6, (4, 7)).astype(np.uint8), np.array([7, 3, 1, 5]), np.array([0, 1, 2, 0])
    net = byteident.network(net.languages, [p.astype(np.float64) for p in net.parameters()])
    _, grads = byteident.loss_and_gradients(net, x, sizes, y)
    for k, (p, g) in enumerate(zip(net.parameters(), grads)):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)] + ([(0, 3, 1), (2, 2, 0)] if k in (0, 2) else []):
            values = []
            for e in (1e-2, -1e-2):
                moved = [q.copy() for q in net.parameters()]
                moved[k][at] += e
                values.append(byteident.loss_and_gradients(byteident.network(net.languages, moved), x, sizes, y)[0])
            assert abs((values[0] - values[1]) / 2e-2 - g[at]) < 2e-3


def test_held_out_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = byteident.identified_with_split(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in out if r["held_out"]]
    for lang in ("en", "de", "fr", "es"):
        assert np.mean([r["lang_pred"] == lang for r in held if r["lang"] == lang]) > 0.95, lang


def test_edges(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(80)]
    rows += [(90, None, "en"), (91, "", "de"), (92, "123", "en"), (None, "the cat", "xx"), (93, "die Katze und der Hund " * 50_000, None), (1, "the cat", "en")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = byteident.identified_with_split(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"en", "de", "und"}
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (90, 91, 92)} == {"und"} and by[93]["lang_pred"] == "de" and not by[None]["held_out"]
    assert byteident.identified_with_split(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(100, 1)).replace("", None, ["lang"])
    assert {r["lang_pred"] for r in byteident.identified_with_split(unlabelled).collect()} == {"und"}
