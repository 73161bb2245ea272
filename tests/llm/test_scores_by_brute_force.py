"""Scores of the toxicity and quality operators recomputed by plain loops."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import quality, toxicity
from linkloom.llm.common import table

SF = "/root/testdata/sf0.01"
WORDS = st.text(alphabet="abl", min_size=1, max_size=4)
TEXTS = st.lists(st.text(alphabet="abABlà1@а.-", min_size=1, max_size=6), max_size=30).map(" ".join)


def density(lexicon, text):
    """Every term and exception looked for at every place."""
    flat, total = toxicity.fold(text), 0.0
    covered = [(i + 1, i + len(e)) for e in lexicon.exceptions for i in range(len(flat)) if flat.startswith(f" {e} ", i)]
    for term, weight in lexicon.terms.items():
        for i in range(len(flat)):
            if flat.startswith(" " + term, i) and not any(a <= i + 1 and i + len(term) <= b for a, b in covered):
                total += weight
    return 100 * total / (len(flat.split()) + lexicon.smoothing)


@given(st.dictionaries(WORDS, st.floats(0.1, 9), max_size=6), st.lists(st.lists(WORDS, min_size=1, max_size=3).map(" ".join), max_size=4), TEXTS)
@settings(max_examples=400, deadline=None)
def test_matches_and_exceptions(terms, exceptions, text):
    lexicon = toxicity.Lexicon(terms, tuple(exceptions))
    assert lexicon.density(text) == pytest.approx(density(lexicon, text))


def test_counts_of_terms(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["idle", "Idler", "b0at", "boats", "x"]) for _ in range(rng.randrange(9))), k % 2) for k in range(60)]
    want = {}
    for text, y in rows:
        own = Counter()
        for w in toxicity.fold(text).split():
            own[w + " "] += 1
            for n in range(3, min(len(w), 5) + 1):
                own[w[:n]] += 1
        for t, n in own.items():
            c = want.setdefault(t, [0] * 6)
            for at, v in zip((0, 2, 4), (1, n, n * n)):
                c[at + 1 - y] += v
    got = toxicity.term_counts(spark.createDataFrame(rows, "text string, y int").repartition(4), 3, 5)
    assert {r["term"]: [r[c] for c in toxicity.COUNTED] for r in got.collect()} == want


def test_scores_of_all_documents(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(
        spark.createDataFrame([(-1, None), (-2, ""), (None, "no id")], "doc_id bigint, text string")
    )
    lexicon = toxicity.train(docs, table(spark, SF, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = toxicity.score(docs, lexicon).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == sorted(i or 0 for i in texts)
    chosen = [r for r in out if r["doc_id"] is None or r["doc_id"] < 0 or r["predicted"] == 1] + out[:100]
    for r in chosen:
        x = lexicon.slope * math.log1p(density(lexicon, texts[r["doc_id"]])) + lexicon.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-x)))
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in out)


def kind(byte):
    if byte in b" \t\n\x0b\x0c\r":
        return "blank"
    if 65 <= byte <= 90:
        return "upper"
    if 97 <= byte <= 122 or byte >= 128:
        return "lower"
    return "digit" if 48 <= byte <= 57 else "symbol"


def features(text):
    raw, words = (text or "").encode(), (text or "").split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    kinds = Counter(map(kind, raw))
    symbol_ends = sum(
        kind(b) == "symbol" and chr(b) not in ".,;:?)'\"" and (k + 1 == len(raw) or kind(raw[k + 1]) == "blank") for k, b in enumerate(raw)
    )
    lines = text.split("\n")
    return [
        sum(a == b for a, b in zip(words, words[1:])) / len(words), len(set(words)) / len(words),
        kinds["upper"] / max(kinds["upper"] + kinds["lower"], 1), kinds["symbol"] / len(raw),
        sum(chr(b) in "!#$%&*+<=>@^_`{|}~\\" for b in raw) / len(words), symbol_ends / len(words),
        kinds["digit"] / len(raw), len(raw) / len(words), len(set(lines)) / len(lines), math.log(1 + len(words)),
    ]


@given(st.text(alphabet="aAé1!.\\ \t\n\x0b", max_size=60))
@settings(max_examples=300, deadline=None)
def test_features(text):
    assert quality.features(text) == pytest.approx(features(text))


def test_quality_scores_of_all_documents(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: r["quality"] for r in labels.filter("quality is not null").collect()}
    learned = {}
    for i, y in sorted(label.items()):
        if zlib.crc32(str(i).encode()) % 5 and texts.get(i) is not None:
            learned.setdefault(texts[i], set()).add(y)
    assert all(len(v) == 1 for v in learned.values())
    x, y = np.array([features(t) for t in learned]), np.array([min(v) for v in learned.values()])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0), atol=1e-6)
    z, w = (x - x.mean(0)) / np.array(model.scale), np.array(model.weights)
    s = np.sort(z @ w)
    bad = int((y == 0).sum())
    assert model.threshold == pytest.approx((s[bad - 1] + s[bad]) / 2)
    for r in quality.score(docs, model).collect():
        strength = sum(a * (v - m) / d for a, v, m, d in zip(model.weights, features(texts[r["doc_id"]]), model.mean, model.scale))
        want = 1 / (1 + math.exp(-min(max(strength - model.threshold + math.log(0.3 / 0.7), -700), 700)))
        assert r["score"] == pytest.approx(want, rel=1e-6, abs=1e-12)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_preferences_order_good_above_bad(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).join(labels.filter(F.col("quality").isNotNull()), "doc_id").select("score", "quality").collect()
    good, bad = [r["score"] for r in out if r["quality"] == 1], [r["score"] for r in out if r["quality"] == 0]
    wins = np.searchsorted(np.sort(bad), good).sum() / (len(good) * len(bad))
    assert wins > 0.97


def test_quality_learns_from_every_labelled_document(spark):
    """More labels than the 20,000 a fit saw before: means, pairs, weights and threshold are those of all of them."""
    rows = spark.range(26_000).selectExpr("id AS doc_id", "concat('w', id, repeat(' a!', int(id % 7)), if(id % 3 = 0, ' ##', ' fine words')) AS text")
    labels = rows.selectExpr("doc_id", "int(doc_id % 3 <> 0) AS quality")
    model = quality.train(rows, labels)
    got = [(r["h"], r["doc_id"], r["text"]) for r in rows.select(F.xxhash64("text").alias("h"), "doc_id", "text").collect()]
    kept = sorted((h, i, t) for h, i, t in got if zlib.crc32(str(i).encode()) % 5)
    assert len(kept) > 20_000
    x, y = np.array([quality.features(t) for _, _, t in kept]), np.array([int(i % 3 != 0) for _, i, _ in kept])
    assert np.allclose(model.mean, x.mean(0), rtol=1e-12) and np.allclose(model.scale, x.std(0), atol=1e-8)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    good, bad = z[y == 1], z[y == 0]
    pairs = [(good[(i + 7919 * r) % len(good)], bad[(i + 3 * 7919 * r) % len(bad)]) for r in range(4) for i in range(len(good))]
    w = quality.fit_pairs(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert np.allclose(model.weights, w, rtol=1e-6, atol=1e-6)
    s = np.sort(z @ w)
    assert model.threshold == pytest.approx((s[len(bad) - 1] + s[len(bad)]) / 2, abs=1e-5)
