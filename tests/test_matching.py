"""Table forms of keyword and address rules against plain Python."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import matching


def test_contains_join_by_brute_force(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abc台é🙂") for _ in range(rnd.randrange(1, 7))) for _ in range(60)] + ["", "a", "zzzz", "abcabcabc"]
    texts = ["".join(rnd.choice("abc台é🙂") for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 40, 400)] + ["x" * 50, None, "abc", "abc"]
    table = spark.createDataFrame([(w, i, f"c{i}") for i, w in enumerate(words)], "word string, place int, cat string")
    df = spark.createDataFrame([(t,) for t in texts], "name string")
    got = {r["name"]: r["cat"] for r in matching.contains_join(df, "name", table, "word", "place", ["cat"]).collect()}
    want = {t: next(f"c{i}" for i, w in enumerate(words) if w and w in t) for t in texts if t and any(w and w in t for w in words)}
    assert got == want


def test_index_rows_grow_with_the_text_alone(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(5000))
    grams = spark.createDataFrame([(text,)], "t string").select(F.size(matching._grams(F.col("t"), [1, 2, 3]))).first()[0]
    assert grams <= 3 * len(text)
    plan = _plan(matching.contains_join(
        spark.createDataFrame([(text,)], "t string"), "t", spark.createDataFrame([("q" * 400, 1)], "w string, r int"), "w", "r", ["w"]
    ))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _urls(hosts):
    return [f"http://[{h}]:80/x" if ":" in h else f"http://{h}/x" for h in hosts]


@pytest.mark.parametrize("ranges", [64, 3])
def test_in_blocks_by_ipaddress(spark, monkeypatch, ranges):
    monkeypatch.setattr(matching, "_RANGES", ranges)
    rnd = random.Random(8)
    blocks = [f"{rnd.randrange(256)}.{rnd.randrange(256)}.0.0/{rnd.randrange(4, 20)}" for _ in range(15)] + ["0.0.0.0/32", "255.255.255.255", "9.9.9.9/32", "9.9.9.9/32"]
    blocks += [f"2001:db8:{rnd.randrange(16):x}::/{rnd.randrange(40, 60)}" for _ in range(10)] + ["::1", "fe80::/10", "::ffff:0:0/97", "ff00::/8"]
    nets = [ipaddress.ip_network(b, strict=False) for b in blocks]
    hosts = [f"{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(4)}.1" for _ in range(300)] + ["9.9.9.9", "9.9.9.8", "0.0.0.0", "0.0.0.1", "255.255.255.255"]
    hosts += [f"2001:db8:{rnd.randrange(18):x}:{rnd.randrange(65536):x}::{rnd.randrange(9)}" for _ in range(200)] + ["::1", "::2", "fe80::1", "fec0::1", "ff02::5", "::ffff:1.2.3.4"]
    names = ["example.com", "1.2.3", "1.2.3.4.5", "999.1.1.1"]
    df = spark.createDataFrame([(u,) for u in _urls(hosts + names)] + [(None,)], "url string")
    table = spark.createDataFrame([(b,) for b in [*blocks, "x", "1.2.3.4/33", "1.2.3.4/-1", None]], "cidr string")
    got = {r["url"]: r["in_block"] for r in matching.in_blocks(df, table).collect()}

    def inside(h):
        a = ipaddress.ip_address(h)
        return any(n.version == a.version and a in n for n in nets)

    assert got == {u: inside(h) for u, h in zip(_urls(hosts), hosts)} | {u: False for u in _urls(names)} | {None: False}


def test_no_blocks_and_no_addresses(spark):
    df = spark.createDataFrame([("http://1.2.3.4/x",), ("http://h/x",)], "url string")
    none = spark.createDataFrame([], "cidr string")
    assert [r["in_block"] for r in matching.in_blocks(df, none).collect()] == [False, False]
    assert matching.in_blocks(df.filter("false"), spark.createDataFrame([("10.0.0.0/8",)], "cidr string")).count() == 0
    names = spark.createDataFrame([("http://h/x",)], "url string")
    assert [r["in_block"] for r in matching.in_blocks(names, spark.createDataFrame([("0.0.0.0/0",), ("::/0",)], "cidr string")).collect()] == [False]
    whole = spark.createDataFrame([("0.0.0.0/0",)], "cidr string")
    assert sorted(map(tuple, matching.in_blocks(df, whole).collect())) == [("http://1.2.3.4/x", True), ("http://h/x", False)]


def test_long_keywords_by_brute_force(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abé🙂") for _ in range(n)) for n in (15, 16, 17, 33, 70, 300, 900, 2000)] * 2 + ["ab" * 400, "", None]
    words = [t[p:p + n] for t in texts if t for n in (1, 2, 3, 4, 15, 16, 17, 31, 32, 33, 64, 130) for p in (0, len(t) // 3, len(t) - n) if 0 <= p <= len(t) - n]
    words += [w[:-1] + "a" for w in words if len(w) > 14] + ["ab" * 40 + "b"]
    rnd.shuffle(words)
    table = spark.createDataFrame([(w, i // 2, f"c{i}") for i, w in enumerate(words) if len(w) > rnd.randrange(40)], "word string, place int, cat string")
    rules = [(r["word"], r["place"], r["cat"]) for r in table.collect()]
    df = spark.createDataFrame([(t,) for t in texts], "name string")
    got = {r["name"]: r["cat"] for r in matching.contains_join(df, "name", table, "word", "place", ["cat"]).collect()}
    best = {t: min((p for w, p, _ in rules if w in t), default=None) for t in texts if t is not None}
    assert got.keys() == {t for t, p in best.items() if p is not None}
    assert all(any(w in t and p == best[t] and c == cat for w, p, c in rules) for t, cat in got.items())


def test_texts_are_not_copied_per_keyword(spark):
    """A text that holds every keyword of the table goes to no shuffle; before, it went there once for each of them."""
    words = [chr(0x4E00 + i) for i in range(200)]
    table = spark.createDataFrame([(w, i, w) for i, w in enumerate(words)], "keyword string, cat_rank int, category string")
    df = spark.createDataFrame([(i, f"{i}" + "".join(words) * 20) for i in range(50)], "seq int, name string")
    out = matching.classify_by_table(df, table, "none").select("seq", "category")
    assert {r["category"] for r in out.collect()} == {words[0]}
    plan = out._jdf.queryExecution().optimizedPlan()
    joins = [line for line in plan.toString().splitlines() if "Join" in line]
    assert joins and not any("contains" in line.lower() for line in joins)
    sizes = []

    def walk(node):
        if "Exchange" in node.nodeName():
            sizes.append(node.output().toString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(out._jdf.queryExecution().sparkPlan())
    walk(out._jdf.queryExecution().executedPlan())
    assert not any("name" in s or "_text" in s for s in sizes)
