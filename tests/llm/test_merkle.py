import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, block string, pos string, path string, id string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*map(field, (r[0], r[3], r[2], r[4], text)))


def climb(nodes, at, node, fan):
    """Root over ``node`` in place of the one at ``at``, and the siblings on the way."""
    nodes, sides = list(nodes), []
    nodes[at] = node
    while len(nodes) > 1:
        lo = at - at % fan
        sides += nodes[lo:at] + nodes[at + 1:lo + fan]
        nodes, at = [h(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)], at // fan
    return nodes[0], sides


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, fan):
    by = {}
    for r in rows:
        by.setdefault("" if r[3] is None else "+" + r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=str.encode)
    for n in names:
        by[n].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in by[n]], 0, by[n][0][2], fan)[0] for n in names]
    root = climb(subroots, 0, subroots[0], fan)[0]
    out = []
    for k, n in enumerate(names):
        leaves = [x[2] for x in by[n]]
        for i, (_, _, own, r) in enumerate(by[n]):
            _, inside = climb(leaves, i, own, fan)
            _, above = climb(subroots, k, subroots[k], fan)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            new = leaf(r, lowered(r[1])) if tampered else own
            # Siblings are those of the untampered tree; only the own path changes.
            folded = climb(subroots, k, climb(leaves, i, new, fan)[0], fan)[0]
            out.append((r[0], own, subroots[k], root, h(*inside, *above), folded, folded == root))
    return sorted(out, key=str)


def rows():
    texts = ["Hello World", "no capitals", None, "", "Ärger ÄÖ", "X" * 200_000]
    out = [(i, texts[i % 6], "en" if i % 3 else None, "hot", i * 7 if i % 4 else None) for i in range(700)]
    out += [(1000 + i, f"Text {i}", "de", f"s{i % 40}", i) for i in range(120)]
    out += [(5000, "Alone", "fr", "single", 5), (5001, "Null Source", "fr", None, 1), (5002, "Empty", None, "", None), (-5, "Minus", "x", "é", 0)]
    out += [(7, "Repeated", "en", "hot", 1), (7, "Repeated", "en", "hot", 1), (None, "Null Id", "en", "hot", 2), (None, None, None, None, None)]
    return out


CLASH = ("g", "1", "2", "3", "4")


@pytest.mark.parametrize("fan,levels", [(16, 3), (16, 1), (3, 2), (2, 1)])
def test_against_brute_force(spark, fan, levels):
    data = rows()
    docs = spark.createDataFrame([(*r, *CLASH) for r in data], SCHEMA)
    got = merkle.manifest(docs, fan=fan, levels=levels).drop("copied").collect()
    assert sorted(map(tuple, got), key=str) == brute(data, fan)
    assert len({r["verified"] for r in got}) == 2


def test_versions_share_all_but_the_path(spark):
    data = [(i, f"Doc {i}", "en", "a", 1) for i in range(100)]
    docs = spark.createDataFrame([(*r, *CLASH) for r in data], SCHEMA)
    out = {r["doc_id"]: r for r in merkle.manifest(docs, tampered=F.col("doc_id") == 37, fan=4, levels=2).collect()}
    assert all(r["copied"] is None and r["verified"] for i, r in out.items() if i != 37)
    copied = out[37]["copied"]
    assert [(c["level"], c["i"]) for c in copied] == [(0, 37), (1, 9), (2, 2)]
    assert copied[0]["hash"] == leaf(data[37], "doc 37") and not out[37]["verified"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(docs).count() == 0


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(3, "A", "en", "s", 1, *CLASH)], SCHEMA)
    r = merkle.manifest(docs).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h("")
