import base64
import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from linkloom.llm import align
from linkloom.llm.common import table

SCHEMA = "doc_id bigint, text string, row string, id string, pair string, n string, links string"


@pytest.fixture(scope="module")
def models():
    return align.ByteLevel.load(public_tokenizers.path("byte_bpe_50k.json")), align.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def tokens():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def b_bytes(i):
        piece = p.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    def cut(text):
        raw = (" " + text).encode()
        a = [(i, ranks[i]) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in p.encode(text)]
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    return cut


def brute(rows):
    cut, per, pairs = tokens(), [], Counter()
    for doc, text in rows:
        a, b = cut(text) if text else ([], [])
        ends = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                at += len(x)
                out.append((at, i))
            ends.append(out)
        borders = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        parts = [([], []) for _ in borders]
        for side in (0, 1):
            for at, i in ends[side]:
                parts[bisect.bisect_left(borders, at)][side].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in parts]
        at_end = dict(ends[1])
        links = [(i, at_end[at]) for at, i in ends[0] if at in at_end]
        pairs.update(links)
        per.append((doc, len(a), len(b), groups, links))
    most = Counter()
    for (_, j), n in pairs.items():
        most[j] = max(most[j], n)
    return sorted((
        doc, na, nb, len(groups), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links),
        hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "",
    ) for doc, na, nb, groups, links in per)


def texts():
    rnd = random.Random(3)
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x370, 0x530), (0x4E00, 0x4F00), (0x1F300, 0x1F700), (0, 0x20)]
    out = ["plain words of a text", "<|endoftext|> and <s> </s> <unk>", " leading", "trailing  ", "\n\n", "a▁b", "naïve 日本語 🙂 test", "x" * 3000, "The the THE"]
    for _ in range(60):
        out.append("".join(chr(rnd.randrange(*rnd.choice(blocks))) for _ in range(rnd.randrange(1, 30))))
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_against_brute_force(spark, models, frequent):
    data = [(i, t) for i, t in enumerate(texts())] + [(500, None), (501, ""), (502, "plain words of a text"), (502, "plain words of a text")]
    docs = spark.createDataFrame([(*r, "1", "2", "3", "4", "5") for r in data], SCHEMA)
    got = align.linked(docs, *models, frequent=frequent)
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_whole_table_against_brute_force(spark, models):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, align.linked(docs, *models).collect())) == brute(data)


def test_empty_table_and_null_ids(spark, models):
    docs = spark.createDataFrame([(None, "one text", "", "", "", "", "")], SCHEMA)
    assert align.linked(docs.limit(0), *models).count() == 0
    assert align.linked(docs, *models).first()["n_a"] == 2


def test_long_white_space(models):
    aligner = align.Aligner(*models)
    out = aligner.align([" " * 300_000 + "end", "word " * 60_000])
    assert all(n > 0 for n in out["n_a"]) and out["groups"][1].count(";") + 1 == out["n_groups"][1]


def test_intervals_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        cuts = [np.unique(np.r_[0, rng.integers(1, 40, rng.integers(0, 12)), 40]) for _ in range(2)]
        (sa, ea), (sb, eb) = [(c[:-1], c[1:]) for c in cuts]
        i, j = align.overlaps(sa, ea, sb, eb)
        want = {(x, y) for x in range(len(sa)) for y in range(len(sb)) if sa[x] < eb[y] and sb[y] < ea[x]}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
        group = align.groups(np.r_[sa, sb], np.r_[ea, eb])
        borders = np.intersect1d(ea, eb)
        assert (group == np.searchsorted(borders, np.r_[ea, eb])).all()
