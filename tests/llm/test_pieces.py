import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


CODER = pieces.Coder(pieces.load(PATH))


def ids(text):
    packed = CODER.encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def check(library, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids(text) == want, text
    assert CODER.decode(CODER.encode(text)) == library.decode(want)


TEXTS = [
    "", " ", "  ", "   a", "a   ", "\n", "\n\n a\tb", "\u2581", "a\u2581\u2581b", "<s>x</s><unk><0x0A>", "\x00a", "Ünï çödé",
    "世界和平 にほんご", "🙂🙃 e\u0301", "x" * 300, " " * 50 + "y", "ab" * 200, "word " * 40, "  \n   if x:\n        return 1\n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(library, text):
    check(library, text)


def test_null_is_empty():
    assert ids(None) == ids("") == [1, 2]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    check(sentencepiece.SentencePieceProcessor(model_file=PATH), text)


def test_random_letters(library):
    rng = random.Random(5)
    for alphabet in ("ab ", "thein ", "aeioustrn\n", " \u2581.-", "éèçabc '"):
        for _ in range(400):
            check(library, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))))


def test_whole_long_part(library):
    rng = random.Random(6)
    check(library, "".join(rng.choice("abcdefgh") for _ in range(20_000)))


def test_text_beyond_one_stretch(library):
    check(library, "some words here\n" * 80_000)


def test_decoding_of_wrong_bytes(library):
    for some in ([1, 3 + 0xC3, 3 + 0x28, 2], [3 + 0xE2, 3 + 0x82, 300], [300, 3 + 0xBF], [0, 300], [1], []):
        packed = struct.pack(f"<{len(some)}I", *some)
        assert CODER.decode(packed) == library.decode(some)


def test_frame(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (None, "", None), (3, "long " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    v = pieces.load(PATH)
    out = pieces.encode_decode(docs, v).collect()
    assert len(out) == 5
    for r in out:
        text = {1: "a b", 2: "", None: "", 3: "long " * 5000}[r["doc_id"]]
        assert list(memoryview(bytes(r["ids"])).cast("I")) == library.encode(text, add_bos=True, add_eos=True)
        assert r["decoded"] == text and r["n_tokens"] == len(r["ids"]) // 4
    again = pieces.decode(pieces.encode(docs, v), v).select("doc_id", "decoded").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in [type(again[0])(doc_id=r["doc_id"], decoded=r["decoded"]) for r in out])
    assert pieces.encode_decode(docs.limit(0), v).count() == 0
