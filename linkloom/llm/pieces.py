"""SentencePiece encoding and decoding, for byte-fallback merge models without text normalisation.

A merge model starts from single characters and joins the adjacent pair whose union has the best score, leftmost
first, until no union is a piece. The result is found here without merging whole texts: walk through the text by
longest matches (Aho-Corasick), accept a piece if re-merging it with the piece before gives these two pieces back,
else try the next shorter one, else step back; a bit field marks the positions that cannot be reached by a valid
sequence, so no position fails twice.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from dataclasses import dataclass
from itertools import islice

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import map_texts

SPACE = "\u2581"
REPLACEMENT = "\ufffd"


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model file."""

    pieces: tuple[str, ...]  # "" where an id is no ordinary piece
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    begin: int
    end: int


def load(path: str) -> Vocabulary:
    """Read a model file on the driver; tasks get the vocabulary, not the path."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, trainer = model.normalizer_spec, model.trainer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
    if trainer.model_type != 2 or not trainer.byte_fallback or not plain or norm.remove_extra_whitespaces:
        raise ValueError("a merge model with byte fallback and without normalisation is needed")
    kinds = {p.type for p in model.pieces}
    if kinds - {1, 2, 3, 6}:
        raise ValueError("user-defined and unused pieces are not supported")
    byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
    return Vocabulary(
        tuple(p.piece if p.type == 1 else "" for p in model.pieces),
        tuple(p.score for p in model.pieces),
        tuple(byte_ids[b] for b in range(256)),
        trainer.unk_id, trainer.bos_id, trainer.eos_id,
    )


class Coder:
    """Encodes and decodes with one vocabulary; its caches are bounded."""

    CACHED = 180_000
    LONGEST_CACHED = 64

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            self.matcher.add_word(p, (len(p), self.ids[p]))
        self.matcher.make_automaton()
        # No piece continues over a space or a line break in these models: texts fall into parts encoded alone.
        splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.parts = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if splits else r"(?s:.+)")
        self.fits: dict[int, bool] = {}
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        table = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            table[i] = bytes([b])
        table[vocabulary.unknown] = " \u2047 ".encode()
        self.bytes_of = table

    def merge(self, text: str) -> list[str]:
        """Merge a short text outright."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.v.scores[k] > best):
                    best, at = self.v.scores[k], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, before: int, piece: int) -> bool:
        """Whether re-merging two adjacent pieces (without one before: a negative number) gives them back."""
        key = before << 20 | piece if before >= 0 else piece
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.CACHED:
                self.fits.clear()
            parts = [self.v.pieces[before], self.v.pieces[piece]] if before >= 0 else [self.v.pieces[piece]]
            known = self.fits[key] = self.merge("".join(parts)) == parts
        return known

    def split(self, text: str) -> list[int]:
        """Ids of a part of a text (its spaces written as pieces write them); an unknown character c stands as -1 - ord(c)."""
        n = len(text)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # at each start, (end, id) by length
        for end, (size, k) in self.matcher.iter(text):
            found[end + 1 - size].append((end + 1, k))
        fits, fit = self.fits.get, self.fit
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        tried: list[int] = []  # for each accepted piece, its place among the matches at its start
        starts: list[int] = []
        pos, before = 0, -1
        at = len(found[0]) - 1
        while pos < n:
            here = found[pos]
            if not here:
                here.append((pos + 1, -1 - ord(text[pos])))
                at = 0
            while at >= 0:
                end, k = here[at]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if k < 0:  # an unknown character merges with nothing
                        break
                    known = fits(before << 20 | k if before >= 0 else k)
                    if known if known is not None else fit(before, k):
                        break
                at -= 1
            if at >= 0:
                out.append(k)
                tried.append(at)
                starts.append(pos)
                pos, before = end, k
                at = len(found[pos]) - 1
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                out.pop()
                pos, at = starts.pop(), tried.pop() - 1
                before = out[-1] if out else -1
        return out

    def pack(self, part: str) -> bytes:
        if len(part) > self.LONGEST_CACHED:
            return self._packed(part)
        out = self.older.get(part) or self._packed(part)
        if len(self.packed) >= self.CACHED:
            self.older = dict(self.packed)  # two generations: frequent parts survive
            self.packed.clear()
        self.packed[part] = out
        return out

    def _packed(self, part: str) -> bytes:
        ids = self.split(part)
        if min(ids) < 0:
            ids = [i for k in ids for i in ((k,) if k >= 0 else [self.v.byte_ids[b] for b in chr(-1 - k).encode("utf-8", "replace")])]
        return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        """Empty the caches, as a worker may serve other tasks next."""
        self.fits.clear()
        self.packed.clear()
        self.older.clear()

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, begin and end included, as little-endian 32-bit integers. NULL counts as empty."""
        out = [struct.pack("<I", self.v.begin)]
        if text:
            flat = SPACE + text.replace(" ", SPACE)
            get, pack = self.packed.get, self.pack
            if len(flat) < 1 << 20:
                out += [get(p) or pack(p) for p in self.parts.findall(flat)]
            else:  # a very long text, some parts at a time
                found = self.parts.finditer(flat)
                while some := [m.group() for m in islice(found, 100_000)]:
                    out.append(b"".join([get(p) or pack(p) for p in some]))
        out.append(struct.pack("<I", self.v.end))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: pieces joined, byte pieces as UTF-8 (each wrong byte as U+FFFD), one leading space cut."""
        table = self.bytes_of
        raw = b"".join([table[i] for i in memoryview(packed).cast("I")])
        first = next((i for i in memoryview(packed).cast("I") if table[i]), None)
        if first is not None and self.v.pieces[first].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "linkloom-bytewise")


def _bytewise(e: UnicodeError):
    return REPLACEMENT * (e.end - e.start), e.end


def _register() -> None:
    import codecs

    codecs.register_error("linkloom-bytewise", _bytewise)


_register()
_coders: dict[int, Coder] = {}


def coder(vocabulary: Vocabulary) -> Coder:
    """One coder per Python worker and vocabulary."""
    key = hash((vocabulary.pieces, vocabulary.scores))
    if key not in _coders:
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids, n_tokens) per row of ``docs``: ids packed as little-endian 32-bit integers.

    NULL and empty texts have the begin and end ids alone. Repeated rows stay; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # some 32,000 pieces

    def work(batches):
        c = coder(shared.value)
        for b in batches:
            packed = [c.encode(t) for t in b["text"]]
            yield {"id": b["id"], "ids": packed, "n_tokens": [len(p) // 4 for p in packed]}
        c.forget()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, f"id {kind}, ids binary, n_tokens bigint", work).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of packed ids. NULL ids give NULL."""
    import pandas as pd

    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(ids):
        c = coder(shared.value)
        return pd.Series([None if x is None else c.decode(x) for x in ids], dtype=object)

    return encoded.withColumn(into, text(ids_col))


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded) in one pass over the texts; else as ``encode`` and ``decode``."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        c = coder(shared.value)
        for b in batches:
            packed = [c.encode(t) for t in b["text"]]
            yield {
                "id": b["id"], "ids": packed, "n_tokens": [len(p) // 4 for p in packed],
                "decoded": [c.decode(p) for p in packed],
            }
        c.forget()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, f"id {kind}, ids binary, n_tokens bigint, decoded string", work).withColumnRenamed("id", id_col)
