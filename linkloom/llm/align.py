"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes. All tokens of both are sorted by where they start; the running maximum of their ends
tells the groups, which break where a token starts at that maximum. Within groups the overlapping pairs are expanded; pairs
that end together are links, which are counted over the corpus by their two ids.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import map_texts, saved

SPACE = "▁"
#: Frequent id pairs whose counts are broadcast, at most (20 bytes each); the counts of others are joined.
FREQUENT = 1 << 20
#: Longer texts (in characters) are cut by the slower of two equal byte-level encoders, which bears endless white space.
LONG = 50_000
#: Distinct pairs that a task holds before it hands their counts on.
HELD = 1 << 19


def groups(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group of each interval: those that overlap, directly or through others. Groups are numbered by their place."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    out = np.empty(len(start), np.int64)
    out[order] = np.cumsum(np.r_[True, start[order][1:] >= reach[:-1]]) - 1 if len(start) else 0
    return out


def overlaps(sa: np.ndarray, ea: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of intervals that share a byte; each side is sorted and its intervals are disjoint and not empty."""
    low, high = np.searchsorted(eb, sa, "right"), np.searchsorted(sb, ea, "left")
    n = high - low
    i = np.repeat(np.arange(len(sa)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level vocabulary file (JSON of the tokenizers library), as text."""

    model: str

    @staticmethod
    def load(path: str) -> ByteLevel:
        with open(path, encoding="utf-8") as f:
            return ByteLevel(f.read())

    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        letters = _bytes_of_letters()
        spec = json.loads(self.model)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        vocabulary = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        whole = Tokenizer.from_str(self.model)
        whole.encode_special_tokens = True
        # The ids follow the merges, so they are ranks; both libraries give the same ids.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in vocabulary.items()}, special_tokens={})

        def encode(text: str) -> list[int]:
            text = " " + text
            return quick.encode_ordinary(text) if len(text) < LONG else whole.encode(text, add_special_tokens=False).ids

        return encode, [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]


@dataclass(frozen=True)
class Pieces:
    """A SentencePiece model file with byte fallback."""

    model: bytes

    @staticmethod
    def load(path: str) -> Pieces:
        with open(path, "rb") as f:
            return Pieces(f.read())

    def tokenizer(self):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        table = [
            bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(p.get_piece_size())
        ]
        return lambda text: p.encode(text, num_threads=1), table


class _Side:
    """A tokenizer with its tokens' bytes and lengths."""

    def __init__(self, model):
        self.encode, self.bytes = model.tokenizer()
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def cut(self, text: str, raw: bytes) -> list[int] | None:
        """Ids, if their joined bytes are ``raw``."""
        ids = self.encode(text)
        table = self.bytes
        return ids if b"".join([table[i] for i in ids]) == raw else None


class Aligner:
    """Aligns slices of texts; documents lie side by side, so one sort serves a slice."""

    def __init__(self, a, b):
        self.a, self.b = _Side(a), _Side(b)
        self.width = len(self.b.bytes)
        self.kind = np.uint32 if len(self.a.bytes) * self.width < 1 << 32 else np.uint64
        seps = (",", "|", ";", "")
        self.shown = np.array([f"{i}{s}" for side in (self.a, self.b) for i in range(len(side.bytes)) for s in seps], dtype=object)

    def align(self, texts: list[str | None]) -> dict[str, list]:
        n = len(texts)
        ids: tuple[list, list] = ([], [])
        counts = np.zeros((2, n), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            raw = (" " + text).encode("utf-8", "replace")
            one = self.a.cut(text, raw)
            two = self.b.cut(text, raw) if one is not None else None
            if two is not None:
                ids[0].extend(one)
                ids[1].extend(two)
                counts[:, k] = len(one), len(two)
        a, b = np.array(ids[0], np.int64), np.array(ids[1], np.int64)
        ea, eb = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        sa, sb = ea - self.a.sizes[a], eb - self.b.sizes[b]
        group = groups(np.concatenate([sa, sb]), np.concatenate([ea, eb]))
        doc = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
        # Groups in order, and of each the tokens of A, then those of B.
        order = np.argsort(group, kind="stable")
        side = np.repeat([0, 1], [len(a), len(b)])[order]
        g, d = group[order], doc[order]
        sep = np.full(len(order), 3)
        same = g[1:] == g[:-1]
        sep[:-1] = np.where(d[1:] != d[:-1], 3, np.where(~same, 2, np.where(side[1:] != side[:-1], 1, 0)))
        where = np.concatenate([a, b])[order]
        shown = self.shown[4 * (where + side * len(self.a.bytes)) + sep]
        first = np.r_[True, ~same][: len(g)]
        n_groups = np.bincount(d[first], minlength=n)
        token_ends = np.cumsum(counts.sum(0))
        i, j = overlaps(sa, ea, sb, eb)
        together = ea[i] == eb[j]
        keys = (a[i[together]] * self.width + b[j[together]]).astype(self.kind)
        n_links = np.bincount(np.repeat(np.arange(n), counts[0])[i[together]], minlength=n)
        link_ends = np.cumsum(n_links)
        return {
            "n_a": counts[0].tolist(), "n_b": counts[1].tolist(), "n_groups": n_groups.tolist(), "n_links": n_links.tolist(),
            "groups": ["".join(shown[e - c:e].tolist()) for e, c in zip(token_ends, counts.sum(0))],
            "links": [keys[e - c:e].tobytes() for e, c in zip(link_ends, n_links)],
        }


_aligners: dict[str, Aligner] = {}


def _aligner(a, b) -> Aligner:
    """One aligner per Python worker and pair of models."""
    key = hashlib.sha256(repr((a, b)).encode()).hexdigest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a, b)
    return _aligners[key]


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary"


def aligned(docs: DataFrame, a, b, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, links) of every row.

    ``groups`` are written ``a1,a2|b1;a3|b2,b3``, in order. ``links`` packs the linked id pairs in order, each as
    a * (ids of B) + b, little-endian, in 32 bits if all pairs fit, else 64. NULL and empty texts, and texts that a tokenizer
    does not give back byte by byte, have no tokens. Special tokens' strings are plain text. Repeated rows stay; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((a, b))  # two vocabulary files

    def work(batches):
        aligner = _aligner(*shared.value)
        for batch in batches:
            yield {"id": batch["id"], **aligner.align(batch["text"])}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, f"id {kind}, {ALIGNED}", work, most_bytes=1 << 18).withColumnRenamed("id", id_col)


def _tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def pair_counts(links: DataFrame, width: int, kind) -> DataFrame:
    """(pair, n, best) of every linked id pair: how many links hold it, and whether no pair of its B id has more."""

    def work(batches):
        keys, counts, held = [], [], 0
        for b in batches:
            k, n = np.unique(np.frombuffer(b"".join(b["links"]), kind), return_counts=True)
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > 4 * HELD:
                k, n = _tally(keys, counts)
                if len(k) > HELD:
                    yield {"pair": k.astype(np.int64).tolist(), "n": n.tolist()}
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [n], len(k)
        if keys:
            k, n = _tally(keys, counts)
            yield {"pair": k.astype(np.int64).tolist(), "n": n.tolist()}

    counted = saved(map_texts(links.select("links"), "pair bigint, n bigint", work).groupBy("pair").agg(F.sum("n").alias("n")), "align")
    b_id = F.col("pair") % width
    most = counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return saved(counted.join(most, b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align")


def _frequent(counts: DataFrame, most: int) -> int:
    """Least count of the pairs to broadcast, so that they are ``most`` at most; counts are told apart by eighths of their log."""
    step = F.floor(F.log2("n") * 8)
    bins = sorted(((r["s"], r["pairs"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for _, pairs, low in bins:  # at most 512 of them
        total += pairs
        if total > most:
            break
        least = low
    return least


def linked(docs: DataFrame, a, b, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``count_sum`` adds up, over a text's links, how many links of the corpus hold the same id pair; ``n_best`` are the links
    whose count no other pair of the same B id exceeds. Texts without tokens have zeros and an empty ``groups_sha256``. The
    ``frequent`` most common pairs are looked up where the links lie; the others, none of which is common, are joined.
    """
    spark = docs.sparkSession
    width, kind = _shape(a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    rows = saved(
        aligned(docs, a, b, id_col, text_col).select(
            F.col(id_col).alias("id"), "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"
        ).withColumn("row", F.monotonically_increasing_id()), "align",
    )
    counts = pair_counts(rows, width, kind)
    least = _frequent(counts, frequent)
    top = counts.filter(F.col("n") >= least).toArrow()
    at = np.argsort(top["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy()[at], top["n"].to_numpy()[at], top["best"].to_numpy()[at]))

    def look_up(batches):
        pairs, n, best = shared.value
        for batch in batches:
            out = {"row": batch["row"], "count_sum": [], "n_best": [], "rest": []}
            sizes = [len(x) for x in batch["links"]]
            keys = np.frombuffer(b"".join(batch["links"]), kind).astype(np.int64)
            where = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            known = pairs[where] == keys if len(pairs) else np.zeros(len(keys), bool)
            count, is_best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            count[known], is_best[known] = n[where[known]], best[where[known]]
            end = 0
            for size in sizes:
                start, end = end, end + size // np.dtype(kind).itemsize
                out["count_sum"].append(int(count[start:end].sum()))
                out["n_best"].append(int(is_best[start:end].sum()))
                out["rest"].append(keys[start:end][~known[start:end]].tolist())
            yield out

    found = saved(map_texts(rows.select("row", "links"), "row bigint, count_sum bigint, n_best bigint, rest array<bigint>", look_up), "align")
    rare = counts.filter(F.col("n") < least)
    joined = found.select("row", F.explode("rest").alias("_pair")).join(rare, F.col("_pair") == F.col("pair"))
    more = joined.groupBy(F.col("row").alias("_row")).agg(F.sum("n").alias("more"), F.count_if("best").alias("more_best"))
    sums = found.drop("rest").join(more, F.col("row") == F.col("_row"), "left").select(
        F.col("row").alias("_row"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
    )
    return rows.drop("links").join(sums, F.col("row") == F.col("_row")).select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def _shape(a, b) -> tuple[int, type]:
    """Ids of B, and the type of a packed pair."""
    sizes = [len(m.tokenizer()[1]) for m in (a, b)]
    return sizes[1], np.uint32 if sizes[0] * sizes[1] < 1 << 32 else np.uint64
