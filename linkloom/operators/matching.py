"""Dictionary joins: keywords contained in names, aliases, labels and address blocks.

Rule tables that fit in a plan are literals (see ``functions``). The table forms here take rule tables of any size without
testing every row against every rule: keywords are found through an index of short pieces, addresses by a search among
sorted blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.functions.text import let
from linkloom.scale import materialize, range_of, rank_by


# Python workers get this module with the tasks, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keywords up to this length are found as a whole; of longer ones the largest power of two that fits, and the rest is compared.
_WHOLE = 16
#: Bounds of the number of slots, as powers of two, in which a task looks whether a piece can belong to a keyword.
_SLOT_BITS = (16, 22)
_BASE = 0x9E3779B97F4A7C15
_64 = (1 << 64) - 1


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """All distinct pieces of ``text`` of these sizes: as many as it has characters, for each size."""
    def of(chars, n):
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.concat(*[F.get(chars, p + i) for i in range(n)]))

    # Characters are told apart once: a substring would be counted out from the start of the text.
    return let(F.split(text, ""), lambda chars: F.array_distinct(F.concat(*[of(chars, n) for n in sizes])))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _piece_hashes(chars: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the ascending ``sizes``, a hash of the piece that begins at each place. Up to size 3 no two pieces share one."""
    def joined(left, at, right, n):
        count = len(chars) - at - n + 1
        factor = np.uint64(1 << 21 * n if at + n <= 3 else pow(_BASE, n, 1 << 64))
        return left[:count] * factor + right[at:at + count]

    powers = {1: chars}
    for size in sizes:
        if size > len(chars):
            return
        out, done = None, 0
        for bit in range(size.bit_length() - 1, -1, -1):
            n = 1 << bit
            for k in range(1, bit + 1):
                if 1 << k not in powers:
                    half = powers[1 << k - 1]
                    powers[1 << k] = joined(half, 1 << k - 1, half, 1 << k - 1)
            if size & n:
                out, done = (powers[n], n) if out is None else (joined(out, done, powers[n], n), done + n)
        yield size, out


def _slots(hashes: np.ndarray, size: int, bits: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(size * _BASE & _64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _found_pieces(texts: Sequence[str], sizes: Sequence[int], slots: np.ndarray, bits: int) -> list[list[dict]]:
    """Per text the distinct pieces that fall into a slot of a keyword, with what follows them as far as a longer keyword reaches."""
    whole = "".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    found = [set() for _ in texts]
    for size, hashes in _piece_hashes(_code_points(whole), sizes):
        at = np.flatnonzero(slots[_slots(hashes, size, bits)])
        which = np.searchsorted(ends, at, "right")
        inside = at + size <= ends[which]
        at, which = at[inside], which[inside]
        if size <= 3:  # equal hashes are equal pieces, so each counts once before it becomes a string
            codes, own = pd.factorize(hashes[at])
            pairs = np.unique(which * max(len(own), 1) + codes)
            _, first = np.unique(codes, return_index=True)
            shown = [whole[p:p + size] for p in at[first].tolist()]
            for text, code in zip((pairs // max(len(own), 1)).tolist(), (pairs % max(len(own), 1)).tolist()):
                found[text].add((shown[code], ""))
            continue
        more = size - 1 if size >= _WHOLE else 0
        for text, p, end in zip(which.tolist(), at.tolist(), ends[which].tolist()):
            found[text].add((whole[p:p + size], whole[p + size:min(p + size + more, end)]))
    return [[{"_piece": piece, "_rest": rest} for piece, rest in pieces] for pieces in found]


#: Texts searched together: at most so many rows and bytes (one text, if it is longer).
_TOGETHER, _BYTES = 512, 1 << 20


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        end = int(np.searchsorted(ends, ends[start] - sizes[start] + _BYTES, "right"))
        end = min(max(end, start + 1), start + _TOGETHER)
        yield batch.slice(start, end - start)
        start = end


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _first_words(df: DataFrame, text: Column, table: DataFrame, word: str, rank: str, keep: list[str]) -> DataFrame:
    """For each distinct ``text`` with a match: ``_digest`` and the ``keep`` columns of the contained ``word`` of lowest ``rank``.

    Every keyword is looked up by one piece, itself or its beginning; texts are read once, where they lie. A table of slots, bounded
    whatever the number of keywords, tells a task which pieces can belong to one; only these, with what follows them as far as
    the keyword could reach, go to the join, which compares them exactly. So work grows with the length of the texts, and of a
    text one row, its first keyword, goes to a shuffle. Empty keywords and NULL texts match nothing.
    """
    ranked = table.filter((F.length(word) > 0) & F.col(rank).isNotNull()).select(F.col(word).alias("_kw"), F.col(rank).alias("_rank"), F.struct(*keep).alias("_keep"))
    # The first of equal keywords is enough; its place in the order is a number.
    ranked = ranked.groupBy("_kw").agg(F.min_by("_keep", "_rank").alias("_keep"), F.min("_rank").alias("_rank"))
    ranked = rank_by(ranked, [F.col("_rank"), F.col("_kw")], "_place")
    length = F.length("_kw")
    size = F.when(length <= _WHOLE, length).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(length))).cast("int"))
    # A power by floating point may be off by one step.
    size = F.when(size > length, F.floor(size / 2).cast("int")).when((size * 2 <= length) & (length > _WHOLE), size * 2).otherwise(size)
    words = ranked.withColumn("_size", size).select(
        F.substring("_kw", F.lit(1), F.col("_size")).alias("_piece"), F.substr("_kw", F.col("_size") + 1).alias("_after"), "_size", "_place", "_keep"
    )
    shape = words.groupBy("_size").agg(F.count("*").alias("n")).collect()  # a row per size: 16, and one per doubling
    sizes = sorted(r["_size"] for r in shape)
    bits = min(max((1024 * sum(r["n"] for r in shape)).bit_length(), _SLOT_BITS[0]), _SLOT_BITS[1])

    def to_slots(batches):
        for b in batches:
            own = [int(_slots(h, n, bits)[0]) for piece in b["_piece"].to_pylist() for n, h in _piece_hashes(_code_points(piece), [len(piece)])]
            yield pa.RecordBatch.from_pydict({"slot": sorted(set(own))}, schema=pa.schema([("slot", pa.int64())]))

    taken = [r["slot"] for r in words.select("_piece").mapInArrow(to_slots, "slot bigint").distinct().collect()]
    kinds = pa.schema([("_digest", pa.binary()), ("_hits", pa.list_(pa.struct([("_piece", pa.string()), ("_rest", pa.string())])))])

    def search(batches):
        slots = np.zeros(1 << bits, bool)
        slots[taken] = True
        for b in batches:
            for s in _slices(b, "_text"):
                hits = _found_pieces(s["_text"].to_pylist(), sizes, slots, bits)
                yield pa.RecordBatch.from_pydict({"_digest": s["_digest"], "_hits": hits}, schema=kinds)

    texts = df.filter(text.isNotNull()).select(_digest(text).alias("_digest"), text.alias("_text"))
    found = texts.mapInArrow(search, "_digest binary, _hits array<struct<_piece: string, _rest: string>>")
    hits = found.select("_digest", F.explode("_hits").alias("_hit")).select("_digest", "_hit.*")
    met = hits.join(words.select("_piece", "_after", "_place"), "_piece").filter(F.startswith("_rest", F.col("_after")))
    best = met.groupBy("_digest").agg(F.min("_place").alias("_place"))
    return best.join(words.select("_place", "_keep"), "_place").select("_digest", "_keep.*")


def contains_join(df: DataFrame, text: str, table: DataFrame, word: str, rank: str, keep: list[str]) -> DataFrame:
    """For each distinct ``text``: the ``keep`` columns of the contained ``word`` of lowest ``rank``.

    Returns ``text`` and ``keep`` for texts with a match (see ``_first_words``).
    """
    best = _first_words(df, F.col(text), table, word, rank, keep)
    return df.select(text).distinct().withColumn("_digest", _digest(F.col(text))).join(best, "_digest").drop("_digest")


def classify_by_table(df: DataFrame, rule_table: DataFrame, default: str, text: str = "name") -> DataFrame:
    """Add ``category``: that of the first rule in rank order whose keyword the name contains."""
    lowered = F.lower(text)
    table = rule_table.select(F.lower("keyword").alias("_word"), "cat_rank", "category")
    hits = _first_words(df, lowered, table, "_word", "cat_rank", ["category"])
    # Only digests of the texts go to the join; a column that is not asked for afterwards stays where it lies.
    out = df.withColumn("_digest", _digest(lowered)).join(hits, "_digest", "left").drop("_digest")
    return out.withColumn("category", F.coalesce("category", F.lit(default)))


def alias_exact(df: DataFrame, aliases: DataFrame, text: str = "name") -> DataFrame:
    """Add ``canonical`` for names equal to an alias (NULL otherwise)."""
    table = aliases.select(F.col("alias").alias(text), "canonical")
    return df.join(table, text, "left")


def alias_partial(df: DataFrame, aliases: DataFrame, text: str = "name") -> DataFrame:
    """Add ``canonical``: the first contained alias replaced; the name itself without one."""
    named = aliases.select("alias", F.col("canonical").alias("_to"), "ord")
    hits = _first_words(df, F.col(text), named, "alias", "ord", ["alias", "_to"])
    out = df.withColumn("_digest", _digest(F.col(text))).join(hits, "_digest", "left").drop("_digest")
    replaced = F.replace(F.col(text), F.col("alias"), F.col("_to"))
    return out.withColumn("canonical", F.coalesce(replaced, F.col(text))).drop("alias", "_to")


def label_join(df: DataFrame, labels: DataFrame, key: str = "category") -> DataFrame:
    """Add ``label`` from a lookup table; unknown keys are their own label."""
    return df.join(labels.select(key, "label"), key, "left").withColumn("label", F.coalesce("label", key))


def address_key(h: Column) -> Column:
    """IP literals as text whose order is theirs: IPv4 as ``4`` and 8 hex digits, IPv6 as ``6`` and 32; NULL for names."""
    v4 = F.concat(F.lit("4"), F.lower(F.lpad(F.hex(urls.ipv4_number(h)), 8, "0")))
    return F.coalesce(v4, F.concat(F.lit("6"), urls.ipv6_hex(h)))


def block_bounds(cidr: Column) -> Column:
    """First and last address (``lo``, ``hi``) of an IPv4 or IPv6 block; a single address is a block of its own, NULL otherwise."""
    def bounds(key, bits):
        size = F.when(F.contains(cidr, F.lit("/")), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(F.length(bits))

        def bound(fill):
            places = F.sequence(F.lit(0), (F.length(bits) / 4 - 1).cast("int"))
            hexed = let(F.rpad(F.substr(bits, F.lit(1), size), F.length(bits), fill), lambda full: F.array_join(
                F.transform(places, lambda i: F.lower(F.conv(F.substr(full, i * 4 + 1, F.lit(4)), 2, 16))), ""))
            return F.concat(F.substring(key, 1, 1), hexed)

        return F.when(size.between(0, F.length(bits)), F.struct(bound("0").alias("lo"), bound("1").alias("hi")))

    def of(key):
        nibbles = F.transform(F.split(F.substring(key, 2, 32), ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0"))
        return let(F.array_join(nibbles, ""), lambda bits: bounds(key, bits))

    return let(address_key(F.substring_index(cidr, "/", 1)), of)


def _coarse(key: Column) -> Column:
    """A number that grows with the address: all of IPv4, the upper 56 bits of IPv6."""
    number = F.conv(F.substring(key, 2, 14), 16, 10).cast("bigint")
    return F.when(key.startswith("6"), number + (1 << 33)).otherwise(number)


#: Ranges of addresses that are searched apart.
_RANGES = 64


def in_blocks(df: DataFrame, blocks: DataFrame, url: str = "url") -> DataFrame:
    """Add ``in_block``: the host is an IP literal in one of the ``cidr`` blocks, IPv4 or IPv6.

    Each distinct host is searched among the blocks once. Quantiles of the hosts cut the addresses into ranges; a block takes part in
    each range that it touches. In a range, hosts and blocks stand in order, and a host is inside if the last end of the
    blocks that begin before it is not behind it: that covers nested and repeated blocks. Blocks that are no addresses count for
    nothing. Addresses that share their upper 56 bits share a range.
    """
    named = df.withColumn("_host", urls.host(F.col(url)))
    hosts = materialize(named.select("_host").distinct().withColumn("key", address_key(F.col("_host"))).filter("key is not null"))
    shares = F.array(*[F.lit(i / _RANGES) for i in range(1, _RANGES)])
    cuts = sorted(set(hosts.agg(F.percentile_approx(_coarse(F.col("key")), shares, 1000)).first()[0] or ()))
    bounds = blocks.select(block_bounds(F.col("cidr")).alias("b")).filter("b is not null").select("b.*").distinct()
    reached = F.sequence(range_of(_coarse(F.col("lo")), cuts), range_of(_coarse(F.col("hi")), cuts))
    nets = bounds.select(F.explode(reached).alias("range"), F.col("lo").alias("key"), "hi")
    both = hosts.withColumn("range", range_of(_coarse(F.col("key")), cuts)).unionByName(nets, allowMissingColumns=True)
    before = Window.partitionBy("range").orderBy("key", F.col("hi").isNull())
    inside = both.withColumn("_end", F.max("hi").over(before)).filter("_host is not null and key <= _end").select("_host")
    return named.join(inside.withColumn("in_block", F.lit(True)), "_host", "left").withColumn(
        "in_block", F.coalesce("in_block", F.lit(False))
    ).drop("_host")
