"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets are one. Of the others, signatures are cut into bands; documents that share a band
are candidates. A candidate pair's signatures are compared batch by batch and the pair is dropped as soon as the
posterior probability of reaching the similarity falls below the chosen miss probability. Survivors are
verified on their full sets, and what links is joined into components.

Within a band's bucket every document is paired with the most central one. Documents that buckets
connect are a family; where one still holds several components after that, its documents outside the largest component
are compared with all of it in blocks, so no link is left out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import free_name, map_rows, map_texts, saved
from linkloom.llm.graph import components

BANDS = 26
ROWS = 5
BATCH = 10
BLOCK = 512
#: Ids broadcast at most (32 MB); more are joined by shuffle.
BROADCAST_IDS = 4_000_000
_CACHED_WORDS = 150_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """Word to 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text: A-Z lower-cased, words parted by ASCII white space.

    Fewer words than ``width`` make one shingle of them all; no words make none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_hashes[w] for w in words], np.uint64)
    n = max(len(h) - width + 1, 1)
    size = min(width, len(h))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mixed(out * _M2 + h[k:k + n])
    return np.unique(out)


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signature(sets: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of 32-bit hashes; long sets are taken in stretches."""
    a, b = _functions(n)
    out = np.full(n, 2**32 - 1, np.uint64)
    for i in range(0, len(sets), 2048):
        some = sets[i:i + 2048]
        out = np.minimum(out, ((some[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def least_matches(n: int, similarity: float, miss: float) -> int:
    """Fewest matches among ``n`` hashes that keep a pair: with a uniform prior, the posterior of the similarity after m
    matches is Beta(m + 1, n - m + 1), and its mass from ``similarity`` up must be at least ``miss``."""
    mass = 0.0
    for m in range(n + 1):
        mass += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if mass >= miss:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, similarity: float, miss: float, batch: int = BATCH) -> np.ndarray:
    """Which pairs of signature rows pass all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), int)
    for end in range(batch, a.shape[1] + batch, batch):
        end = min(end, a.shape[1])
        start = end - batch if end % batch == 0 else end - end % batch
        matches[alive] += (a[alive, start:end] == b[alive, start:end]).sum(1)
        alive = alive[matches[alive] >= least_matches(end, similarity, miss)]
    return alive


def _restricted(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join by id. The ids are broadcast if few (8 bytes each), so that texts stay where they lie."""
    other = free_name("_id", docs)
    ids = ids.select(F.col("id").alias(other))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(id_col) == F.col(other), how)


def _promising(pairs: DataFrame, reps: DataFrame, similarity: float, miss: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures survive."""
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))

    def work(batches):
        for b in batches:
            n = len(b["a"])
            sa = np.frombuffer(b"".join(b["sa"]), np.uint32).reshape(n, -1)
            sb = np.frombuffer(b"".join(b["sb"]), np.uint32).reshape(n, -1)
            at = survivors(sa, sb, similarity, miss)
            yield {"a": [b["a"][i] for i in at], "b": [b["b"][i] for i in at]}

    return map_rows(both.select("a", "b", "sa", "sb"), "a bigint, b bigint", work)


def _across(members: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v) that join different components of one family; ``members`` are (family, rep, component, others).

    ``others`` tells the documents outside their family's largest component: these are compared with all of the
    family, in blocks, by signature and then on the full sets. Once two components are joined in a task, their further pairs are
    skipped, as they can join nothing more; so links come out, never pairs.
    """
    size = members.groupBy("family").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("others") / BLOCK).cast("int").alias("other_blocks")
    )
    texts = _restricted(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    sets = saved(map_texts(texts, "id bigint, s binary", _shingling(width)).filter(F.length("s") > 0), "minhash")
    rows = saved(members.join(size, "family").join(reps.select("rep", "sig"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep"), "minhash")

    def dealt(rows, own, blocks, other, other_blocks, salt):
        mine = F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(blocks)).cast("int")
        return rows.select(
            F.col("family").alias("family"), mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)).alias(other),
            *[F.col(c).alias(c) for c in ("rep", "component", "sig", "s")],
        )

    few = dealt(rows.filter("others"), "i", "other_blocks", "j", "blocks", 1)
    every = dealt(rows, "j", "blocks", "i", "other_blocks", 2)
    similarity = percent / 100

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64")})
        if left.empty or right.empty:
            return nothing
        names, label = np.unique(np.concatenate([left["component"], right["component"]]), return_inverse=True)
        a, b = label[: len(left)], label[len(left):]
        root = np.arange(len(names))
        sig = np.frombuffer(b"".join(right["sig"]), np.uint32).reshape(len(right), -1)
        n = np.array([len(x) // 8 for x in right["s"]])
        out = []
        for i, (rep, s, packed) in enumerate(zip(left["rep"], left["sig"], left["s"])):
            own = np.frombuffer(packed, np.uint64)
            j = np.flatnonzero((root[b] != root[a[i]]) & (np.minimum(n, len(own)) >= similarity * np.maximum(n, len(own))))
            if len(j):
                mine = np.broadcast_to(np.frombuffer(s, np.uint32), (len(j), sig.shape[1]))
                j = j[survivors(mine, sig[j], similarity, miss)]
            for k in j:
                if root[a[i]] != root[b[k]] and _link(packed, right["s"].iloc[k], percent):
                    out.append((rep, right["rep"].iloc[k]))
                    root[root == root[b[k]]] = root[a[i]]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64") if out else nothing

    key = ["family", "i", "j"]
    return few.groupBy(key).cogroup(every.groupBy(key)).applyInPandas(compare, "u bigint, v bigint")


def _link(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sorted, packed sets link."""
    total = (len(x) + len(y)) // 8
    common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return 100 * common >= percent * (total - common)


def _shingling(width: int):
    def shingle(batches):
        for b in batches:
            yield {"id": b["id"], "s": [shingles(t, width).tobytes() for t in b["text"]]}
        _hashes.clear()  # a worker may serve other tasks next

    return shingle


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (u, v) that link on their full sets; only the texts that occur in pairs are shingled again."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = _restricted(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), ids, "id", "left_semi")
    sets = saved(map_texts(texts, "id bigint, s binary", _shingling(width)).filter(F.length("s") > 0), "minhash")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a"
    )

    def verify(batches):
        for b in batches:
            out = {"u": [], "v": []}
            for i, j, x, y in zip(b["a"], b["b"], b["sa"], b["sb"]):
                if _link(x, y, percent):
                    out["u"].append(i)
                    out["v"].append(j)
            yield out

    return saved(map_texts(both.select("a", "b", "sa", "sb"), "u bigint, v bigint", verify, most_bytes=4 << 20), "minhash")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-5, bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents link when 100 * |A and B| >= percent * |A or B| on their sets of ``width``-word shingles. NULL, empty and
    blank texts have empty sets and link with nothing. A link at the threshold shares no band with probability
    (1 - s^rows)^bands (3e-5 by default) and is pruned with about ``miss``. Rows that repeat an id are one node: their links
    join. Rows with a NULL id link with nothing and have no component. Other columns are not read.
    """
    n_hashes = bands * rows
    s = percent / 100

    def sign(batches):
        for b in batches:
            out = {c: [] for c in ("id", "n", "h1", "h2", "sig")}
            for i, text in zip(b["id"], b["text"]):
                sets = shingles(text, width)
                whole = xxhash.xxh3_128_intdigest(sets.tobytes())
                out["id"].append(i)
                out["n"].append(len(sets))
                out["h1"].append((whole & (2**64 - 1)) - 2**63)
                out["h2"].append((whole >> 64) - 2**63)
                out["sig"].append(signature(sets, n_hashes).tobytes() if len(sets) else None)
            yield out
        _hashes.clear()

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = saved(map_texts(texts, "id bigint, n bigint, h1 bigint, h2 bigint, sig binary", sign), "minhash")
    live = signed.filter("n > 0 and id is not null")
    # Equal sets have equal signatures, so any of them stands for all.
    equal = live.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    equal = saved(equal, "minhash")
    reps = equal.select("rep", "n", "sig")

    def band(k):
        piece = F.substring("sig", 4 * rows * k + 1, 4 * rows)
        return F.struct(F.lit(k).alias("band"), F.xxhash64(piece).alias("key"))

    banded = reps.select("rep", F.explode(F.array(*[band(k) for k in range(bands)])).alias("b")).select("rep", "b.band", "b.key")
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    member = saved(banded.join(shared, ["band", "key"]), "minhash")
    # The original of a family shares the large buckets in most bands; its copies fall out of some.
    central = member.groupBy("rep").agg(F.sum("size").alias("central"))
    most = F.max_by("rep", F.struct(F.col("central"), -F.col("rep")))
    leaders = member.join(central, "rep").groupBy("band", "key").agg(most.alias("first"))
    pairs = (
        member.join(leaders, ["band", "key"]).filter("rep != first")
        .select(F.least("first", "rep").alias("a"), F.greatest("first", "rep").alias("b")).distinct()
    )
    pairs = saved(pairs, "minhash")
    links = _verified(saved(_promising(pairs, reps, s, miss), "minhash"), docs, width, percent, id_col, text_col)
    groups = saved(components(links), "minhash")

    # Families (documents that buckets connect) that still hold several components.
    related = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    labelled = saved(related.join(groups, F.col("rep") == F.col("node"), "left").select(
        "family", "rep", F.coalesce("component", "rep").alias("component")
    ), "minhash")
    per_component = labelled.groupBy("family", "component").agg(F.count("*").alias("n"))
    largest = per_component.groupBy("family").agg(
        F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("largest"), F.count("*").alias("parts")
    ).filter("parts > 1")
    still = labelled.join(largest, "family").select("family", "rep", "component", (F.col("component") != F.col("largest")).alias("others"))
    links = links.union(saved(_across(saved(still, "minhash"), docs, reps, width, percent, miss, id_col, text_col), "minhash"))

    copies = live.select("id", "h1", "h2").join(equal.filter("copies > 1").select("h1", "h2", "rep"), ["h1", "h2"])
    edges = links.union(copies.filter("id != rep").select("id", "rep"))
    classes = components(edges).withColumnRenamed("node", "_node")
    out = signed.select("id", "n").join(classes, F.col("id") == F.col("_node"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their component, with all their columns; of rows that repeat an id, one stays."""
    found = saved(near_duplicates(docs, width, percent, id_col=id_col, text_col=text_col), "minhash")
    gone = found.filter(~F.col("kept")).select(F.col(id_col).alias("id")).distinct()
    rest = _restricted(docs, gone, id_col, "left_anti")
    again = found.filter("kept").groupBy(F.col(id_col).alias("id")).count().filter("count > 1 and id is not null").select("id")
    if again.isEmpty():
        return rest
    return _restricted(rest, again, id_col, "left_anti").union(_restricted(rest, again, id_col, "left_semi").dropDuplicates([id_col]))
