"""Mixing sources to target weights by fitting subset sums.

Every source gets a share of the budget by its weight, at most ``cap`` times its own size. Whole passes over a
source come first; the rest of its target is a subset-sum problem over the counts of documents by exact token
length: most of it is filled in proportion to the counts, then from the longest down, and a bounded knapsack fits
the last tokens exactly. How many documents of each length are taken is thereby known; which ones, a seeded hash
decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import saved
from linkloom.scale import rank_by, rank_within

#: Hash buckets within one (source, length): the rows of one are ranked in one task, so hot lengths are spread.
BUCKETS = 4096
#: Tokens left to the knapsack.
KNAPSACK = 1 << 15


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: np.ndarray, weights: np.ndarray, budget: float, cap: float) -> np.ndarray:
    """Shares of ``budget`` by weight; what exceeds ``cap`` times a source's size goes to the others by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out = np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    while free.any():
        left = max(budget - out[~free].sum(), 0.0)
        share = left * weights / weights[free].sum()
        over = free & (share > cap * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap * sizes[over]
        free &= ~over
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take (at most ``counts``) so that their tokens come to ``budget``,
    or as near below as the knapsack can come. Needs memory for the distinct lengths and the knapsack alone."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // max(total, 1) for c in counts], np.int64)
    take[lengths == 0] = 0
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= KNAPSACK:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), (left - KNAPSACK) // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):  # where only long documents are left
        if left <= 64 * KNAPSACK:
            break
        if 0 < lengths[i] <= left:
            more = min(int(counts[i] - take[i]), left // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    return take + _knapsack(lengths, counts - take, left)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack by reachable sums: every sum remembers the item that reached it first."""
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    item = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        size, copies = int(lengths[i]), int(counts[i])
        if not 0 < size <= budget:
            continue
        copies, k = min(copies, budget // size), 1
        while copies > 0:
            k = min(k, copies)
            w = k * size
            new = np.flatnonzero(reached[:-w] & ~reached[w:]) + w
            reached[new] = True
            item[new] = len(items)
            items.append((i, k))
            copies -= k
            k *= 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = items[item[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def source_targets(sized: DataFrame, weight: Callable[[int], float], budget: float, cap: float) -> DataFrame:
    """(src, source, source_size, target) of every source of (source, size), as ``targets`` shares them out.

    Sources are numbered from 0 by a distributed sort, and each refill round is one aggregation: sources that would get more than
    ``cap`` times their size at the present level keep that, and the others share what is left. Sums are exact
    decimals, so reruns agree.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    by_place = F.pandas_udf(lambda places: places.map(weight).astype(float), "double")
    numbered = rank_by(per_source, order, "src").withColumn("src", F.col("src") - 1)
    weighed = saved(numbered.withColumn("weight", by_place("src")), "mix")
    most = F.lit(float(cap)) * F.col("source_size")
    sums = weighed.agg(F.sum("source_size").alias("size"), _exact_sum(F.col("weight"))).first()
    total, left, free = budget * float(sums[0] or 0), None, None
    share = F.lit(0.0)
    after = (total, float(sums[1] or 0))
    while after != (left, free) and after[1] > 0:
        left, free = after
        share = F.lit(left) * F.col("weight") / F.lit(free)
        over = share > most
        got = weighed.agg(F.sum(F.when(over, F.col("source_size"))), _exact_sum(F.when(~over, F.col("weight")))).first()
        after = (max(total - cap * float(got[0] or 0), 0.0), float(got[1] or 0))
    if after[1] <= 0:  # every source is at its cap
        share = most
    return weighed.select("src", "source", "source_size", F.least(share, most).alias("target"))


def _exact_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(28,9)"))


def mix(
    docs: DataFrame, weight: Callable[[int], float], budget: float = 1.5, cap: float = 2.0, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every document, ``budget`` and ``cap`` as multiples
    of all and of the source's tokens; ``weight`` gets a source's place in code-point order, NULL last.

    ``size`` (the number of words unless given) counts tokens, 0 for NULL texts; documents of size 0 are
    taken along with whole passes and add nothing. A source of size 0 has target 0. Equal ids have equal hashes, so which of
    them is taken is immaterial. Other columns are not read. ``cap`` must be whole, for no document is taken more often.
    """
    if cap != int(cap):
        raise ValueError("cap must be a whole number")
    thin = saved(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        (words(F.col("text")) if size is None else size).alias("size"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"),
    ), "mix")
    plan = saved(source_targets(thin, weight, budget, cap).withColumn(
        "passes", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")
    ).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("bigint")), "mix")
    coded = thin.withColumnRenamed("source", "_s").join(plan, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    bucket = F.shiftrightunsigned("h", 52)
    by_bucket = coded.groupBy("src", "rest", "size", bucket.alias("bucket")).agg(F.count("*").alias("n"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        got = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"].iloc[0]))
        return pd.DataFrame({"src": pdf["src"].to_numpy(), "size": pdf["size"].to_numpy(), "wanted": got})

    # A group holds one row per distinct length of a source, not its documents.
    lengths = by_bucket.groupBy("src", "rest", "size").agg(F.sum("n").alias("n"))
    wanted = lengths.groupBy("src").applyInPandas(choose, "src bigint, size bigint, wanted bigint").filter("wanted > 0")
    before = F.sum("n").over(Window.partitionBy("src", "size").orderBy("bucket")) - F.col("n")
    # Written, so that the documents below are dealt by bucket too, not by the length that this table is dealt by.
    some = saved(
        by_bucket.drop("rest").join(wanted, ["src", "size"])
        .withColumn("first", F.least(F.col("wanted") - before, F.col("n")))
        .filter("first > 0").select("src", "size", "bucket", "first"), "mix"
    )
    ranked = coded.withColumn("bucket", bucket).join(some, ["src", "size", "bucket"], "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "id"))
    )
    copies = F.col("passes") + F.coalesce(F.col("place") <= F.col("first"), F.lit(False)).cast("int")
    return ranked.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.alias("copies"), (F.col("size") * copies).alias("taken"),
    )


def five_two_one(place: int) -> float:
    return (5.0, 2.0, 1.0)[place % 3]


def repeat(docs: DataFrame, weight: Callable[[int], float], budget: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with their columns as they are, whatever their names.

    Texts move once, unless few enough documents are taken otherwise than once. Where rows that share an id (or have none) are
    taken unequally, the copies are dealt out among those of one source and size, so the total is that of ``mix``.
    """
    source, size = F.col("source"), words(F.col("text"))
    taken = saved(mix(docs, weight, budget, cap, seed, id_col), "mix").withColumnRenamed(id_col, "id")
    alike = taken.groupBy("id").agg(F.min("copies").alias("copies"), F.max("copies").alias("most"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own"))
    out = rows.join(alike.filter("copies = most and copies > 0"), F.col("own").eqNullSafe(F.col("id"))).select("row", "copies")
    unequal = saved(alike.filter("copies < most").select("id"), "mix")
    if not unequal.isEmpty():
        keys = ["own", "source", "size"]
        own = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own"), source.alias("source"), size.alias("size"),
            F.xxhash64("text").alias("h"),
        ).join(unequal, F.col("own").eqNullSafe(F.col("id")), "left_semi")
        sums = taken.join(unequal.withColumnRenamed("id", "u"), F.col("id").eqNullSafe(F.col("u")), "left_semi").groupBy(
            F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z")
        ).agg(F.sum("copies").alias("all"), F.count("*").alias("n"))
        same = F.col("own").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
        dealt = rank_within(own, keys, [F.col("h")], "place").join(sums, same)
        copies = F.floor(F.col("all") / F.col("n")) + (F.col("place") <= F.col("all") % F.col("n")).cast("int")
        out = out.union(dealt.select("row", copies.cast("int")).filter(copies > 0))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
