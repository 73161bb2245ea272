"""Ordered computations that stay distributed.

A window ordered over a whole table, or over one hot key, runs in one task. The helpers here
cut the order into blocks of consecutive positions, so that no task ever sees more than
``block`` rows of one key, and carry one summary row per block across the block borders.
They need an integer order column that is unique within its keys (a line number, a time), dense or sparse.
The summaries stay small: a trillion rows of one key make four million of them.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 18
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``; a temporary one where driver and executors are one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Ranges told apart by quantiles of the order; each is cut evenly into blocks.
_RANGES = 256


def _blocked(df: DataFrame, order: str, block: int) -> tuple[DataFrame, bool]:
    """Add ``_blk``, growing with the order column, so that a block has about ``block`` rows however sparse the order is; and tell
    whether there are several.

    The order column is read once for its quantiles, which cut it into ranges; the rows counted in a range tell into how many equal
    stretches it is cut. A table of several blocks is written once, as it is read several times from here on; one of a single
    block needs none of this, with the same results.
    """
    at = F.col(order)
    shares = F.array(*[F.lit(i / _RANGES) for i in range(1, _RANGES)])
    n, bounds = df.agg(F.count(at), F.percentile_approx(at, shares, 10_000)).first()
    if n <= block:
        return df.withColumn("_blk", F.lit(0).cast("bigint")), False
    df = materialize(df)
    bounds = sorted(set(bounds))
    ranged = range_of(at, bounds)
    found = df.filter(at.isNotNull()).groupBy(ranged.alias("r")).agg(F.count("*"), F.min(at), F.max(at)).collect()
    first, low, step, blocks = {}, {}, {}, 0
    for r, rows, lo, hi in sorted(found):  # one row per range
        parts = -(-rows // block)
        first[r], low[r], step[r] = blocks, lo, (hi - lo) // parts + 1
        blocks += (hi - lo) // step[r] + 1

    def of(values: dict) -> Column:
        return F.element_at(_longs([values.get(i, 1) for i in range(len(bounds) + 1)]), ranged + 1)

    inside = F.try_divide(at - of(low), of(step))
    return df.withColumn("_blk", of(first) + F.floor(inside)), True


def _longs(values: Sequence[int]) -> Column:
    return F.expr("array(" + ", ".join(f"cast('{int(v)}' as bigint)" for v in values) + ")")


def range_of(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: a search over every 16th, then over the 16 from there."""
    coarse = F.size(F.filter(_longs(bounds[::16]), lambda b: b <= value))
    fine = F.slice(_longs(bounds), F.greatest((coarse - 1) * 16 + 1, F.lit(1)), F.lit(16))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * 16 + F.size(F.filter(fine, lambda b: b <= value)))


def _scan(rows: DataFrame, seeds: DataFrame | None, order: str, keys: Sequence[str], out: dict[str, Column], end: int | None):
    """Window each block, started by its seed row if there are any, and drop the seeds again.

    Seeds travel with the rows through the one shuffle the window needs, so nothing is joined.
    """
    w = Window.partitionBy(*keys, "_blk").orderBy(F.col("_seed").desc(), F.col(order))
    if end is not None:
        w = w.rowsBetween(Window.unboundedPreceding, end)
    both = rows.withColumn("_seed", F.lit(False))
    if seeds is not None:
        both = both.unionByName(seeds.withColumn("_seed", F.lit(True)), allowMissingColumns=True)
    return both.withColumns({n: c.over(w) for n, c in out.items()}).filter(~F.col("_seed")).drop("_blk", "_seed")


def lag_in_order(
    df: DataFrame, order: str, value: Column, name: str, keys: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Add ``name``: ``value`` of the previous row of the same keys, NULL on the first row."""
    rows, several = _blocked(df, order, block)
    rows = rows.withColumn("_val", F.struct(value.alias("v")))
    across = Window.partitionBy(*keys).orderBy("_blk")
    seeds = (
        rows.groupBy(*keys, "_blk")
        .agg(F.max_by("_val", order).alias("_val"))
        .withColumn("_val", F.lag("_val").over(across))
        .filter(F.col("_val").isNotNull())
    )
    out = _scan(rows, seeds if several else None, order, keys, {"_lagged": F.lag("_val")}, None)
    return out.withColumn(name, F.col("_lagged.v")).drop("_val", "_lagged")


def fill_in_order(
    df: DataFrame, order: str, value: Column, name: str, keys: Sequence[str] = (), block: int = BLOCK,
    exclusive: bool = False,
) -> DataFrame:
    """Add ``name``: the last non-NULL ``value`` of the same keys up to each row.

    The row itself counts unless ``exclusive``.
    """
    rows, several = _blocked(df, order, block)
    rows = rows.withColumn("_val", value)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("_val").isNotNull(), F.col(order))
    seeds = (
        rows.groupBy(*keys, "_blk")
        .agg(F.max_by("_val", at).alias("_val"))
        .withColumn("_val", F.last("_val", ignorenulls=True).over(before))
        .filter(F.col("_val").isNotNull())
    )
    out = _scan(rows, seeds if several else None, order, keys, {name: F.last("_val", ignorenulls=True)}, -1 if exclusive else 0)
    return out.drop("_val")


def running_sums(
    df: DataFrame, order: str, sums: dict[str, Column], keys: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Add running totals (first row to current row) of BIGINT expressions."""
    inputs = {n: f"_in_{n}" for n in sums}
    rows, several = _blocked(df, order, block)
    rows = rows.withColumns({inputs[n]: c.cast("bigint") for n, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    seeds = rows.groupBy(*keys, "_blk").agg(*[F.sum(i).alias(i) for i in inputs.values()])
    seeds = seeds.select(*keys, "_blk", *[F.sum(i).over(before).alias(i) for i in inputs.values()])
    out = _scan(rows, seeds if several else None, order, keys, {n: F.sum(i) for n, i in inputs.items()}, 0)
    return out.drop(*inputs.values())


def rank_in_order(
    df: DataFrame, order: str, name: str, keys: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Add ``name``: 1-based position of each row within its keys."""
    return running_sums(df, order, {name: F.lit(1)}, keys, block)


def rank_by(df: DataFrame, order: Sequence[Column], name: str, limit: int | None = None) -> DataFrame:
    """Add ``name``: dense 1-based position of each row in a total order of the whole table, or of its first ``limit`` rows.

    The sorted rows are materialized once; positions are then the position inside a sorted partition plus the sizes of the
    partitions before it (one summary row per partition). With a limit every partition keeps that many rows at most.
    """
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered = materialize(ordered if limit is None else ordered.filter(inside < limit))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(part.alias("_part"))
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    )
    # One row per sort partition, so its size is bound by spark.sql.shuffle.partitions.
    numbered = (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, inside + F.col("_off") + 1)
        .drop("_id", "_part", "_off")
    )
    return numbered if limit is None else numbered.filter(F.col(name) <= limit)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, block: int = BLOCK) -> DataFrame:
    """Add ``name``: 1-based position of each row among those of its keys.

    Keys of up to ``block`` rows are ranked in a window each. Only the rows of hotter keys are sorted by keys and order, so that
    each of these is spread over many sorted partitions; its positions are then counted from its first row.
    """
    hot = materialize(df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count("*").alias("_n")).filter(F.col("_n") > block).drop("_n"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(name, place)
    ranked = rank_by(df.join(hot, same, "left_semi"), [*[F.col(k) for k in keys], *order], "_at")
    first = ranked.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_at").alias("_first"))
    counted = ranked.join(first, same).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *[f"_k_{k}" for k in keys])
    return df.join(hot, same, "left_anti").withColumn(name, place).unionByName(counted)


#: One row in so many takes part in finding a cutoff.
_SUBSET = 16
#: Up to so many selected rows are brought together in one task.
_TOGETHER = 1 << 20


def _near(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The rows that can be among the first ``limit``, and some more, with their ``_key``.

    The last of the first ``limit`` rows of a random subset is a safe cutoff: at least so many rows of the whole come no later.
    """
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    subset = keyed.filter(F.rand(7) < 1 / _SUBSET).select("_key").orderBy("_key").limit(limit)
    # No cutoff if the subset has too few rows.
    cutoff = subset.agg(F.when(F.count("*") == limit, F.max("_key"))).scalar()
    return keyed.filter(F.coalesce(F.col("_key") <= cutoff, F.lit(True)))


def first_rows(df: DataFrame, order: Sequence[Column], limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows of a total order, with their 1-based position; the table is not sorted.

    ``order`` are ascending expressions. Rows beyond a cutoff are dropped where they lie, and of the others each task hands on
    ``limit`` at most. A very large limit is taken from a sort of what the cutoff leaves.
    """
    near = _near(df, order, limit)
    if limit > _TOGETHER:
        return rank_by(near, [F.col("_key")], name, limit).drop("_key")
    first = near.orderBy("_key").limit(limit)
    return first.withColumn(name, F.row_number().over(Window.orderBy("_key")).cast("bigint")).drop("_key")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], quotas: DataFrame, quota: str, name: str) -> DataFrame:
    """Of each key the first rows of an order (ascending expressions), as many as its ``quota`` in ``quotas`` (a row per key), with
    their position; keys without a quota have none.

    Quotas up to ``_EARLY`` are ranked with early dropping; beyond, rows that come after the last of their key's first rows in a
    random subset are dropped where they lie, and the rest is sorted.
    """
    most = quotas.agg(F.max(quota)).first()[0] or 0
    limits = quotas.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col(quota).alias("_quota"))

    def same(df):
        return reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"_q_{k}")) for k in keys])

    def within(ranked):
        return ranked.join(limits, same(ranked)).filter(F.col(name) <= F.col("_quota")).drop("_quota", *[f"_q_{k}" for k in keys])

    if most <= _EARLY:
        return within(top_per_key(df, keys, order, max(most, 1), name))
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    subset = rank_within(keyed.filter(F.rand(7) < 1 / _SUBSET).select(*keys, "_key"), keys, [F.col("_key")], "_n")
    at = subset.join(limits, same(subset)).filter(F.col("_n") == F.col("_quota"))
    cuts = at.select(*[F.col(f"_q_{k}").alias(f"_c_{k}") for k in keys], F.col("_key").alias("_cut"))
    near = keyed.join(cuts, reduce(lambda a, b: a & b, [keyed[k].eqNullSafe(F.col(f"_c_{k}")) for k in keys]), "left")
    near = near.filter("_cut is null or _key <= _cut").drop("_cut", *[f"_c_{k}" for k in keys])
    return within(rank_within(near, keys, [F.col("_key")], name)).drop("_key")


#: Up to this k Spark drops losers before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
_EARLY = 1000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str | None = None) -> DataFrame:
    """At most ``k`` rows per key. Each task drops losers before the shuffle, so hot keys shrink first; a ``k`` too
    large for that takes positions from a distributed sort."""
    rank = name or "_rank"
    if k > _EARLY:
        out = rank_within(df, keys, order, rank)
    else:
        out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    out = out.filter(F.col(rank) <= k)
    return out if name else out.drop(rank)
