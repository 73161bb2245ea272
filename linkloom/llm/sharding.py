"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by a hash of their text, then of their id. A size-weighted sample of keys gives the quantile
boundaries of some hundred ranges; ranges found overfull (a text that occurs very often, or many small rows) are
subdivided. Exact sizes of the ranges then place every row in the byte order of the whole table, and the shards
are equal stretches of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import fraction_hash, saved
from linkloom.scale import _longs, range_of

#: Rows of one subdivided range at most, about: they are ordered in one task.
RANGE_ROWS = 200_000
MOST_RANGES = 1024
SAMPLE_PER_RANGE = 16


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def _splitters(rows: DataFrame, n_ranges: int, total: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of about ``SAMPLE_PER_RANGE * n_ranges`` keys.

    A key that spans several quantiles gets a range of its own: it and its successor both become boundaries.
    """
    each = max(total / (SAMPLE_PER_RANGE * n_ranges), 1.0)  # bytes that one sampled key stands for
    sample = rows.filter(fraction_hash(F.col("k2"), F.col("k1"), F.lit("sample")) * each < F.col("size")).select(
        "k1", F.greatest(F.col("size").cast("double"), F.lit(each)).alias("w")
    )
    at = F.sum("w").over(Window.orderBy("k1").rowsBetween(Window.unboundedPreceding, 0))
    cells = sample.withColumn("cell", F.floor(at * n_ranges / total))
    firsts = [r["k1"] for r in cells.groupBy("cell").agg(F.min("k1").alias("k1")).orderBy("cell").collect()]
    hot = {k for k, after in zip(firsts, firsts[1:]) if k == after}
    return sorted(set(firsts) | {k + 1 for k in hot if k < 2**63 - 1})


def place(
    rows: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None,
) -> DataFrame:
    """One row (id, size, text_crc32, shard, slot) per row: shards of nearly equal size, slots without gaps from 0.

    ``size`` is the text's UTF-8 bytes plus 8 unless given; it must be positive. Shards differ from equal shares by
    less than one row. Equal texts are neighbours, so that a shard holds them together unless they alone
    exceed it. NULL texts are sized and placed like empty ones. Repeated rows are placed each for itself. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = saved(rows.select(
        F.col(id_col).alias("id"),
        (utf8_size(F.col(text_col)) + 8 if size is None else size).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col)).alias("k2"),
    ), "shards")
    n, total = thin.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = int(min(MOST_RANGES, max(8 * n_shards, n // RANGE_ROWS)))
    splitters = _splitters(thin, n_ranges, max(total, 1)) if n else []
    ranged = thin.withColumn("range", range_of(F.col("k1"), splitters) if splitters else F.lit(0))

    # One row per range, at most 2 * MOST_RANGES + 1 of them.
    filled = {r["range"]: r for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    bounds = [-(2**63), *splitters, 2**63 - 1]
    first_row, first_byte, parts, low, width = [], [], [], [], []
    row, byte = 0, 0
    for i in range(len(splitters) + 1):
        rows_in, bytes_in = (filled[i]["n"], filled[i]["b"]) if i in filled else (0, 0)
        over = max(rows_in / RANGE_ROWS, rows_in * n_ranges / max(n, 1) / 1.5, bytes_in * n_ranges / max(total, 1) / 1.5)
        first_row.append(row)
        first_byte.append(byte)
        parts.append(max(1, int(over + 0.999)))
        low.append(bounds[i])
        width.append(float(bounds[i + 1] - bounds[i]))
        row, byte = row + rows_in, byte + bytes_in

    def of_range(values: Column) -> Column:
        return F.element_at(values, F.col("range") + 1)

    # A range of one key is subdivided by the id's hash, any other by its share of the key's range.
    wide = F.expr("array(" + ", ".join(f"{w!r}D" for w in width) + ")")
    in_range = (F.col("k1").cast("decimal(20,0)") - of_range(_longs(low)).cast("decimal(20,0)")).cast("double") / of_range(wide)
    in_key = F.col("k2").cast("double") / float(2**64) + 0.5
    split = F.when(of_range(wide) <= 1.0, in_key).otherwise(in_range)
    part = F.least(F.floor(split * of_range(_longs(parts))), of_range(_longs(parts)) - 1)
    placed = ranged.withColumn("part", F.greatest(part, F.lit(0)))

    cells = placed.groupBy("range", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    earlier = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "range", "part",
        (of_range(_longs(first_row)) + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("row0"),
        (of_range(_longs(first_byte)) + F.coalesce(F.sum("b").over(earlier), F.lit(0))).alias("byte0"),
    )
    inside = Window.partitionBy("range", "part").orderBy("k1", "k2", "id")
    through = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = 2 * (F.col("byte0") + through) - F.col("size")
    shard = F.least(F.floor(middle.cast("decimal(28,0)") * n_shards / (2 * max(total, 1))), F.lit(n_shards - 1))
    numbered = saved(placed.join(cells, ["range", "part"]).select(
        "id", "size", "crc", shard.cast("int").alias("shard"),
        (F.col("row0") + F.row_number().over(inside) - 1).alias("at"),
    ), "shards")
    starts = numbered.groupBy("shard").agg(F.min("at").alias("start"))
    return numbered.join(F.broadcast(starts), "shard").select(  # one row per shard
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("start")).alias("slot")
    )


def write_shards(rows: DataFrame, placed: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """Write whole rows (ids must be unique; one may be NULL) as one Parquet folder per shard; ``slot`` is kept as a column."""
    where = placed.select(F.col(id_col).alias("_placed"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = rows.join(where, F.col(id_col).eqNullSafe(F.col("_placed"))).drop("_placed")
    joined.repartition("_shard", F.expr("_slot div 100000")).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(folder)
