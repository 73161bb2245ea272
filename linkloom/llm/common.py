"""Helpers shared by the operators: tables cut off from their lineage, bounded label samples, free column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.scale import shared_dir


#: Rows turned into Python objects at once.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder all executors reach, below ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: no recomputation, no lineage to lose."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(stem: str, *dfs: DataFrame) -> str:
    """``stem``, with underscores added until no table has a column of that name (in any case)."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def map_rows(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterable[dict]]) -> DataFrame:
    """``work`` turns batches (column name to Python list) into batches of ``schema``, in Arrow-carried partitions."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(i, SLICE).to_pydict() for b in batches for i in range(0, b.num_rows, SLICE))
        for out in work(small):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def bounded_slices(batch: pa.RecordBatch, rows: int = SLICE, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, of at most ``rows`` rows and ``most_bytes`` bytes of strings (one row, if that is longer)."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = min(max(int(np.searchsorted(ends, before + most_bytes, "right")), start + 1), start + rows)
        yield batch.slice(start, end - start)
        start = end


def map_texts(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterable[dict]], most_bytes: int = 1 << 20) -> DataFrame:
    """As ``map_rows``, with slices bounded in bytes too, for long texts."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (s.to_pydict() for b in batches for s in bounded_slices(b, most_bytes=most_bytes))
        for out in work(small):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, wanted: Callable[[list], np.ndarray], most_bytes: int = 1 << 20) -> DataFrame:
    """The rows of ``df``, all columns as they are, for whose ``column`` values ``wanted`` is true. Rows stay in Arrow; only
    that column of a slice bounded in rows and bytes becomes Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            for s in bounded_slices(b, most_bytes=most_bytes):
                yield s.filter(pa.array(np.asarray(wanted(s.column(at).to_pylist()), dtype=bool)))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fraction_hash(*cols: Column) -> Column:
    """A repeatable pseudo-random number in [0, 1) from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """All labels that may be learned from, chosen as in ``labelled_sample``: doc_id, y."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` training documents (doc_id, text, y), chosen by a hash of the id.

    Held-out ids, NULL labels and NULL texts are left out; a document labelled twice counts once, as its
    larger label. ``max_rows`` bounds the labels broadcast here (16 bytes each) and all that is fitted on.
    """
    usable = usable_labels(labels, label)
    total = usable.count()
    share = min(1.0, max_rows / max(total, 1))
    chosen = usable.filter(fraction_hash(F.col("doc_id"), F.lit("labels")) < share)
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
