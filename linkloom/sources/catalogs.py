"""Plain and grouped catalog texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import after_comma, before_comma, has_comma, lines, strip
from linkloom.scale import fill_in_order

GENRE = ",#genre#"


def read_docs(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """One row per text file: ``source_id`` is the file, ``content`` its whole text."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("content")
    )


def explode_lines(docs: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Non-blank trimmed lines with their position; a map-only step."""
    return (
        docs.select(*keys, F.posexplode(lines(F.col("content"))).alias("line_no", "line"))
        .select(*keys, F.col("line_no").cast("bigint").alias("line_no"), strip(F.col("line")).alias("line"))
        .filter(F.col("line") != "")
    )


def read_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Non-blank trimmed lines of text files of any size, with a line number that grows along the file.

    Files too large for one cell are read in splits, and a physical line may hold several by rarer line breaks. Their order within a
    task is that of the file, so the number is made of where the split begins and of the place within the task: one
    scan, nothing is moved. Numbers have gaps and 63 bits.
    """
    unit = max(1, min(1 << 20, int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB"))))  # no split is smaller
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_id"), F.floor(F.col("_metadata.file_block_start") / unit).alias("_split"),
        F.explode(lines(F.col("value"))).alias("line"),
    )
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = rows.select("source_id", (F.shiftleft(F.col("_split"), 33) + place).alias("line_no"), strip(F.col("line")).alias("line"))
    return numbered.filter(F.col("line") != "")


def split_entries(raw: DataFrame) -> DataFrame:
    """Cut ``name,url`` lines at the first comma; lines without one have a NULL name and url."""
    line = F.col("line")
    return raw.withColumns(
        {
            "name": F.when(has_comma(line), before_comma(line)),
            "url": F.when(has_comma(line), strip(after_comma(line))),
        }
    )


def read_catalog(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``name,url`` text files as entries in file order."""
    return split_entries(explode_lines(read_docs(spark, paths)))


def read_large_catalog(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """The same for files of any size."""
    return split_entries(read_lines(spark, paths))


def read_plain_text(raw: DataFrame) -> DataFrame:
    """Entries of ``name,url`` lines whose url part starts with http."""
    return split_entries(raw).filter(F.startswith("url", F.lit("http")))


def read_legacy_catalog(raw: DataFrame) -> DataFrame:
    """``category|name,url`` rows."""
    pattern = r"^([^|]*)[|]([^,]*),(.*)$"
    line = F.col("line")
    return raw.filter(line.rlike(pattern)).withColumns(
        {
            "category": strip(F.regexp_extract(line, pattern, 1)),
            "name": F.regexp_extract(line, pattern, 2),
            "url": F.regexp_extract(line, pattern, 3),
        }
    )


def read_grouped_catalog(raw: DataFrame, keys: Sequence[str] = (), order: str = "line_no", **scale) -> DataFrame:
    """Rows under ``category,#genre#`` headers, with ``group_run`` = line number of the header.

    Rows before the first header are dropped, and so are headers without rows.
    """
    line = F.col("line")
    is_header = line.endswith(GENRE)
    header = F.when(
        is_header,
        F.struct(F.col(order).alias("run"), F.replace(line, F.lit(GENRE), F.lit("")).alias("category")),
    )
    filled = fill_in_order(raw, order, header, "_group", keys, **scale)
    rows = split_entries(filled.filter(~is_header & has_comma(line) & F.col("_group").isNotNull()))
    return rows.withColumns({"group_run": F.col("_group.run"), "category": F.col("_group.category")}).drop("_group")
