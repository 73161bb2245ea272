"""Feed change detection between two scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hash", F.md5(F.col("content").cast("binary")))


def latest_scan(scans: DataFrame, key: str = "url", order: str = "scanned_at") -> DataFrame:
    """The newest row per feed, by partial aggregation."""
    rest = [c for c in scans.columns if c != key]
    return scans.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(key, "_s.*")


def compare_feeds(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new state of every feed with ``change``: changed, same, new or missing.

    Both sides have ``url``, ``hash`` and optionally ``etag``; a NULL hash means not fetched.
    """
    def side(df, prefix):
        etag = F.col("etag") if "etag" in df.columns else F.lit(None).cast("string")
        return df.filter("hash IS NOT NULL").select("url", F.col("hash").alias(f"{prefix}_hash"), etag.alias(f"{prefix}_etag"))

    change = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "missing")
        .when(F.col("old_hash") == F.col("new_hash"), "same")
        .otherwise("changed")
    )
    return side(old, "old").join(side(new, "new"), "url", "full_outer").withColumn("change", change)


def feed_changes(compared: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Only the changed feeds, with their short names when given."""
    rows = compared.filter("change = 'changed'")
    if names is not None:
        rows = rows.join(names.select("url", F.col("short_name").alias("name")), "url", "left")
    columns = (["name"] if names is not None else []) + ["url", "old_hash", "new_hash", "old_etag", "new_etag"]
    return rows.select(*columns)


def change_summary(compared: DataFrame) -> DataFrame:
    changed = F.count_if(F.col("change") == "changed")
    verdict = F.when(changed > 0, "CHANGES").otherwise("NO_CHANGES")
    return compared.agg(changed.alias("n_changed"), verdict.alias("verdict"))


def next_state(compared: DataFrame) -> DataFrame:
    """State to keep: the new hash and etag, or the old ones where the fetch failed."""
    return compared.select(
        "url",
        F.coalesce("new_hash", "old_hash").alias("hash"),
        F.when(F.col("new_hash").isNull(), F.col("old_etag")).otherwise(F.col("new_etag")).alias("etag"),
    )
