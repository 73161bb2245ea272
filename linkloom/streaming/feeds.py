"""Streaming feed change detection: each micro-batch compares its scans natively, and the state gives what came before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.publish import feed_table, write_feed_scan
from linkloom.scale import lag_in_order, materialize
from linkloom.sources.statetables import StateTable

CHANGES_SCHEMA = "url string, scan_no long, old_hash string, new_hash string, old_etag string, new_etag string"


def changes_in_batch(scans: DataFrame, before: DataFrame) -> DataFrame:
    """Changes among ``scans``, in scan order per feed, starting from the feeds' last scans in ``before``.

    Scans without a hash have failed: they neither change a feed nor hide the scan before them. A scan that is not newer
    than the feed's last one is ignored; of scans with the same number the smallest hash counts.
    """
    last = before.select(F.col("url").alias("_url"), F.col("scan_no").alias("_no"), F.struct("hash", "etag").alias("_before"))
    good = scans.filter("hash is not null").groupBy("url", "scan_no").agg(F.min(F.struct("hash", "etag")).alias("scan"))
    newer = good.join(last, F.col("url") == F.col("_url"), "left").filter("_no is null or scan_no > _no").drop("_url", "_no")
    lagged = lag_in_order(newer, "scan_no", F.col("scan"), "_lag", ["url"])
    old = F.coalesce("_lag", "_before")
    return lagged.withColumn("old", old).filter(F.col("old.hash") != F.col("scan.hash")).select(
        "url", "scan_no", F.col("old.hash").alias("old_hash"), F.col("scan.hash").alias("new_hash"),
        F.col("old.etag").alias("old_etag"), F.col("scan.etag").alias("new_etag"),
    )


def feed_changes(path: str, state: StateTable) -> DataFrame:
    """Changes found so far below ``path``: those of committed micro-batches."""
    return state.output(path, CHANGES_SCHEMA)


def compare_batch(scans: DataFrame, number: int, path: str, state: StateTable) -> None:
    """One micro-batch: write its changes, then bring its last scans into the state, which commits both. A batch committed before
    changes nothing."""
    if state.applied(path) >= number:
        return
    etag = F.col("etag").cast("string") if "etag" in scans.columns else F.lit(None).cast("string")
    slim = materialize(scans.select("url", F.col("scan_no").cast("bigint").alias("scan_no"), "hash", etag.alias("etag")))
    changes_in_batch(slim, state.near(slim)).write.mode("overwrite").parquet(f"{path}/batch={number}")
    write_feed_scan(state, slim, path, number)


def stream_feed_changes(scans: DataFrame, path: str, checkpoint: str, state: StateTable | None = None) -> StreamingQuery:
    """Write the changes in a stream of scans (``url``, ``scan_no``, ``hash`` and, if there, ``etag``) below ``path``.

    The state of a feed is its last scan that did not fail. It may be shared with batch runs, and a feed that a micro-batch does
    not scan is not rewritten.
    """
    state = state or feed_table(scans.sparkSession, f"{path}/_state")

    def compare(rows: DataFrame, number: int) -> None:
        compare_batch(rows, number, path, state)

    return scans.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
