"""Queries over feed monitoring and streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkloom.functions.urls import fingerprint
from linkloom.operators import filters, monitoring, publish
from linkloom.queries import sql as q
from linkloom.queries.carriers import ctes, table
from linkloom.queries.curation import BLACKLIST, NO_CACHE, VOD, now
from linkloom.queries.registry import query
from linkloom.scale import shared_dir
from linkloom.streaming.admit import admitted, stream_admit
from linkloom.streaming.dedup import OUTPUT, micros, stream_dedup_ttl
from linkloom.streaming.feeds import feed_changes as feed_changes_so_far
from linkloom.streaming.feeds import stream_feed_changes

SIDES = f"""{ctes('feed')}, h AS (SELECT url, snapshot, md5(arg_max(content, scan_no)) AS hash, concat('W/', max(scan_no)) AS etag FROM feed GROUP BY ALL),
cmp AS (SELECT coalesce(o.url, n.url) AS url, o.hash AS old_hash, o.etag AS old_etag, n.hash AS new_hash, n.etag AS new_etag,
  CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'missing' WHEN o.hash = n.hash THEN 'same' ELSE 'changed' END AS change
  FROM (SELECT * FROM h WHERE snapshot = 0) o FULL OUTER JOIN (SELECT * FROM h WHERE snapshot = 1) n ON o.url = n.url)"""


def _compared(spark, sf):
    scans = table(spark, sf, "feed")
    # Hash first: only 32 characters per scan travel through the shuffle, not the texts.
    hashed = monitoring.content_hash(scans).select("url", "snapshot", "scan_no", "hash")

    def side(n):
        last = monitoring.latest_scan(hashed.filter(F.col("snapshot") == n).drop("snapshot"), order="scan_no")
        return last.withColumn("etag", F.concat(F.lit("W/"), F.col("scan_no").cast("string")))

    return monitoring.compare_feeds(side(0), side(1))


@query("feed_compare", f"{SIDES} SELECT * FROM cmp")
def feed_compare(spark, sf):
    return _compared(spark, sf)


@query("feed_changes", f"{SIDES} SELECT url, old_hash, new_hash, old_etag, new_etag FROM cmp WHERE change = 'changed'")
def feed_changes(spark, sf):
    return monitoring.feed_changes(_compared(spark, sf))


@query("feed_change_summary", f"{SIDES} SELECT count(*) FILTER (change = 'changed') AS n_changed, CASE WHEN count(*) FILTER (change = 'changed') > 0 THEN 'CHANGES' ELSE 'NO_CHANGES' END AS verdict FROM cmp")
def feed_change_summary(spark, sf):
    return monitoring.change_summary(_compared(spark, sf))


@query("feed_state", f"{SIDES} SELECT url, coalesce(new_hash, old_hash) AS hash, CASE WHEN new_hash IS NULL THEN old_etag ELSE new_etag END AS etag FROM cmp")
def feed_state(spark, sf):
    return monitoring.next_state(_compared(spark, sf))


@query("content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return monitoring.content_hash(docs).select("doc_id", "hash")


def _in_steps(spark, slices, schema):
    """Tables as a file stream that reads one after the other, in this order, each as a micro-batch of its own or several."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    most = 1
    for n, rows in enumerate(slices):
        rows.write.parquet(f"{folder}/in/step={n}")
        most = max(most, len(spark.read.parquet(f"{folder}/in/step={n}").inputFiles()))
    # A micro-batch has at most the files of the largest slice, so there are at least as many as slices that are not empty.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return stream, folder


#: Thirds of the event time, in an order that is not that of time.
_DISORDER = [1, 0, 2]


@query("stream_dedup_ttl", """WITH RECURSIVE e AS (SELECT concat('u', user_id, event_type) AS fp, event_id AS seq, epoch_us(ts) AS ts_us FROM events),
f AS (SELECT fp, ts_us, min(seq) AS seq FROM e GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ts_us) AS n FROM f),
nxt AS (SELECT a.fp, a.n, min(b.n) AS m FROM o a JOIN o b ON a.fp = b.fp AND b.ts_us > a.ts_us + 21600000000 GROUP BY ALL),
chain AS (SELECT fp, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT fp FROM o) UNION ALL SELECT nxt.fp, nxt.m FROM chain JOIN nxt ON nxt.fp = chain.fp AND nxt.n = chain.n)
SELECT o.fp, o.seq, o.ts_us, false AS late FROM chain JOIN o ON o.fp = chain.fp AND o.n = chain.n""")
def stream_dedup(spark, sf):
    """Several micro-batches out of order; the last only says that the time has gone on."""
    keyed = table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), "event_type").alias("fp"),
        F.col("event_id").alias("seq"), micros("ts").alias("ts_us"),
    )
    low, high = keyed.agg(F.min("ts_us"), F.max("ts_us")).first()
    span = high - low + 1
    third = F.floor((F.col("ts_us") - low) * len(_DISORDER) / span)
    slices = [keyed.filter(third == k) for k in _DISORDER]
    hours = span / 3_600_000_000
    mark = spark.range(1).select(F.lit(None).cast("string").alias("fp"), F.lit(None).cast("bigint").alias("seq"), F.lit(high + 4 * span).alias("ts_us"))
    stream, folder = _in_steps(spark, [*slices, mark], keyed.schema)
    stream_dedup_ttl(stream, 6, lateness_hours=hours, buckets=16).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out")


# Scans of the feeds in three micro-batches, the second after the third; every seventh scan has failed.
_SCANS = f"""{ctes('feed')}, s AS (SELECT url, scan_no, CASE WHEN scan_no % 7 <> 3 THEN md5(content) END AS hash,
  CASE WHEN scan_no % 5 < 2 THEN 0 WHEN scan_no % 5 = 2 THEN 2 ELSE 1 END AS step FROM feed)"""


def _scans(spark, sf):
    """The scans of each step, in the order of arrival."""
    hashed = monitoring.content_hash(table(spark, sf, "feed"))
    failing = hashed.select("url", "scan_no", F.when(F.col("scan_no") % 7 != 3, F.col("hash")).alias("hash"))
    rest = F.col("scan_no") % 5
    step = F.when(rest < 2, 0).when(rest == 2, 2).otherwise(1)
    return [failing.filter(step == k) for k in range(3)]


@query("stream_feed_changes", f"""{_SCANS}, good AS (SELECT * FROM s WHERE hash IS NOT NULL),
w AS (SELECT *, max(scan_no) OVER (PARTITION BY url ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM good),
l AS (SELECT url, scan_no, lag(hash) OVER (PARTITION BY url ORDER BY step, scan_no) AS old_hash, hash AS new_hash FROM w WHERE newest IS NULL OR scan_no > newest)
SELECT * FROM l WHERE old_hash <> new_hash""")
def stream_changes(spark, sf):
    slices = _scans(spark, sf)
    stream, folder = _in_steps(spark, slices, slices[0].schema)
    state = publish.feed_table(spark, f"{folder}/state", parts=8)
    stream_feed_changes(stream, f"{folder}/out", f"{folder}/log", state).awaitTermination()
    return feed_changes_so_far(f"{folder}/out", state).select("url", "scan_no", "old_hash", "new_hash")


@query("stream_admit", f"{NO_CACHE} SELECT source_rank, line_no, name, url, fp, {q.host('url')} AS host FROM accepted")
def streamed_admission(spark, sf):
    """Four micro-batches in the order of the entries, against a cache that they fill."""
    raw = table(spark, sf, "raw")
    slices = [raw.filter(F.col("source_rank") == k) for k in range(5)]
    stream, folder = _in_steps(spark, slices, raw.schema)
    cache = publish.cache_table(spark, f"{folder}/cache", parts=8)
    stream_admit(stream, f"{folder}/out", f"{folder}/log", cache, now(), 6, BLACKLIST, VOD).awaitTermination()
    return admitted(f"{folder}/out", cache)


@query("cache_upsert_parts", f"""{ctes('catalog')}, v AS (SELECT DISTINCT {q.fp('url')} AS fp, quality FROM catalog WHERE url IS NOT NULL),
s AS (SELECT fp, TIMESTAMPTZ '2024-01-01 01:00:00+00' AS t FROM v WHERE quality < 50 UNION ALL SELECT fp, TIMESTAMPTZ '2024-01-01 08:00:00+00' FROM v WHERE quality % 7 = 0),
parts AS (SELECT fp, max(t) AS validated_at FROM s GROUP BY 1)
SELECT fp, epoch_us(validated_at) AS validated_us FROM parts WHERE validated_at >= TIMESTAMPTZ '2024-01-01 02:00:00+00'""")
def cache_upsert_parts(spark, sf):
    """Stamps of two runs in a cache that is changed part by part; a repeated run changes nothing."""
    fps = table(spark, sf, "catalog").select(fingerprint(F.col("url")).alias("fp"), "quality")
    cache = publish.cache_table(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", parts=8)
    runs = [("2024-01-01 01:00:00", F.col("quality") < 50), ("2024-01-01 08:00:00", F.col("quality") % 7 == 0)]
    for number, (at, which) in enumerate([*runs, runs[0]]):
        publish.stamp(cache, fps.filter(which), F.lit(at).cast("timestamp"), 6, "daily", number % 2)
    return filters.fresh(cache.read(), now(), 6).select("fp", F.unix_micros("validated_at").alias("validated_us"))


@query("feed_state_parts", f"""{_SCANS} SELECT url, max(scan_no) AS scan_no, arg_max(hash, scan_no) AS hash FROM s WHERE hash IS NOT NULL GROUP BY url""")
def feed_state_parts(spark, sf):
    state = publish.feed_table(spark, f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}", parts=8)
    for number, scans in enumerate(_scans(spark, sf)):
        publish.write_feed_scan(state, scans.withColumn("etag", F.lit(None).cast("string")), "scan", number)
    return state.read().drop("etag")
