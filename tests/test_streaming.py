"""Streaming jobs fed in several micro-batches give what one batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions.urls import fingerprint
from linkloom.operators.admission import admit
from linkloom.operators.publish import cache_table, feed_table, stamp
from linkloom.streaming.admit import admit_batch, admitted, stream_admit
from linkloom.streaming.dedup import stream_dedup_ttl
from linkloom.streaming.feeds import compare_batch, feed_changes, stream_feed_changes


def write_parts(spark, rows, schema, folder, n):
    """One file per step, so that a file stream reads them as separate micro-batches."""
    for i in range(n):
        part = rows[i * len(rows) // n:(i + 1) * len(rows) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def drain(df, folder):
    df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start().awaitTermination()


def dedup_by_hand(rows, ttl):
    want, last = set(), {}
    for fp, seq, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if fp not in last or t - last[fp] > ttl:
            last[fp] = t
            want.add((fp, seq))
    return want


HOUR = 3_600_000_000
DEDUP = "fp string, seq long, ts_us long"


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 0, 2, 1]])
def test_dedup_ttl_in_any_order(spark, tmp_path, order):
    rnd = random.Random(9)
    times = sorted(rnd.randrange(0, 80 * HOUR) for _ in range(300))
    # One key holds a third of the rows.
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randrange(5)}", i, t) for i, t in enumerate(times)]
    parts = [rows[i * 75:(i + 1) * 75] for i in order] + [[(None, None, 1000 * HOUR)]]
    for part in parts:
        spark.createDataFrame(part, DEDUP).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(DEDUP).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drain(stream_dedup_ttl(stream, 6, lateness_hours=81, buckets=4), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.fp, r.seq) for r in got} == dedup_by_hand(rows, 6 * HOUR) and not any(r.late for r in got)


def test_late_rows_are_marked_not_lost(spark, tmp_path):
    parts = [[("k1", 1, 10 * HOUR), ("k2", 2, 40 * HOUR)], [("k2", 3, 80 * HOUR)], [("k3", 4, HOUR), ("k1", 5, 30 * HOUR), ("k2", 6, 79 * HOUR), ("k2", 7, 41 * HOUR)],
             [(None, None, 900 * HOUR)]]
    for part in parts:
        spark.createDataFrame(part, DEDUP).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(DEDUP).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drain(stream_dedup_ttl(stream, 6), tmp_path)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("seq", "late").collect()}
    # 7 is within the time to live of 2; 6 is late but first, and 3, which still waited, is then within the time to live of 6.
    assert {(1, False), (2, False), (4, True), (5, True)} <= got and (7, True) not in got and len(got) == 5


def test_dedup_state_goes_after_its_time(spark, tmp_path):
    rows = [(f"k{i}", i, (i + 1) * HOUR) for i in range(60)]
    write_parts(spark, rows, DEDUP, f"{tmp_path}/in", 10)
    stream = spark.readStream.schema(DEDUP).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_dedup_ttl(stream, 6, buckets=4096).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 59  # the newest still waits
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 2 * 30  # a bucket and its timer each


@pytest.mark.parametrize("parts", [1, 4])
def test_feed_changes(spark, tmp_path, parts):
    rnd = random.Random(4)
    rows = [(f"u{rnd.randrange(4)}", i, rnd.choice(["a", "b", "c", None])) for i in range(60)]
    write_parts(spark, rows, "url string, scan_no long, hash string", f"{tmp_path}/in", parts)
    stream = spark.readStream.schema("url string, scan_no long, hash string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state = feed_table(spark, f"{tmp_path}/state", parts=8)
    stream_feed_changes(stream, f"{tmp_path}/out", f"{tmp_path}/log", state).awaitTermination()
    got = {tuple(r) for r in feed_changes(f"{tmp_path}/out", state).select("url", "scan_no", "old_hash", "new_hash").collect()}
    want, last = set(), {}
    for url, no, h in rows:
        if h is None:
            continue
        if url in last and last[url] != h:
            want.add((url, no, last[url], h))
        last[url] = h
    assert got == want
    assert {r.url: r.hash for r in state.read().collect()} == last


def test_failed_scans_change_nothing(spark, tmp_path):
    schema = "url string, scan_no long, hash string, etag string"
    for i, h in enumerate(["a", None, None, "a"]):
        spark.createDataFrame([("u", i, h, f"e{i}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state = feed_table(spark, f"{tmp_path}/state")
    stream_feed_changes(stream, f"{tmp_path}/out", f"{tmp_path}/log", state).awaitTermination()
    assert feed_changes(f"{tmp_path}/out", state).count() == 0
    assert tuple(state.read().first()) == ("u", 3, "a", "e3")


def test_older_scans_are_ignored(spark, tmp_path):
    schema = "url string, scan_no long, hash string, etag string"
    for part in ([("u", 1, "a", "1"), ("u", 5, "b", None)], [("u", 3, "z", "2"), ("u", 6, "b", "3")], [("u", 7, "c", "4"), ("v", 1, "x", None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state = feed_table(spark, f"{tmp_path}/state")
    stream_feed_changes(stream, f"{tmp_path}/out", f"{tmp_path}/log", state).awaitTermination()
    got = sorted(tuple(r) for r in feed_changes(f"{tmp_path}/out", state).select("scan_no", "old_hash", "new_hash", "old_etag", "new_etag").collect())
    assert got == [(5, "a", "b", "1", None), (7, "b", "c", "3", "4")]


def test_a_feed_batch_is_committed_once(spark, tmp_path):
    schema = "url string, scan_no long, hash string"
    state = feed_table(spark, f"{tmp_path}/state")
    first, second = spark.createDataFrame([("u", 1, "a")], schema), spark.createDataFrame([("u", 2, "b")], schema)
    for rows, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        compare_batch(rows, number, f"{tmp_path}/out", state)
    assert [tuple(r)[:4] for r in feed_changes(f"{tmp_path}/out", state).collect()] == [("u", 2, "a", "b")]
    assert state.manifest()["version"] == 2


def test_admission_keeps_to_the_cache(spark, tmp_path):
    schema = "source_rank long, line_no long, line string"
    spark.createDataFrame([(0, 1, "a,http://h/1"), (0, 2, "b,http://h/2"), (0, 3, "no comma")], schema).write.parquet(f"{tmp_path}/in")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    cache = cache_table(spark, f"{tmp_path}/cache")
    old = spark.createDataFrame([("2024-01-01 11:00:00", "http://h/1"), ("2024-01-01 01:00:00", "http://h/2")], "at string, url string")
    for at in ("2024-01-01 11:00:00", "2024-01-01 01:00:00"):
        stamp(cache, old.filter(F.col("at") == at).select(fingerprint(F.col("url")).alias("fp")), F.lit(at).cast("timestamp"))
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    stream_admit(stream, f"{tmp_path}/out", f"{tmp_path}/log", cache, now, 6).awaitTermination()
    assert [r.name for r in admitted(f"{tmp_path}/out", cache).collect()] == ["b"]
    # Another stream with the same cache sees what the first one admitted; hours later all may come again.
    stream_admit(stream, f"{tmp_path}/out2", f"{tmp_path}/log2", cache, now, 6).awaitTermination()
    assert admitted(f"{tmp_path}/out2", cache).count() == 0
    later = F.lit("2024-01-01 18:30:00").cast("timestamp")
    stream_admit(stream, f"{tmp_path}/out3", f"{tmp_path}/log3", cache, later, 6).awaitTermination()
    assert admitted(f"{tmp_path}/out3", cache).count() == 2


def test_an_admitted_batch_is_committed_once(spark, tmp_path):
    schema = "source_rank long, line_no long, name string, url string"
    rows = spark.createDataFrame([(0, 1, "a", "http://h/1"), (0, 2, "b", "http://h/1")], schema)
    at = F.lit("2024-01-01 12:00:00").cast("timestamp")
    cache, path = cache_table(spark, f"{tmp_path}/cache"), f"{tmp_path}/out"
    for _ in range(2):
        admit_batch(rows, 0, path, cache, at)
    assert [r.name for r in admitted(path, cache).collect()] == ["a"] and cache.manifest()["version"] == 1
    # A batch whose run was lost before the commit left files behind: they do not count, and are written anew.
    rows.filter("line_no = 2").withColumns({"fp": F.lit("x"), "host": F.lit("h")}).write.parquet(f"{path}/batch=1")
    assert admitted(path, cache).count() == 1
    admit_batch(spark.createDataFrame([(0, 3, "c", "http://h/3")], schema), 1, path, cache, at)
    assert sorted(r.name for r in admitted(path, cache).collect()) == ["a", "c"]


def test_admit_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(0, i, f"n{i}", f"http://h{rnd.randrange(15)}/{rnd.randrange(3)}") for i in range(90)]
    schema = "source_rank long, line_no long, name string, url string"
    write_parts(spark, rows, schema, f"{tmp_path}/in", 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    cache = cache_table(spark, f"{tmp_path}/cache")
    stream_admit(stream, f"{tmp_path}/out", f"{tmp_path}/log", cache).awaitTermination()
    batch = admit(spark.createDataFrame(rows, schema))
    assert sorted(r.line_no for r in admitted(f"{tmp_path}/out", cache).collect()) == sorted(r.line_no for r in batch.collect())
