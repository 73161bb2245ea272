"""Streaming deduplication with a time to live, in the order of event time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Python workers get this module with the tasks, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "fp string, seq long, ts_us long, late boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """State of queries started from now on lies on local disks, backed by the checkpoint; keyed processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _earliest_per_instant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the rows with the same fingerprint and time, only the smallest ``seq`` can be emitted."""
    for batch in batches:
        yield batch.sort_values("seq").drop_duplicates(["fp", "ts_us"])


def _packed(columns: dict[str, list], schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.table(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, list]:
    return pa.ipc.open_stream(data).read_all().to_pydict()


_LAST = pa.schema([("fp", pa.string()), ("last_us", pa.int64())])
_WAITING = pa.schema([("fp", pa.string()), ("ts_us", pa.int64()), ("seq", pa.int64())])


class FirstPerTtl(StatefulProcessor):
    """Keeps a bucket of fingerprints: when each was last emitted, and the rows that the watermark has not passed yet."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "last binary, waiting binary, timer_ms long")

    def _load(self) -> tuple[dict[str, int], list[tuple], int | None]:
        kept = self.state.get() if self.state.exists() else None
        if kept is None:
            return {}, [], None
        last, waiting = _unpacked(kept[0]), _unpacked(kept[1])
        return dict(zip(last["fp"], last["last_us"])), list(zip(waiting["fp"], waiting["ts_us"], waiting["seq"])), kept[2]

    def _store(self, last: dict[str, int], waiting: list[tuple], timer: int | None, watermark: int) -> None:
        # A fingerprint is forgotten once no row in time could fall within its time to live.
        last = {fp: at for fp, at in last.items() if at + self.ttl_us >= watermark * 1000}
        due = min((t for _, t, _ in waiting), default=None)
        if due is None and last:
            due = max(last.values()) + self.ttl_us
        wanted = None if due is None else max(due // 1000 + 1, watermark + 1)
        if timer is not None and timer != wanted and timer > watermark:
            self.handle.deleteTimer(timer)
        if wanted is None:
            self.state.clear()
            return
        if wanted != timer:
            self.handle.registerTimer(wanted)
        fps, times, seqs = zip(*waiting) if waiting else ((), (), ())
        self.state.update((
            _packed({"fp": list(last), "last_us": list(last.values())}, _LAST),
            _packed({"fp": list(fps), "ts_us": list(times), "seq": list(seqs)}, _WAITING), wanted,
        ))

    def _settle(self, last: dict[str, int], waiting: list[tuple], watermark: int) -> tuple[list[tuple], list[tuple]]:
        """Rows that the watermark has passed, judged in order of time; and those that still wait."""
        out = []
        for fp, at, seq in sorted(w for w in waiting if w[1] // 1000 < watermark):
            before = last.get(fp)
            if before is None or at > before + self.ttl_us:
                last[fp] = at
                out.append((fp, seq, at, False))
        return out, [w for w in waiting if w[1] // 1000 >= watermark]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), 0)
        last, waiting, timer = self._load()
        out, waiting = self._settle(last, waiting, watermark)
        late = []
        for batch in rows:
            for fp, seq, at in zip(batch["fp"], batch["seq"].tolist(), batch["ts_us"].tolist()):
                if isinstance(fp, str):
                    (waiting if at // 1000 >= watermark else late).append((fp, at, seq))
        for fp, at, seq in sorted(late):
            # Too late for its place in the order: judged by what is still known of its fingerprint, and marked.
            before = last.get(fp)
            if before is None or abs(at - before) > self.ttl_us:
                last[fp] = at if before is None else max(at, before)
                out.append((fp, seq, at, True))
        self._store(last, waiting, timer, watermark)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        last, waiting, _ = self._load()
        out, waiting = self._settle(last, waiting, watermark)
        self._store(last, waiting, None, watermark)
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    fp, seq, at, late = zip(*rows) if rows else ((), (), (), ())
    return pd.DataFrame({
        "fp": pd.Series(fp, dtype=object), "seq": pd.Series(seq, dtype="int64"), "ts_us": pd.Series(at, dtype="int64"),
        "late": pd.Series(late, dtype=bool),
    })


def stream_dedup_ttl(stream: DataFrame, ttl_hours: float = 6, lateness_hours: float = 0, buckets: int = 64) -> DataFrame:
    """Rows (``fp``, ``seq``, ``ts_us``, ``late``) of a stream that are first within their time to live.

    Rows are judged in order of event time, however they arrive: each waits until the newest time seen is more than
    ``lateness_hours`` ahead of it. A row that comes later than that is not lost: it is emitted as ``late`` unless its fingerprint is
    known to have been emitted within the time to live of it. Rows without a fingerprint are marks: they only move the time on, so that
    the end of a stream can be told. Of rows with the same fingerprint and time the smallest ``seq`` counts.

    Fingerprints are kept in ``buckets``, whose state holds the last emission of each fingerprint until the watermark has passed its
    time to live, and the waiting rows; a timer wakes a bucket when one is due. A bucket is rewritten when it gets rows, so there should be
    several for each core of the cluster, and as many for as long as the query lives. Each partition drops repeats of an instant
    before the shuffle.
    """
    use_rocksdb(stream.sparkSession)
    slim = stream.select("fp", "seq", "ts_us").mapInPandas(_earliest_per_instant, "fp string, seq long, ts_us long")
    timed = slim.withColumn("_ts", F.timestamp_micros("ts_us")).withWatermark("_ts", f"{int(lateness_hours * 3600)} seconds")
    # Without its time column the processor gets late rows too; the watermark goes on from the node below.
    keyed = timed.select(F.pmod(F.xxhash64("fp"), F.lit(buckets)).alias("bucket"), "fp", "seq", "ts_us")
    return keyed.groupBy("bucket").transformWithStateInPandas(
        FirstPerTtl(int(ttl_hours * 3_600_000_000)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(F.col(ts).cast("timestamp"))
