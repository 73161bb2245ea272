"""Streaming admission: the batch tests on every row, and a cache of what was admitted that streams share."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom import rules
from linkloom.functions import urls
from linkloom.operators import filters
from linkloom.operators.admission import SEQ, sound_entries
from linkloom.operators.publish import cache_table, stamp
from linkloom.scale import top_per_key
from linkloom.sources.statetables import StateTable

ADMITTED_SCHEMA = "source_rank long, line_no long, name string, url string, fp string, host string"
_COLUMNS = [c.split()[0] for c in ADMITTED_SCHEMA.split(", ")]


def admitted(path: str, cache: StateTable) -> DataFrame:
    """Entries admitted so far below ``path``: those of the micro-batches that ``cache`` has committed."""
    return cache.output(path, ADMITTED_SCHEMA)


def admit_batch(
    rows: DataFrame, number: int, path: str, cache: StateTable, at: Column, ttl_hours: float = 6,
    blacklist: Sequence[str] = tuple(rules.BLACKLIST), vod_hosts: Sequence[str] = tuple(rules.VOD_HOSTS),
) -> None:
    """Admit one micro-batch: the first sound entry of every fingerprint that the cache does not hold as recent.

    What is admitted is written to a folder of the batch, then stamped in the cache; the stamp commits both. A batch that was
    committed before changes nothing, and one whose run was lost before the commit is written anew.
    """
    if cache.applied(path) >= number:
        return
    sound = sound_entries(rows, blacklist, vod_hosts)
    first = top_per_key(sound, ["fp"], [F.col(c) for c in SEQ], 1)
    new = filters.drop_recent(first, cache.read(), at, ttl_hours).withColumn("host", urls.host(F.col("url")))
    typed = new.select(*[F.col(c).cast("bigint") if c in SEQ else F.col(c) for c in _COLUMNS])
    folder = f"{path}/batch={number}"
    typed.write.mode("overwrite").parquet(folder)
    stamp(cache, rows.sparkSession.read.schema(ADMITTED_SCHEMA).parquet(folder), at, ttl_hours, path, number)


def stream_admit(
    stream: DataFrame, path: str, checkpoint: str, cache: StateTable | None = None, now: Column | None = None, ttl_hours: float = 6,
    blacklist: Sequence[str] = tuple(rules.BLACKLIST), vod_hosts: Sequence[str] = tuple(rules.VOD_HOSTS),
) -> StreamingQuery:
    """Admit a stream of lines or entries (``source_rank``, ``line_no``, ``name``, ``url``) into the table below ``path``.

    Every micro-batch reads the cache anew, so a fingerprint is not admitted again within ``ttl_hours``, whichever stream with
    that cache admitted it, and the stamps of a batch are seen by all streams once it is committed. Stamps that are
    older go when their part of the cache is next written. ``now`` is the time of admission, else that of the batch.
    """
    cache = cache or cache_table(stream.sparkSession, f"{path}/_cache")

    def admit(rows: DataFrame, number: int) -> None:
        at = F.lit(datetime.datetime.now(datetime.timezone.utc)) if now is None else now
        admit_batch(rows, number, path, cache, at, ttl_hours, blacklist, vod_hosts)

    return stream.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
