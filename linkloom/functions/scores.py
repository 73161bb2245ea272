"""Scoring column expressions over recorded probe evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ladder(c: Column, steps, default: int, ascending: bool) -> Column:
    out = None
    for bound, points in steps:
        hit = c <= bound if ascending else c >= bound
        out = F.when(hit, points) if out is None else out.when(hit, points)
    return out.otherwise(default)


def quality_base(content_length: Column) -> Column:
    """50 points, 10 more above 500,000 bytes and 20 more above 1,000,000."""
    bonus = F.when(content_length > 1_000_000, 20).when(content_length > 500_000, 10).otherwise(0)
    return F.least(F.lit(50) + bonus, F.lit(100)).cast("bigint")


def quality_ladder(latency_s: Column, speed_mbps: Column) -> Column:
    """Up to 60 points for latency and 40 for speed."""
    base = _ladder(latency_s, [(1, 60), (3, 50), (5, 40), (10, 30), (15, 20)], 10, True)
    extra = _ladder(speed_mbps, [(2, 40), (1, 30), (0.2, 20), (0.05, 10)], 5, False)
    return F.least(base + extra, F.lit(100)).cast("bigint")


def speed_bonus(quality: Column, speed_mbps: Column, capped: bool = True) -> Column:
    out = quality + (speed_mbps * 10).cast("bigint")
    return F.least(out, F.lit(100)) if capped else out


def throughput(n_bytes: Column, elapsed_s: Column, legacy: bool = False) -> Column:
    """MB per second; zero when nothing was measured.

    The legacy form rounds to four places and knows no guard but that of its size: from 1024 bytes on, no time at all is an
    infinite rate and what is unknown stays unknown.
    """
    size = n_bytes.cast("double") / 1024 / 1024
    if legacy:
        rate = F.when(elapsed_s == 0, float("inf")).otherwise(size / F.nullif(elapsed_s, F.lit(0)))
        return F.when(n_bytes < 1024, 0.0).otherwise(F.round(rate, 4))
    return F.coalesce(F.when(elapsed_s > 0, size / elapsed_s).otherwise(0.0), F.lit(0.0))


def default_quality(quality: Column, floor: int = 0) -> Column:
    return F.coalesce(F.nullif(quality, F.lit(0)), F.lit(floor)).cast("bigint")
