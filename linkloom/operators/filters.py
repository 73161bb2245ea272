"""Row filters and flags over links, names and probe evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import names, urls
from linkloom.functions.text import SPACES, any_of, contains_any

ADMITTED_SCHEMES = ("http", "https")
PROBED_SCHEMES = ("http", "https", "udp", "rtp", "srt")
VALID_SCHEMES = ("http", "https", "rtmp", "rtmps", "rtsp")


def drop_blacklisted(df: DataFrame, words: Sequence[str] = tuple(rules.BLACKLIST), ignore_case: bool = True) -> DataFrame:
    return df.filter(~names.is_blacklisted(F.col("name"), words, ignore_case))


def drop_private_hosts(df: DataFrame) -> DataFrame:
    return df.filter(~urls.has_non_public_host(F.col("url")))


def drop_vod(df: DataFrame, hosts: Sequence[str] = tuple(rules.VOD_HOSTS), match: str = "contains") -> DataFrame:
    """Drop video-on-demand hosts: by substring, or by whole host and its sub-domains (``suffix``)."""
    return df.filter(~vod_flag(F.col("url"), hosts, match))


def vod_flag(url: Column, hosts: Sequence[str], match: str = "contains") -> Column:
    if match == "suffix":
        return F.lower(urls.netloc(url)).rlike(r"(?:^|\.)" + any_of(h.split(":")[0] for h in hosts) + "$")
    return urls.is_vod(url, hosts)


def rescue_live_names(df: DataFrame, hosts: Sequence[str] = tuple(rules.VOD_HOSTS), match: str = "suffix") -> DataFrame:
    """Drop video-on-demand hosts unless the name has a live-channel word."""
    return df.filter(~vod_flag(F.col("url"), hosts, match) | names.has_live_word(F.col("name")))


def has_scheme(url: Column, schemes: Sequence[str]) -> Column:
    return url.rlike(f"^(?:{'|'.join(schemes)})://")


def keep_schemes(df: DataFrame, schemes: Sequence[str] = ADMITTED_SCHEMES, need_host: bool = False) -> DataFrame:
    keep = has_scheme(F.col("url"), schemes)
    if need_host:
        keep = urls.scheme(F.col("url")).isin(list(schemes)) & (urls.netloc(F.col("url")) != "")
    return df.filter(keep)


def drop_recent(df: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = 6, key: str = "fp") -> DataFrame:
    """Drop links validated within the time to live."""
    return df.join(fresh(cache, now, ttl_hours).select(key).distinct(), key, "left_anti")


def fresh(cache: DataFrame, now: Column, ttl_hours: float = 6) -> DataFrame:
    return cache.filter(F.col("validated_at") >= now - F.make_dt_interval(secs=F.lit(ttl_hours * 3600)))


def keep_playlist_urls(df: DataFrame, legacy: bool = False) -> DataFrame:
    test = urls.is_playlist_legacy if legacy else urls.is_playlist
    return df.filter(test(F.col("url")))


def flag_region(df: DataFrame, words: Sequence[str] = tuple(rules.OVERSEAS_KEYWORDS)) -> DataFrame:
    """Add ``overseas`` and the probe timeout class."""
    return df.withColumn("overseas", names.is_overseas(F.col("name"), words)).withColumn(
        "timeout_s", F.when(F.col("overseas"), 15).otherwise(8).cast("bigint")
    )


def min_quality(df: DataFrame, threshold: int = 0) -> DataFrame:
    return df.filter(F.coalesce("quality", F.lit(0)) >= threshold)


def min_speed(df: DataFrame, mbps: float = 0.001) -> DataFrame:
    return df.filter(F.col("speed") >= mbps)


def resolution(text: Column, legacy: bool = False) -> tuple[Column, Column]:
    """Width and height recorded in probe output; NULL when absent."""
    def sides(pattern):
        return [F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2)]

    if legacy:
        named, pair = sides(r"width=(\d+)\s+height=(\d+)"), sides(r"(\d{3,4})x(\d{3,4})")
    else:
        named = [F.regexp_extract(text, rf"{side}=(\d+)", 1).try_cast("int") for side in ("width", "height")]
        pair = sides(r"^\s*(\d+)x(\d+)\s*$")
    both = named[0].isNotNull() & named[1].isNotNull()
    return tuple(F.when(both, n).otherwise(p) for n, p in zip(named, pair))


def min_resolution(df: DataFrame, text: str = "stdout", width: int = 640, height: int = 480, legacy: bool = False) -> DataFrame:
    w, h = resolution(F.col(text), legacy)
    return df.withColumns({"width": w, "height": h}).filter((F.col("width") >= width) & (F.col("height") >= height))


def large_enough(text: Column, width: int, height: int) -> Column:
    """Whether the recorded resolution reaches both sides; false where none is recorded."""
    w, h = resolution(text)
    return F.coalesce((w >= width) & (h >= height), F.lit(False))


def flag_known_direct(df: DataFrame) -> DataFrame:
    return df.withColumn("known_direct", urls.is_known_direct(F.col("url")))


def flag_ipv6(df: DataFrame) -> DataFrame:
    return df.withColumn("ipv6", urls.is_ipv6(F.col("url")))


def sane_candidates(df: DataFrame, shortest: int = 15, longest: int = 500) -> DataFrame:
    url = F.col("url")
    return df.filter(
        F.length(url).between(shortest, longest) & ~contains_any(F.lower(url), rules.UNSAFE_LINK_MARKS)
    )


def filter_antibot(docs: DataFrame, legacy: bool = False) -> DataFrame:
    """Drop error and bot-check pages, told by marks near the start of the text."""
    content = F.col("content")
    # Only the beginning is trimmed, as to trim the end means to count through the whole text; no mark ends in white space.
    head = F.lower(F.substring(F.ltrim(content, F.lit(SPACES)), 1, 500 if legacy else 200))
    ok = ~contains_any(head, rules.LEGACY_ANTIBOT_MARKS if legacy else rules.ANTIBOT_MARKS)
    if legacy:
        ok = ok & (F.length(content) >= 50)
    return docs.filter(ok)
