"""Jobs over recorded probe evidence. Probing itself happens elsewhere; its results are a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import scores, urls
from linkloom.functions.text import contains_any, strip
from linkloom.scale import running_sums

GOOD = (200, 206)


def media_type(head: Column, strict: bool = True) -> Column:
    """M3U8, TS, FLV or MP4 by the first bytes; ``unknown`` otherwise.

    ``head`` is BINARY. A transport stream shows a sync byte within its first 188 bytes (a ranged read may start inside a
    packet), and again 188 bytes later where the head reaches so far. Non-strict accepts any payload of 16 bytes as one.
    """
    digits = F.hex(head)

    def starts(text: str, at: int = 0):
        code = text.encode().hex().upper()
        return F.substring(digits, 1 + 2 * at, len(code)) == code

    sync = rf"^(?:..){{0,187}}?47(?:(?:..){{187}}47|(?!(?:..){{188}}))"
    ts = digits.rlike(sync) if strict else F.lit(True)
    return (
        F.when(F.octet_length(head) < 16, "unknown")
        .when(starts("#EXTM3U"), "m3u8")
        .when(starts("FLV"), "flv")
        .when(starts("ftyp", 4), "mp4")
        .when(ts, "ts")
        .otherwise("unknown")
    )


def classify_payload(probes: DataFrame, strict: bool = True) -> DataFrame:
    return probes.withColumn("media_type", media_type(F.col("head"), strict))


def fatal_stderr(stderr: Column) -> Column:
    return contains_any(F.lower(stderr), rules.FATAL_PHRASES)


def has_stream(stdout: Column) -> Column:
    return contains_any(F.lower(stdout), rules.STREAM_MARKS)


def flag_fatal(probes: DataFrame, stderr: str = "stderr", stdout: str = "stdout") -> DataFrame:
    """Add ``fatal``: an error phrase in stderr, or no audio or video stream in stdout."""
    dead = fatal_stderr(F.coalesce(F.col(stderr), F.lit(""))) | ~has_stream(F.coalesce(F.col(stdout), F.lit("")))
    return probes.withColumn("fatal", dead)


def alive(strict: bool = True, min_bytes: int = 512) -> Column:
    """First-stage verdict: good status, enough bytes, not an HTML page, media payload."""
    head = F.col("head")
    is_list = F.substring(F.hex(head), 1, 14) == b"#EXTM3U".hex().upper()
    html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    return F.coalesce(
        F.col("status").isin(*GOOD)
        & (F.col("bytes") >= min_bytes)
        & ~(html & ~is_list)
        & (media_type(head, strict) != "unknown"),
        F.lit(False),
    )


def evaluate_probe(probes: DataFrame, strict: bool = True, min_bytes: int = 512) -> DataFrame:
    """Add ``alive`` and ``quality`` (NULL for dead links)."""
    out = probes.withColumn("alive", alive(strict, min_bytes))
    return out.withColumn("quality", F.when(F.col("alive"), scores.quality_base(F.col("content_length"))))


def apply_speed(df: DataFrame, min_mbps: float = 0.001, capped: bool = True) -> DataFrame:
    """Drop slow links and add the speed bonus to the quality of the others."""
    kept = df.filter(F.col("speed") >= min_mbps)
    return kept.withColumn("quality", scores.speed_bonus(F.col("quality"), F.col("speed"), capped))


def speed_counts(df: DataFrame, min_mbps: float = 0.001) -> DataFrame:
    return df.agg(
        F.count_if(F.col("speed") >= min_mbps).alias("kept"), F.count_if(F.col("speed") < min_mbps).alias("removed")
    )


def evaluate_second_probe(df: DataFrame, max_status: int = 500) -> DataFrame:
    """Add ``direct_ok``: pass-through schemes and hosts, then the recorded status."""
    url = F.col("url")
    ok = (
        F.when(F.coalesce(url, F.lit("")) == "", False)
        .when(url.rlike("^(?:udp|rtp|srt)://"), True)
        .when(urls.is_known_direct(url), True)
        .when(contains_any(url, rules.CARRIER_IPV6_MARKS), True)
        .when(F.col("status").isin(*GOOD), True)
        .otherwise(F.coalesce(F.col("status") < max_status, F.lit(False)))
    )
    return df.withColumn("direct_ok", ok)


def evaluate_probe_legacy(
    df: DataFrame, speed_check: bool = True, min_mbps: float = 0.001, name_length: int | None = None
) -> DataFrame:
    """Earlier verdict: IPv6 hosts score 100, else stream evidence, else the HTTP status.

    Uses ``stderr``/``stdout`` of the stream probe, ``status`` of HEAD, ``get_status`` of the GET
    fallback, ``elapsed_s`` and ``speed``. Adds ``alive``, ``quality`` and ``reason``; ``name_length`` cuts names, as was done.
    """
    stream_ok = has_stream(F.coalesce("stdout", F.lit(""))) & ~fatal_stderr(F.coalesce("stderr", F.lit("")))
    http_ok = F.coalesce(F.col("status").isin(200, 206, 301, 302, 304), F.lit(False)) | F.coalesce(
        F.col("get_status").isin(*GOOD), F.lit(False)
    )
    ipv6 = urls.is_ipv6(F.col("url"))
    reached = stream_ok | http_ok
    slow = F.lit(speed_check) & (F.coalesce("speed", F.lit(0.0)) < min_mbps)
    speed = F.coalesce("speed", F.lit(0.0)) if speed_check else F.lit(1.0)
    score = scores.quality_ladder(F.round("elapsed_s", 2), speed)
    reason = (
        F.when(ipv6, None)
        .when(~reached & F.col("status").isNull(), "unreachable")
        .when(~reached, F.concat(F.lit("http "), F.coalesce("get_status", "status").cast("string")))
        .when(slow, "slow")
    )
    name = F.col("name") if name_length is None else F.substring("name", 1, name_length)
    out = df.withColumns({"name": name, "reason": reason, "_v6": ipv6, "_score": score})
    return out.withColumns(
        {
            "alive": F.col("reason").isNull(),
            "quality": F.when(F.col("_v6"), 100).when(F.col("reason").isNull(), F.col("_score")).cast("bigint"),
        }
    ).drop("_v6", "_score")


def revalidate_links(probes: DataFrame, legacy: bool = False, order: Sequence[str] = ("status",)) -> DataFrame:
    """Verdict per url over HEAD and GET rows: good HEAD, or a redirect-like HEAD and a good GET.

    ``bytes`` is the GET payload size and ``head`` its first bytes as text. Of several rows of a url and method the last in
    ``order`` (such as ``probed_at``) counts, with all its columns.
    """
    def newest(method):
        return F.max_by(F.when(F.col("method") == method, F.struct("status", "bytes", "head")), F.when(F.col("method") == method, F.struct(*order)))

    per_url = probes.groupBy("url").agg(newest("HEAD").alias("_h"), newest("GET").alias("_g")).select(
        "url", F.col("_h.status").alias("head_status"), F.col("_g.status").alias("get_status"),
        F.col("_g.bytes").alias("get_bytes"), F.substring("_g.head", 1, 256).alias("get_text"),
    )
    text = F.lower(F.col("get_text"))
    marked = text.rlike("m3u") if legacy else (text.rlike("m3u") | (F.length(strip(text)) > 32))
    get_ok = F.col("get_status").isin(*GOOD) & (F.col("get_bytes") >= 16) & marked
    if legacy:
        ok = F.col("head_status").isin(200, 206, 301, 302, 304) | (F.col("head_status").isNotNull() & get_ok)
    else:
        ok = F.col("head_status").isin(*GOOD) | (F.col("head_status").isin(301, 302, 304, 403, 405) & get_ok)
    return per_url.withColumn("ok", F.coalesce(ok, F.lit(False)))


def attach_evidence(candidates: DataFrame, probes: DataFrame, key: str = "fp") -> DataFrame:
    """Left join of evidence; candidates without any are failed."""
    shared = [c for c in probes.columns if c in candidates.columns and c != key]
    return candidates.join(probes.drop(*shared), key, "left").withColumn("alive", F.coalesce("alive", F.lit(False)))


def latest_probe(probes: DataFrame, key: str = "fp", order: Sequence[str] = ("probed_at",)) -> DataFrame:
    """The newest probe row per key, by partial aggregation (no window over a hot key)."""
    rest = [c for c in probes.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return probes.groupBy(key).agg(newest.alias("_p")).select(key, "_p.*")


def split_valid_failed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("alive"), df.filter("NOT alive")


def running_valid_rate(df: DataFrame, order: str, valid: Column, **scale) -> DataFrame:
    """Add the share of valid probes up to each row, in percent."""
    out = running_sums(df, order, {"done": F.lit(1), "valid_so_far": valid.cast("int")}, **scale)
    return out.withColumn("valid_pct", F.col("valid_so_far") * 100.0 / F.col("done"))
