"""Admission of entries: ordered predicates, deduplication, source priority and caps.

Entries are identified by ``(source_rank, line_no)``, which orders them by source priority and
position; every choice between duplicates is the smallest pair, so results do not depend on
how the input is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import names, urls
from linkloom.functions.text import let
from linkloom.operators import filters
from linkloom.scale import first_rows, materialize, rank_by, top_per_key
from linkloom.sources.catalogs import split_entries

SEQ = ("source_rank", "line_no")
REASONS = (
    "no_comma", "empty_name", "blacklisted", "private_ip", "vod_domain", "bad_url", "cached", "dup_fp",
)


def seq() -> Column:
    """Entry key as one number, so that minima stay in hash aggregation: room for 63 bits of rank and of line."""
    return F.col("source_rank").cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.col("line_no").cast("decimal(19,0)")


def entry_reason(
    blacklist: Sequence[str] = tuple(rules.BLACKLIST), vod_hosts: Sequence[str] = tuple(rules.VOD_HOSTS)
) -> Column:
    """First failed test that needs only the entry itself; NULL when all pass."""
    def reason(e):
        name, url = e["name"], e["url"]
        return (
            F.when(name.isNull(), "no_comma")
            .when((name == "") | (name == rules.UNKNOWN_NAME), "empty_name")
            .when(names.is_blacklisted(name, blacklist), "blacklisted")
            .when(urls.has_non_public_host(url), "private_ip")
            .when(urls.is_vod(url, vod_hosts), "vod_domain")
            .when(~filters.has_scheme(url, filters.ADMITTED_SCHEMES), "bad_url")
        )

    return let(F.struct("name", "url"), reason)


def _tested(raw: DataFrame, blacklist, vod_hosts) -> DataFrame:
    return _as_entries(raw).withColumn("reject_reason", entry_reason(blacklist, vod_hosts))


def _sound(tested: DataFrame) -> DataFrame:
    return tested.filter(F.col("reject_reason").isNull()).withColumn("fp", urls.fingerprint(F.col("url")))


def sound_entries(
    raw: DataFrame, blacklist: Sequence[str] = tuple(rules.BLACKLIST), vod_hosts: Sequence[str] = tuple(rules.VOD_HOSTS)
) -> DataFrame:
    """Entries that pass all tests of their own, with ``fp``; a map-only step."""
    return _sound(_tested(raw, blacklist, vod_hosts)).drop("reject_reason")


def admit(
    raw: DataFrame,
    cache: DataFrame | None = None,
    now: Column | None = None,
    ttl_hours: float = 6,
    blacklist: Sequence[str] = tuple(rules.BLACKLIST),
    vod_hosts: Sequence[str] = tuple(rules.VOD_HOSTS),
) -> DataFrame:
    """Accepted entries with ``fp`` and ``host``, one per fingerprint."""
    once = dedup_by_fingerprint(sound_entries(raw, blacklist, vod_hosts))
    if cache is not None:
        # After deduplication every fingerprint is a single row, so a hot one cannot skew this join.
        once = filters.drop_recent(once, cache, now, ttl_hours)
    return once.withColumn("host", urls.host(F.col("url")))


def admission_reasons(
    raw: DataFrame,
    cache: DataFrame | None = None,
    now: Column | None = None,
    ttl_hours: float = 6,
    blacklist: Sequence[str] = tuple(rules.BLACKLIST),
    vod_hosts: Sequence[str] = tuple(rules.VOD_HOSTS),
) -> DataFrame:
    """Every entry with its ``reject_reason`` (``accepted`` when admitted).

    The entries are tested once and written; only the sound ones, which have fingerprints, are joined. Winners come by a
    partial minimum per fingerprint, so that the joined side has one row per fingerprint and a hot one can be split.
    """
    fp = F.when(F.col("reject_reason").isNull(), urls.fingerprint(F.col("url")))
    tested = materialize(_tested(raw, blacklist, vod_hosts).withColumns({"_fp": fp, "_seq": seq()}))
    sound = tested.filter(F.col("reject_reason").isNull())
    summary = _fp_summary(sound.withColumn("fp", F.col("_fp")), cache, now, ttl_hours)
    winners = summary.select(F.col("fp").alias("_winner_fp"), F.col("_seq").alias("_winner"), F.col("cached").alias("_cached"))
    verdict = (
        F.when(F.col("_cached"), "cached").when(F.col("_seq") == F.col("_winner"), "accepted").otherwise("dup_fp")
    )
    judged = sound.join(winners, sound["_fp"] == winners["_winner_fp"]).withColumn("reject_reason", verdict)
    rejected = tested.filter(F.col("reject_reason").isNotNull())
    return judged.select(*tested.columns).unionByName(rejected).drop("_fp", "_seq")


def _fp_summary(sound: DataFrame, cache, now, ttl_hours) -> DataFrame:
    """One row per fingerprint: its first entry and whether it was seen recently."""
    per_fp = sound.groupBy("fp").agg(F.min("_seq").alias("_seq"))
    if cache is None:
        return per_fp.withColumn("cached", F.lit(False))
    seen = filters.fresh(cache, now, ttl_hours).select("fp").distinct().withColumn("cached", F.lit(True))
    return per_fp.join(seen, "fp", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def reject_summary(
    raw: DataFrame,
    cache: DataFrame | None = None,
    now: Column | None = None,
    ttl_hours: float = 6,
    blacklist: Sequence[str] = tuple(rules.BLACKLIST),
    vod_hosts: Sequence[str] = tuple(rules.VOD_HOSTS),
) -> DataFrame:
    """Entries per reason, counted per fingerprint first: no entry-level join or window."""
    tested = _tested(raw, blacklist, vod_hosts).withColumn(
        "fp", F.when(F.col("reject_reason").isNull(), urls.fingerprint(F.col("url")))
    )
    per_fp = tested.groupBy("reject_reason", "fp").agg(F.count("*").alias("n"))
    if cache is None:
        per_fp = per_fp.withColumn("cached", F.lit(False))
    else:
        seen = filters.fresh(cache, now, ttl_hours).select("fp").distinct().withColumn("cached", F.lit(True))
        per_fp = per_fp.join(seen, "fp", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))

    def part(reason, n):
        return F.struct(reason.alias("reject_reason"), n.alias("n"))

    whole = F.array(part(F.col("reject_reason"), F.col("n")))
    recent = F.array(part(F.lit("cached"), F.col("n")))
    split = F.array(part(F.lit("accepted"), F.lit(1).cast("bigint")), part(F.lit("dup_fp"), F.col("n") - 1))
    parts = F.when(F.col("reject_reason").isNotNull(), whole).when(F.col("cached"), recent).otherwise(split)
    return (
        per_fp.select(F.explode(parts).alias("p"))
        .select("p.*")
        .groupBy("reject_reason")
        .agg(F.sum("n").alias("n"))
        .filter("n > 0")
    )


def dedup_by_fingerprint(df: DataFrame, fp: str = "fp", order: Sequence[str] = SEQ) -> DataFrame:
    """First entry of every fingerprint, in source priority and position."""
    return top_per_key(df, [fp], [F.col(c) for c in order], 1)


def dedup_values(df: DataFrame, columns: Sequence[str] = ("url",)) -> DataFrame:
    return df.select(*columns).distinct()


def _as_entries(source: DataFrame) -> DataFrame:
    return split_entries(source) if "line" in source.columns and "name" not in source.columns else source


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Stack tables of raw lines or entries; earlier ones take priority through ``source_rank``.

    Every table is cut into entries before it is stacked. One of many files (``source_id``) gets a rank per file, in the order of
    their names, since line numbers restart in each; tables without line numbers, such as discovered links, are
    numbered by url and name. A table with its own ``source_rank`` keeps it, and answers for its uniqueness.
    """
    files = any("source_id" in s.columns and "source_rank" not in s.columns for s in sources)
    apart = 1 << 32 if files else 1  # leaves room for the ranks of a table's files
    ranked = [_ranked(_as_entries(s), i * apart) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def _ranked(source: DataFrame, place: int) -> DataFrame:
    if "line_no" not in source.columns:
        source = rank_by(source, [F.col(c) for c in ("url", "name") if c in source.columns], "line_no")
    if "source_rank" in source.columns:
        return source
    first = F.lit(place).cast("bigint")
    if "source_id" not in source.columns:
        return source.withColumn("source_rank", first)
    # One row per file.
    files = source.select(F.col("source_id").alias("_file")).distinct()
    files = files.withColumn("_no", F.row_number().over(Window.orderBy("_file")))
    ranked = source.join(files, F.col("source_id").eqNullSafe(F.col("_file")))
    return ranked.withColumn("source_rank", first + F.col("_no")).drop("_file", "_no")


def difference(df: DataFrame, other: DataFrame, key: str = "url") -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def topk_per_domain(df: DataFrame, k: int, order: Sequence[str] = SEQ, key: str = "host") -> DataFrame:
    """At most ``k`` entries per host in entry order; 0 keeps all."""
    return df if k <= 0 else top_per_key(df, [key], [F.col(c) for c in order], k)


def candidate_limit(df: DataFrame, n: int, order: Sequence[str] = SEQ, key: str = "host") -> DataFrame:
    """The first ``n`` entries, hosts in first-seen order; adds ``candidate_no``.

    Only the ``n`` first-seen hosts can matter, so they are a table of at most ``n`` rows.
    """
    df = materialize(df)  # read twice below
    first = df.groupBy(key).agg(F.min(seq() if order == SEQ else F.struct(*order)).alias("_first"))
    hosts = first_rows(first, [F.col("_first")], n, "_host_no").drop("_host_no")
    kept = df.join(hosts, key)
    return first_rows(kept, [F.col("_first"), *[F.col(c) for c in order]], n, "candidate_no").drop("_first")
