"""The main run: from raw catalog lines and recorded evidence to the published catalog."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import names, scores
from linkloom.operators import admission, evidence, filters, publish, ranking, runs
from linkloom.scale import materialize
from linkloom.sources.rulesets import RuleTables, keyword_mapping, rule_mapping


class Options(NamedTuple):
    links_per_name: int = 0     # 0: all
    output_limit: int = 0       # 0: all
    candidate_limit: int = 0
    links_per_host: int = 0
    min_quality: int = 0
    min_speed: float | None = 0.001
    min_width: int = 0          # resolution gate, needs probes with the stream description ``stdout``
    min_height: int = 0
    ttl_hours: float = 6
    reuse_recent: bool = True
    enforce_quota: bool = False
    share: bool = True  # write judged links, channels and catalog once, since several outputs read them
    blacklist: Sequence[str] = tuple(rules.BLACKLIST)
    vod_hosts: Sequence[str] = tuple(rules.VOD_HOSTS)
    overseas: Sequence[str] = tuple(rules.OVERSEAS_KEYWORDS)
    aliases: Sequence[tuple[str, str]] = tuple(rules.ALIASES)
    category_rules: Mapping[str, Sequence[str]] = rules.CATEGORY_RULES
    category_order: Sequence[str] = tuple(rules.CATEGORY_ORDER)
    characters: tuple[str, str] = names.CHARACTERS  # traditional and simplified, one by one
    allow_domains: Sequence[str] = tuple(rules.ALLOW_DOMAINS)  # for discovery
    deny_domains: Sequence[str] = tuple(rules.DENY_DOMAINS)


#: The numbers of the published daily run.
PUBLISHED = Options(links_per_name=2, output_limit=2000)


def options_from_rules(tables: RuleTables, base: Options = Options()) -> Options:
    """``base`` with the keywords, category rules and thresholds of a loaded rule JSON; what it leaves out stays."""
    words, limits = keyword_mapping(tables.keywords), tables.thresholds.first()
    mapping = rule_mapping(tables.rules)
    order = [r["category"] for r in tables.category_order.orderBy("cat_rank").toLocalIterator()]
    found = {
        "blacklist": words["blacklist"], "vod_hosts": words["vod"], "overseas": words["overseas"],
        "allow_domains": words["allow"], "deny_domains": words["deny"], "category_rules": mapping, "category_order": order,
    }
    changes = {k: v for k, v in found.items() if v}
    if limits is not None:
        if limits["cache_ttl_hours"] is not None:
            changes["ttl_hours"] = float(limits["cache_ttl_hours"])
        if limits["enable_speed_check"] is False:
            changes["min_speed"] = None
        elif limits["min_speed_mbps"] is not None:
            changes["min_speed"] = limits["min_speed_mbps"]
        if limits["enable_resolution_filter"]:
            changes |= {"min_width": limits["min_resolution_width"] or 0, "min_height": limits["min_resolution_height"] or 0}
    return base._replace(**changes)


class Result(NamedTuple):
    catalog: DataFrame   # line_no, category, name, url
    failed: DataFrame    # candidates without working evidence
    channels: DataFrame  # every valid link with category, norm_name, quality
    stats: DataFrame     # one row
    cache: DataFrame     # fp, validated_at


def name_channels(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Add region, category and grouping key, in place: no shuffle, however often a name occurs."""
    name = F.col("name")
    return filters.flag_region(df, opts.overseas).withColumns(
        {
            "category": names.classify(name, opts.category_rules, opts.category_order, opts.characters),
            "norm_name": names.normalize(name, opts.aliases, opts.characters),
        }
    )


def publishable(channels: DataFrame, opts: Options = Options(), seq: str = "seq") -> DataFrame:
    """Rank, cap and order channels: the rows of the published catalog."""
    good = filters.min_quality(channels, opts.min_quality)
    top = ranking.topk_per_name(good, opts.links_per_name, seq=seq)
    # The best link names the channel.
    shown = F.min_by("name", F.struct(-F.col("quality"), F.col(seq))).alias("shown")
    shown_names = good.groupBy(*[F.col(c).alias(f"_{c}") for c in ranking.GROUP]).agg(
        F.max("quality").alias("best"), F.min(seq).alias("first_seq"), shown
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ranking.GROUP]
    top = top.join(shown_names, same[0] & same[1]).drop(*[f"_{c}" for c in ranking.GROUP])
    order = ranking.output_order(top)
    if opts.enforce_quota and opts.output_limit > 0:
        quota = ranking.proportional_quota(good, opts.output_limit, opts.category_order)
        top = ranking.enforce_quota(top, quota, order, opts.category_order)
    ordered = ranking.global_cap(top, order, opts.output_limit)
    return ordered.select("line_no", "category", names.display(F.col("shown"), opts.characters).alias("name"), "url", "quality", "fp")


def curate(
    sources: Sequence[DataFrame],
    probes: DataFrame,
    now: Column,
    cache: DataFrame | None = None,
    second_probes: DataFrame | None = None,
    opts: Options = Options(),
    run_id: str = "run",
) -> Result:
    """Run the whole job. ``sources`` are tables of entries, raw lines or discovered links in order of priority.

    ``probes`` holds the newest evidence per ``fp`` (see ``evidence.latest_probe``), with ``speed``;
    ``second_probes`` has ``fp`` and ``status`` of the direct check. Links validated within the time to live are published
    again whatever the evidence; only links that pass all gates of this run are stamped in the cache, after the last
    gate. With ``share`` the numbers of the run are counted while its tables are written, and its duration is that of all of
    this; else they are computed when asked for, and the duration is that of planning.
    """
    began = time.monotonic()
    raw = admission.union_sources(sources)
    skip = None if opts.reuse_recent else cache
    accepted = admission.admit(raw, skip, now, opts.ttl_hours, opts.blacklist, opts.vod_hosts)
    accepted = admission.topk_per_domain(accepted, opts.links_per_host)
    if opts.candidate_limit > 0:
        accepted = admission.candidate_limit(accepted, opts.candidate_limit)
    judged = evidence.attach_evidence(accepted, evidence.evaluate_probe(probes))
    judged = judged.withColumns({"passed": F.col("alive"), "recent": F.lit(False)})
    if opts.reuse_recent and cache is not None:
        fresh = filters.fresh(cache, now, opts.ttl_hours).select("fp").distinct().withColumn("_recent", F.lit(True))
        judged = judged.join(fresh, "fp", "left").withColumn("recent", F.coalesce("_recent", F.lit(False))).drop("_recent")
        judged = judged.withColumn("alive", F.col("alive") | F.col("recent"))
    quality = scores.default_quality(F.col("quality"), opts.min_quality)
    slow = None
    if opts.min_speed is not None:
        fast = F.coalesce(F.col("speed") >= opts.min_speed, F.lit(False))
        slow = F.col("alive") & ~F.col("recent") & (F.col("speed") < opts.min_speed)
        quality = F.when(fast, scores.speed_bonus(quality, F.col("speed"))).otherwise(quality)
        judged = judged.withColumn("passed", F.col("passed") & fast)
    if opts.min_width > 0 or opts.min_height > 0:
        judged = judged.withColumn("passed", F.col("passed") & filters.large_enough(F.col("stdout"), opts.min_width, opts.min_height))
    if second_probes is not None:
        second = second_probes.select("fp", F.col("status").alias("_second"))
        judged = judged.withColumnRenamed("status", "_first").join(second, "fp", "left").withColumnRenamed("_second", "status")
        judged = evidence.evaluate_second_probe(judged).withColumn("passed", F.col("passed") & F.col("direct_ok"))
        judged = judged.drop("status", "direct_ok").withColumnRenamed("_first", "status")
    judged = judged.withColumns({"quality": quality, "seq": admission.seq()})
    counters = runs.RunCounters([*opts.category_order, *opts.category_rules, *rules.CATEGORY_ORDER])
    judged = materialize(counters.judged(judged, slow)) if opts.share else judged
    failed = judged.filter("NOT alive")
    channels = name_channels(judged.filter("passed OR recent"), opts)
    channels = materialize(counters.channels(channels)) if opts.share else channels
    catalog = publishable(channels, opts)
    if opts.share:
        catalog = materialize(counters.catalog(catalog))
        stats = counters.record(raw.sparkSession, run_id, now, time.monotonic() - began)
    else:
        stats = runs.run_record(judged, channels, catalog, run_id, now, slow, time.monotonic() - began)
    old = cache if cache is not None else accepted.select("fp", now.alias("validated_at")).limit(0)
    proved = channels.filter("passed")
    return Result(catalog, failed, channels, stats, publish.updated_cache(proved, old, now, opts.ttl_hours))
