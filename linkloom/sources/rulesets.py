"""Rule sets and feed lists from JSON."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions.urls import netloc, raw_path
from linkloom.scale import rank_in_order, top_per_key

SCHEMA = """
    sources STRUCT<web_sources: ARRAY<STRING>, preset_files: ARRAY<STRING>>,
    categories STRUCT<`order`: ARRAY<STRING>, rules: MAP<STRING, ARRAY<STRING>>>,
    filter STRUCT<blacklist: ARRAY<STRING>, vod_domains: ARRAY<STRING>, overseas_keywords: ARRAY<STRING>,
                  playlist_whitelist: ARRAY<STRING>, playlist_blacklist: ARRAY<STRING>>,
    network STRUCT<timeout_cn: INT, timeout_overseas: INT>,
    quality STRUCT<cache_ttl_hours: INT, enable_speed_check: BOOLEAN, min_speed_mbps: DOUBLE,
                   enable_resolution_filter: BOOLEAN, min_resolution_width: INT, min_resolution_height: INT>
"""
KINDS = {
    "blacklist": "blacklist", "vod": "vod_domains", "overseas": "overseas_keywords",
    "allow": "playlist_whitelist", "deny": "playlist_blacklist",
}


class RuleTables(NamedTuple):
    category_order: DataFrame  # category, cat_rank, label
    rules: DataFrame           # category, cat_rank, ord, keyword
    keywords: DataFrame        # kind, ord, value
    thresholds: DataFrame      # one row
    feeds: DataFrame           # ord, url


def load_rules(spark: SparkSession, path: str | Sequence[str]) -> RuleTables:
    """A nested rule JSON as dimension tables."""
    doc = spark.read.json(path, schema=SCHEMA, multiLine=True)
    order = doc.select(F.posexplode("categories.order").alias("cat_rank", "category"))
    labels = F.create_map(*[F.lit(x) for kv in rules.CATEGORY_LABELS.items() for x in kv])
    category_order = order.select(
        "category", "cat_rank", F.coalesce(F.try_element_at(labels, "category"), "category").alias("label")
    )
    keywords_by_category = doc.select(F.explode("categories.rules").alias("category", "words")).select(
        "category", F.posexplode("words").alias("ord", "keyword")
    )
    rule_table = keywords_by_category.filter(F.trim("keyword") != "").join(order, "category", "left").select(
        "category", "cat_rank", "ord", "keyword"
    )
    kinds = F.create_map(*[x for kind, field in KINDS.items() for x in (F.lit(kind), F.col(f"filter.{field}"))])
    keywords = doc.select(F.explode(kinds).alias("kind", "words")).select(
        "kind", F.posexplode("words").alias("ord", "value")
    )
    thresholds = doc.select("network.*", "quality.*")
    feeds = doc.select(F.posexplode("sources.web_sources").alias("ord", "url"))
    return RuleTables(category_order, rule_table, keywords, thresholds, feeds)


def rule_mapping(table: DataFrame) -> dict[str, list[str]]:
    """A rule table as keyword lists in category order, for building column patterns."""
    # Rule tables are configuration: a few hundred rows by construction.
    out: dict[str, list[str]] = {}
    for r in table.orderBy("cat_rank", "ord").toLocalIterator():
        out.setdefault(r["category"], []).append(r["keyword"])
    return out


def keyword_mapping(table: DataFrame) -> dict[str, list[str]]:
    """Keyword lists by kind (blacklist, vod, overseas, allow, deny), in order."""
    out: dict[str, list[str]] = {kind: [] for kind in KINDS}
    for r in table.orderBy("kind", "ord").toLocalIterator():  # configuration, as above
        out.setdefault(r["kind"], []).append(r["value"])
    return out


def feed_list(feeds: DataFrame, order: str = "ord", **scale) -> DataFrame:
    """HTTP feeds without repeats, with unique short names (``#1``, ``#2`` … on collisions)."""
    url = F.col("url")
    first = top_per_key(feeds.filter(url.rlike("^https?://")), ["url"], [F.col(order)], 1)
    tail = F.regexp_extract(F.regexp_replace(raw_path(url), "^/+|/+$", ""), "([^/]*)$", 1)
    short = F.when(tail != "", F.concat(netloc(url), F.lit("/"), tail)).otherwise(netloc(url))
    ranked = rank_in_order(first.withColumn("_short", short), order, "_n", ["_short"], **scale)
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("#"), (F.col("_n") - 1).cast("string"))).otherwise("")
    return ranked.withColumn("short_name", F.concat("_short", suffix)).drop("_short", "_n")
