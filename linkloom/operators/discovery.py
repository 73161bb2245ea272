"""Link discovery over crawled documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import urls
from linkloom.functions.text import after_comma, any_of, has_comma, let, lines, strip
from linkloom.operators.filters import filter_antibot
from linkloom.scale import first_rows, materialize, top_per_key


# Every link pattern matches inside one run of these characters.
_TOKEN = r"(?iU)https?://[^\s<>\"']+"


def _likely(content: Column) -> Column:
    """The lines of a text that can hold a link, as a text. No link goes past a line feed, and the costly patterns below, which know all
    cases and white space, are spared most of a text."""
    return F.array_join(F.filter(F.split(content, "\n"), lambda x: F.contains(x, F.lit("://")) | F.contains(x, F.lit("http"))), "\n")


def found_links(
    content: Column, patterns: Sequence[str] = tuple(rules.URL_PATTERNS), playlists_only: bool = True
) -> Column:
    """Array of the distinct (playlist-like) links anywhere in a text.

    The text is scanned once for link-like runs; the patterns are then tried on those only.
    """
    def matches(token):
        return F.flatten(F.array(*[F.regexp_extract_all(token, F.lit("(?iU)" + p), F.lit(0)) for p in patterns]))

    tokens = F.array_distinct(F.regexp_extract_all(_likely(content), F.lit(_TOKEN), F.lit(0)))
    found = F.flatten(F.transform(tokens, matches))
    if not playlists_only:
        return F.array_distinct(found)
    return F.filter(F.array_distinct(F.transform(found, urls.clean_link)), urls.is_playlist)


def line_links(content: Column) -> Column:
    """Array of the links on lines: (``link``, ``alone``), the line being the link (playlist-like) or the link following a name and a
    comma (any). One pass over the text."""

    def links(line):
        alone = let(F.when(line.rlike("^https?://"), line), lambda u: F.when(urls.is_playlist(u), u))
        pair = let(F.when(has_comma(line), strip(after_comma(line))), lambda u: F.when(u.startswith("http"), u))
        return F.array(F.struct(pair.alias("link"), F.lit(False).alias("alone")), F.struct(alone.alias("link"), F.lit(True).alias("alone")))

    candidates = F.transform(F.filter(lines(_likely(content)), lambda x: F.contains(x, F.lit("http"))), strip)
    kept = F.filter(candidates, lambda x: ~x.startswith("#"))
    return F.filter(F.flatten(F.transform(kept, links)), lambda x: x["link"].isNotNull())


def found_line_urls(found: Column, pairs: bool = True) -> Column:
    """The distinct links of ``line_links``: those alone on their line or, with ``pairs``, all."""
    kept = found if pairs else F.filter(found, lambda x: x["alone"])
    return F.array_distinct(F.transform(kept, lambda x: x["link"]))


def extract_links(
    docs: DataFrame, keys: Sequence[str] = ("source_id",), patterns: Sequence[str] = tuple(rules.URL_PATTERNS),
    playlists_only: bool = True,
) -> DataFrame:
    """Links found anywhere in the whole text, once per document; a map-only step.

    The earlier crawl used ``rules.LEGACY_URL_PATTERNS`` without the playlist test and cleaning.
    """
    found = found_links(F.col("content"), patterns, playlists_only)
    return docs.select(*keys, F.explode(found).alias("link"))


def extract_line_urls(docs: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Links that stand on their own line (playlist-like only) or after a name and a comma (any)."""
    return docs.select(*keys, F.explode(found_line_urls(line_links(F.col("content")))).alias("link"))


def rank_by_domain_score(
    df: DataFrame, limit: int, url: str = "url", allow: Sequence[str] = tuple(rules.ALLOW_DOMAINS),
    deny: Sequence[str] = tuple(rules.DENY_DOMAINS),
) -> DataFrame:
    """The ``limit`` best links by domain score, with their position."""
    scored = df.withColumn("score", urls.domain_score(F.col(url), allow, deny))
    return first_rows(scored, [-F.col("score"), F.col(url)], limit, "position")


def expand_mirrors(df: DataFrame, url: str = "url") -> DataFrame:
    """Mirror candidates in the order they should be tried."""
    return df.select("*", F.posexplode(urls.mirrors(F.col(url))).alias("mirror_rank", "candidate"))


def first_success(candidates: DataFrame, docs: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """For each url the first candidate that was fetched with status 200 and a usable body.

    Joins on the candidate with the columns needed to choose, then once more for the content,
    so long texts are moved only for the winners.
    """
    good = filter_antibot(docs.filter((F.col("status") == 200) & (F.col("content") != "")))
    reached = candidates.join(good.select(F.col("url").alias("candidate")), "candidate", "left_semi")
    best = reached.groupBy(*keys).agg(F.min(F.struct("mirror_rank", "candidate")).alias("_b"))
    return best.select(*keys, "_b.*")


def expand_frontier(
    seeds: DataFrame, docs: DataFrame, cap: int | None = None, min_score: int = 1,
    allow: Sequence[str] = tuple(rules.ALLOW_DOMAINS), deny: Sequence[str] = tuple(rules.DENY_DOMAINS),
    suffixes: Sequence[str] | None = None,
) -> DataFrame:
    """Links reachable from seed feeds directly or through one sub-playlist: ``link``, ``domain``.

    ``seeds`` has ``url``, ``seed_rank`` and ``domain``; ``docs`` has ``url`` and ``content``. Only seeds with direct links
    are followed further, and of a sub-playlist only lines that are playlist-like links themselves count. A link
    found by several seeds keeps the domain of the last one. A sub-playlist counts once however many seeds link to
    it: the winning seed is chosen before its links are followed. ``cap`` limits the sub-playlists of a seed, as
    live fetching would; stored documents need no limit. With ``suffixes`` only sub-playlists whose link ends in one are opened, as
    the earlier crawl did (``rules.LEGACY_OPENED``).
    """
    # Texts are read once, where they lie: only the links found in them travel to the joins.
    content = F.col("content")
    read = materialize(docs.select("url", line_links(content).alias("_found"), found_links(content).alias("_links")))
    opened = seeds.join(read, "url").filter(F.size("_found") > 0).select(
        "seed_rank", "domain", found_line_urls(F.col("_found")).alias("_lines"), "_links"
    )

    def rows(df, column):
        return df.select("seed_rank", "domain", F.explode(column).alias("link"))

    direct = rows(opened, "_lines")
    subs = rows(opened, "_links").join(direct.select("link").distinct(), "link", "left_anti")
    if suffixes is not None:
        subs = subs.filter(F.col("link").rlike(any_of(suffixes) + "$"))
    if cap is not None:
        subs = top_per_key(subs, ["seed_rank"], [F.asc("link")], cap)
    last = F.max_by("domain", "seed_rank").alias("domain"), F.max("seed_rank").alias("seed_rank")
    frontier = subs.groupBy(F.col("link").alias("url")).agg(*last)
    score = urls.domain_score(F.col("link"), allow, deny)
    reached = frontier.join(read.select("url", found_line_urls(F.col("_found"), pairs=False).alias("_alone")), "url")
    below = rows(reached, "_alone").filter(score >= min_score)
    return merge_discovered(direct.unionByName(below))


def merge_discovered(found: DataFrame) -> DataFrame:
    """One row per link; the last seed that found it names the domain."""
    return found.groupBy("link").agg(F.max_by("domain", "seed_rank").alias("domain"))


def name_discovered(found: DataFrame, url: str = "link", domain: str = "domain") -> DataFrame:
    return found.withColumn("name", urls.discovered_name(F.col(url), F.col(domain)))


def base_domain(url: Column) -> Column:
    return F.substring_index(urls.netloc(url), ":", 1)


def domain_stats(df: DataFrame, top: int, domain: str = "domain") -> DataFrame:
    """The ``top`` domains by number of discovered links."""
    return df.groupBy(domain).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(domain)).limit(top)
