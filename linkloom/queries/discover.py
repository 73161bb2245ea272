"""Queries over link discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import rules
from linkloom.operators import discovery
from linkloom.plans.discover import discover
from linkloom.queries import sql as q
from linkloom.queries.carriers import ctes, table
from linkloom.queries.registry import query

_PATTERNS = [p.replace("'", "''") for p in rules.URL_PATTERNS]
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, unnest(regexp_extract_all(content, '(?i){p}')) AS raw FROM docs" for p in _PATTERNS
)
LINKS = f"""links AS (SELECT DISTINCT doc_id, link FROM (SELECT doc_id, regexp_replace(raw, '[''\")> \\t]+$', '') AS link FROM ({_FOUND}))
  WHERE {q.playlist('link')})"""
LINES = f"""ln AS (SELECT doc_id, {q.strip('raw')} AS line FROM (SELECT doc_id, unnest({q.split_lines('content')}) AS raw FROM docs)),
line_urls AS (SELECT DISTINCT doc_id, link FROM (
  SELECT doc_id, {q.strip(q.after_comma('line'))} AS link FROM ln WHERE line NOT LIKE '#%' AND contains(line, ',') AND {q.strip(q.after_comma('line'))} LIKE 'http%'
  UNION ALL SELECT doc_id, line FROM ln WHERE regexp_matches(line, '^https?://') AND {q.playlist('line')})),
alone AS (SELECT DISTINCT doc_id, line AS link FROM ln WHERE line NOT LIKE '#%' AND regexp_matches(line, '^https?://') AND {q.playlist('line')})"""


@query("page_links", f"{ctes('docs')}, {LINKS} SELECT * FROM links")
def page_links(spark, sf):
    return discovery.extract_links(table(spark, sf, "docs"), ["doc_id"])


_LEGACY = " UNION ".join(
    "SELECT doc_id, unnest(regexp_extract_all(content, '(?i){}')) AS link FROM docs".format(p.replace("'", "''")) for p in rules.LEGACY_URL_PATTERNS
)


@query("page_links_legacy", f"{ctes('docs')} SELECT DISTINCT doc_id, link FROM ({_LEGACY})")
def page_links_legacy(spark, sf):
    docs = table(spark, sf, "docs")
    return discovery.extract_links(docs, ["doc_id"], rules.LEGACY_URL_PATTERNS, playlists_only=False)


_HREF = r'href="[^"]+"'


@query("page_hrefs", f"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{_HREF}')) AS href FROM pages""")
def page_hrefs(spark, sf):
    """The same extraction with another pattern over whole pages, without the playlist test."""
    docs = table(spark, sf, "pages").select("page_id", F.col("html").alias("content"))
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(_HREF), F.lit(0)))
    return docs.select("page_id", F.explode(found).alias("href"))


@query("line_urls", f"{ctes('docs')}, {LINES} SELECT * FROM line_urls")
def line_urls(spark, sf):
    return discovery.extract_line_urls(table(spark, sf, "docs"), ["doc_id"])


_SEEDS = """SELECT url, doc_id AS seed_rank, concat('d', doc_id % 7) AS domain FROM {docs} WHERE status = 200"""
FRONTIER = f"""{LINKS}, {LINES}, seeds AS ({_SEEDS.format(docs='docs')}),
sd AS (SELECT s.seed_rank, s.domain, d.doc_id FROM seeds s JOIN docs d ON s.url = d.url),
direct AS (SELECT seed_rank, domain, link FROM sd JOIN line_urls USING (doc_id)),
subs AS (SELECT seed_rank, domain, link FROM sd JOIN links USING (doc_id) WHERE link NOT IN (SELECT link FROM direct)
  AND doc_id IN (SELECT doc_id FROM line_urls)),
below AS (SELECT s.seed_rank, s.domain, u.link FROM subs s JOIN docs d ON d.url = s.link JOIN alone u ON u.doc_id = d.doc_id
  WHERE {q.domain_score('u.link')} > 0),
merged AS (SELECT link, arg_max(domain, seed_rank) AS domain FROM (SELECT * FROM direct UNION ALL SELECT * FROM below) GROUP BY link)"""


@query("frontier_depth1", f"{ctes('docs')}, {FRONTIER} SELECT * FROM merged")
def frontier_depth1(spark, sf):
    docs = table(spark, sf, "docs")
    return discovery.expand_frontier(spark.sql(_SEEDS, docs=docs), docs)


@query("frontier_legacy", f"{ctes('docs')}, {FRONTIER.replace('FROM subs s JOIN', 'FROM (SELECT * FROM subs WHERE regexp_matches(link, ' + chr(39) + '[.](m3u|m3u8|txt)$' + chr(39) + ')) s JOIN')} SELECT * FROM merged")
def frontier_legacy(spark, sf):
    docs = table(spark, sf, "docs")
    return discovery.expand_frontier(spark.sql(_SEEDS, docs=docs), docs, suffixes=rules.LEGACY_OPENED)


_MERGE = "SELECT concat('http://h', l_partkey, '.example.com/') AS link, l_suppkey AS seed, concat('s', l_suppkey) AS domain FROM {lineitem}"


@query("merge_discovered", f"SELECT link, arg_max(domain, seed) AS domain FROM ({_MERGE.format(lineitem='lineitem')}) GROUP BY link")
def merge_discovered(spark, sf):
    found = spark.sql(_MERGE, lineitem=table(spark, sf, "lineitem")).withColumnRenamed("seed", "seed_rank")
    return discovery.merge_discovered(found)


@query("discovered_names", f"""WITH p AS (SELECT url, split_part({q.netloc('url')}, ':', 1) AS domain FROM pages),
s AS (SELECT *, {q.stem('url')} AS st FROM p)
SELECT url, domain, CASE WHEN regexp_matches(st, '^[0-9]+$') OR length(st) <= 3 THEN domain ELSE concat(st, ' (', domain, ')') END AS name FROM s""")
def discovered_names(spark, sf):
    p = table(spark, sf, "pages").select("url", discovery.base_domain(F.col("url")).alias("domain"))
    return discovery.name_discovered(p, "url")


_M = "regexp_replace(url, '^https://github.com/([^/]+)/([^/]+)/blob/', 'https://raw.githubusercontent.com/\\1/\\2/')"
_CDN = "regexp_replace(raw, '^https://raw.githubusercontent.com/([^/]+)/([^/]+)/([^/]+)/', 'https://testingcf.jsdelivr.net/gh/\\1/\\2@\\3/')"
MIRRORS = f"""r AS (SELECT seq, url, {_M} AS raw FROM repo),
t AS (SELECT seq, url, CASE WHEN raw NOT LIKE 'https://raw.%' THEN [url] WHEN raw = url THEN [url, {_CDN}, 'https://mirror.ghproxy.com/' || raw, 'https://gh-proxy.com/' || raw]
  ELSE [url, raw, {_CDN}, 'https://mirror.ghproxy.com/' || raw, 'https://gh-proxy.com/' || raw] END AS cs FROM r),
cand AS (SELECT seq, url, CAST(unnest(range(len(cs))) AS INTEGER) AS mirror_rank, unnest(cs) AS candidate FROM t)"""


@query("mirror_expand", f"{ctes('repo')}, {MIRRORS} SELECT * FROM cand")
def mirror_expand(spark, sf):
    return discovery.expand_mirrors(table(spark, sf, "repo")).select("seq", "url", "mirror_rank", "candidate")


@query("mirror_first_success", f"""{ctes('repo', 'fetched')}, {MIRRORS}, good AS (SELECT url AS candidate FROM fetched WHERE status = 200 AND content NOT LIKE '<html>%')
SELECT url, min(mirror_rank) AS mirror_rank, arg_min(candidate, mirror_rank) AS candidate FROM cand JOIN good USING (candidate) GROUP BY url""")
def mirror_first_success(spark, sf):
    tried = discovery.expand_mirrors(table(spark, sf, "repo"))
    return discovery.first_success(tried, table(spark, sf, "fetched"))


DISCOVERED = f"""good AS (SELECT * FROM docs WHERE status = 200 AND content NOT LIKE '<html>%'),
{LINKS}, {LINES}, seeds AS (SELECT url, doc_id AS seed_rank, split_part({q.netloc('url')}, ':', 1) AS domain FROM docs),
sd AS (SELECT s.seed_rank, s.domain, g.doc_id FROM seeds s JOIN good g ON s.url = g.url),
direct AS (SELECT seed_rank, domain, link FROM sd JOIN line_urls USING (doc_id)),
subs AS (SELECT seed_rank, domain, link FROM sd JOIN links USING (doc_id) WHERE link NOT IN (SELECT link FROM direct)
  AND doc_id IN (SELECT doc_id FROM line_urls)),
below AS (SELECT s.seed_rank, s.domain, u.link FROM subs s JOIN good d ON d.url = s.link JOIN alone u ON u.doc_id = d.doc_id WHERE {q.domain_score('u.link')} > 0),
merged AS (SELECT link, arg_max(domain, seed_rank) AS domain FROM (SELECT * FROM direct UNION ALL SELECT * FROM below) GROUP BY link)"""
_STEM = q.stem('link')
DISCOVERED_NAME = f"CASE WHEN regexp_matches({_STEM}, '^[0-9]+$') OR length({_STEM}) <= 3 THEN domain ELSE concat({_STEM}, ' (', domain, ')') END"


@query("discover_run", f"{ctes('docs')}, {DISCOVERED} SELECT link AS url, domain, {DISCOVERED_NAME} AS name FROM merged")
def discover_run(spark, sf):
    docs = table(spark, sf, "docs")
    return discover(docs.select("url", F.col("doc_id").alias("seed_rank")), docs)
