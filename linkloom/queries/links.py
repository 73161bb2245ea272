"""Queries over urls: predicates, scores, identity and address blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import urls
from linkloom.operators import admission, discovery, filters, matching, publish
from linkloom.queries import sql as q
from linkloom.queries.carriers import ctes, table
from linkloom.queries.registry import query

KEY = ["source_rank", "line_no"]
VOD = ["jd.com", "example.com:8080/live/3/"]


@query("private_hosts", f"""{ctes('catalog')}
SELECT source_rank, line_no, url FROM catalog WHERE NOT {q.private('url')}""")
def private_hosts(spark, sf):
    return filters.drop_private_hosts(table(spark, sf, "catalog")).select(*KEY, "url")


@query("private_blocks_join", f"""{ctes('catalog')}
SELECT source_rank, line_no, url, ({q.private_v4(q.host('url'))} OR
  (regexp_matches({q.host('url')}, '^100[.]64[.]'))) AS in_block FROM catalog""")
def private_blocks_join(spark, sf):
    df = table(spark, sf, "catalog")
    blocks = [b for b in rules.NON_PUBLIC_BLOCKS if ":" not in b] + ["100.64.0.0/10"]
    # The block table is derived from the rule list on Spark's side.
    nets = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in blocks])).alias("cidr"))
    return matching.in_blocks(df, nets).select(*KEY, "url", "in_block")


# Hosts of both families made of the events' numbers, and nested, repeated and foreign blocks.
_ADDRESSES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('http://', user_id % 256, '.', event_id % 256, '.', user_id % 7, '.9/x')
  WHEN 1 THEN concat('http://[2001:db8:', CAST(user_id % 10 AS STRING), '::', CAST(event_id % 10 AS STRING), ']:80/x')
  WHEN 2 THEN concat('http://host', user_id, '.example.com/x') ELSE concat('http://[fe80::', CAST(event_id % 10 AS STRING), ']/x') END AS url FROM {events}"""
_BLOCKS = ["10.0.0.0/8", "10.20.0.0/16", "64.0.0.0/3", "77.1.1.9", "2001:db8:2::/47", "2001:db8:7::3/128", "fe80::8/125", "fe80::/126", "10.0.0.0/8", "no block", "1.2.3.4/40"]


@query("address_blocks", f"""WITH a AS ({_ADDRESSES.format(events='events').replace('AS STRING', 'AS VARCHAR')}),
h AS (SELECT event_id, url, event_id % 4 AS kind, user_id % 256 AS o1, event_id % 256 AS o2, user_id % 7 AS o3, user_id % 10 AS g, event_id % 10 AS e FROM a JOIN events USING (event_id))
SELECT event_id, url, CASE kind WHEN 0 THEN o1 = 10 OR (o1 BETWEEN 64 AND 95) OR (o1 = 77 AND o2 = 1 AND o3 = 1) WHEN 1 THEN g IN (2, 3) OR (g = 7 AND e = 3)
  WHEN 2 THEN false ELSE e >= 8 OR e <= 3 END AS in_block FROM h""")
def address_blocks(spark, sf):
    urls_ = spark.sql(_ADDRESSES, events=table(spark, sf, "events"))
    nets = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in _BLOCKS])).alias("cidr"))
    return matching.in_blocks(urls_, nets).select("event_id", "url", "in_block")


@query("vod_hosts", f"""{ctes('catalog')}
SELECT source_rank, line_no, url FROM catalog WHERE NOT (lower({q.netloc('url')}) LIKE '%jd.com%'
  OR lower(concat({q.netloc('url')}, {q.path('url')})) LIKE '%example.com:8080/live/3/%')""")
def vod_hosts(spark, sf):
    return filters.drop_vod(table(spark, sf, "catalog"), VOD).select(*KEY, "url")


@query("vod_hosts_suffix", f"""SELECT page_id, url FROM pages
WHERE NOT regexp_matches(lower({q.netloc('url')}), '(^|[.])(spam-farm[.]example[.]org|example[.]net)$')""")
def vod_hosts_suffix(spark, sf):
    df = table(spark, sf, "pages").select("page_id", "url")
    return filters.drop_vod(df, ["spam-farm.example.org", "example.net:80"], match="suffix")


@query("rescue_live", f"""{ctes('catalog')}
SELECT source_rank, line_no, name, url FROM catalog
WHERE NOT (lower({q.netloc('url')}) = 'v.jd.com' OR lower({q.netloc('url')}) LIKE '%.jd.com') OR regexp_matches(name, 'Live|anvil|TV')""")
def rescue_live(spark, sf):
    df = table(spark, sf, "catalog")
    # Part names hold no live words, so one stands in for them here.
    named = df.withColumn("shown", F.col("name")).withColumn("name", F.replace("name", F.lit("anvil"), F.lit("Live anvil")))
    kept = filters.rescue_live_names(named, ["jd.com"])
    return kept.select(*KEY, F.col("shown").alias("name"), "url")


@query("schemes", f"""{ctes('catalog')}
SELECT 'admitted' AS stage, source_rank, line_no, url FROM catalog WHERE url LIKE 'http://%' OR url LIKE 'https://%'
UNION ALL SELECT 'probed', source_rank, line_no, url FROM catalog WHERE regexp_matches(url, '^(https?|udp|rtp|srt)://')
UNION ALL SELECT 'valid', source_rank, line_no, url FROM catalog
  WHERE {q.scheme('url')} IN ('http', 'https', 'rtmp', 'rtmps', 'rtsp') AND {q.netloc('url')} <> ''""")
def schemes(spark, sf):
    df = table(spark, sf, "catalog").select(*KEY, "url")
    stages = {
        "admitted": filters.keep_schemes(df),
        "probed": filters.keep_schemes(df, filters.PROBED_SCHEMES),
        "valid": filters.keep_schemes(df, filters.VALID_SCHEMES, need_host=True),
    }
    parts = [d.select(F.lit(s).alias("stage"), *KEY, "url") for s, d in stages.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("playlist_url_filter", f"""{ctes('catalog')}
SELECT 'catalog' AS src, url FROM catalog WHERE {q.playlist('url')}
UNION ALL SELECT 'pages', url FROM pages WHERE {q.playlist('url')}""")
def playlist_url_filter(spark, sf):
    cat = filters.keep_playlist_urls(table(spark, sf, "catalog")).select(F.lit("catalog").alias("src"), "url")
    pages = filters.keep_playlist_urls(table(spark, sf, "pages").select("url")).select(F.lit("pages").alias("src"), "url")
    return cat.unionByName(pages)


@query("playlist_url_filter_legacy", f"""{ctes('catalog')}
SELECT source_rank, line_no, url FROM catalog
WHERE NOT regexp_matches(lower(url), 'userid=|sign=|auth_token=|token=|session=')
  AND NOT ({q.path('url')} LIKE '%.m3u8' AND (regexp_matches({q.stem('url')}, '^[0-9]+$') OR length({q.stem('url')}) <= 10))
  AND regexp_matches(lower(url), '[.]m3u|[.]txt|php[?]type=m3u|/playlist|[?]type=m3u')""")
def playlist_url_filter_legacy(spark, sf):
    return filters.keep_playlist_urls(table(spark, sf, "catalog"), legacy=True).select(*KEY, "url")


@query("url_parts", f"""SELECT page_id, {q.scheme('url')} AS scheme, {q.netloc('url')} AS netloc, {q.host('url')} AS host,
  {q.path('url')} AS path, {q.query('url')} AS query, {q.stem('url')} AS stem, {q.suffix('url')} AS suffix FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.host(u).alias("host"),
        urls.path(u).alias("path"), urls.query(u).alias("query"),
        urls.stem(urls.path(u)).alias("stem"), urls.suffix(urls.path(u)).alias("suffix"),
    )


_SORTED = (
    "coalesce(array_to_string(list_sort(list_filter(string_split({qs}, '&'), lambda x: regexp_matches(x, '^[^=]*=.'))), '&'), '')"
)


@query("fingerprint_query", f"""WITH p AS (SELECT page_id, url, {_SORTED.format(qs=q.query('url'))} AS qs FROM pages)
SELECT page_id, concat({q.scheme('url')}, '://', {q.host('url')}, {q.path('url')}, CASE WHEN qs = '' THEN '' ELSE concat('?', qs) END) AS identity FROM p""")
def fingerprint_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical(F.col("url")).alias("identity"))


@query("fingerprint_kept_params", f"""{ctes('catalog')}
SELECT source_rank, line_no, concat({q.scheme('url')}, '://', {q.host('url')},
  CASE WHEN url LIKE '%:8080/%' THEN ':8080' WHEN url LIKE '%:5000' THEN ':5000' ELSE '' END, {q.path('url')},
  CASE WHEN regexp_matches(url, '[?&](id|key)=') THEN concat('?', regexp_extract(url, '[?&]((id|key)=[0-9]+)', 1)) ELSE '' END) AS identity
FROM catalog""")
def fingerprint_kept_params(spark, sf):
    keep = rules.FINGERPRINT_KEEP_PARAMS
    return table(spark, sf, "catalog").select(*KEY, urls.canonical(F.col("url"), keep).alias("identity"))


@query("known_direct", f"""{ctes('catalog')}
SELECT source_rank, line_no, url,
  regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^?/]*)', 1)), '(^|[.])({q.words(rules.DIRECT_KEYS)[1:-1]})')
    AND NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^?/]*)', 1)), '^cdn8[.]jd')
    AND (regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^?/]*)', 1)), '[.]({q.words(rules.DIRECT_KEYS)[1:-1]})'))
    OR regexp_matches(url, '//\\[(2409:8087|2408:8000|240e:600|240e:900)') AS known_direct
FROM catalog""")
def known_direct(spark, sf):
    return filters.flag_known_direct(table(spark, sf, "catalog")).select(*KEY, "url", "known_direct")


@query("ipv6_flag", f"""{ctes('catalog')}
SELECT source_rank, line_no, url, regexp_replace({q.netloc('url')}, '^.*@', '') LIKE '[%' AS ipv6 FROM catalog""")
def ipv6_flag(spark, sf):
    return filters.flag_ipv6(table(spark, sf, "catalog")).select(*KEY, "url", "ipv6")


@query("sane_urls", """SELECT page_id, url FROM pages WHERE length(url) BETWEEN 40 AND 500
  AND NOT regexp_matches(lower(url), 'javascript:|data:|about:|void[(]')""")
def sane_urls(spark, sf):
    return filters.sane_candidates(table(spark, sf, "pages").select("page_id", "url"), shortest=40)


@query("domain_score_rank", f"""SELECT url, score, row_number() OVER (ORDER BY score DESC, url) AS position FROM
  (SELECT DISTINCT url, {q.domain_score('url')} AS score FROM (
    SELECT replace(url, 'blog.', 'blog.oss-') AS url FROM pages UNION ALL SELECT replace(url, 'www.', 'github.') FROM pages))
  QUALIFY position <= 100""")
def domain_score_rank(spark, sf):
    url = F.col("url")
    pages = table(spark, sf, "pages")
    variants = pages.select(F.replace(url, F.lit("blog."), F.lit("blog.oss-")).alias("url")).unionByName(
        pages.select(F.replace(url, F.lit("www."), F.lit("github.")).alias("url"))
    )
    return discovery.rank_by_domain_score(variants.distinct(), 100).select("url", "score", "position")


@query("domain_top10", f"""SELECT split_part({q.netloc('url')}, ':', 1) AS domain, count(*) AS n FROM pages
GROUP BY 1 ORDER BY n DESC, domain LIMIT 10""")
def domain_top10(spark, sf):
    df = table(spark, sf, "pages").select(discovery.base_domain(F.col("url")).alias("domain"))
    return discovery.domain_stats(df, 10)


@query("url_sanitize", f"""WITH p AS (SELECT page_id, url, coalesce(array_to_string(list_filter(string_split({q.query('url')}, '&'),
  lambda x: regexp_matches(x, '^[^=]*=.') AND lower(split_part(x, '=', 1)) NOT IN ('ref', 'utm_source')), '&'), '') AS qs FROM pages)
SELECT page_id, concat(regexp_extract(url, '^[^?#]*'), CASE WHEN qs = '' THEN '' ELSE concat('?', qs) END,
  regexp_extract(url, '#.+$')) AS url FROM p""")
def url_sanitize(spark, sf):
    df = table(spark, sf, "pages").select("page_id", "url")
    return publish.sanitize_catalog(df, ["ref", "utm_source"])


@query("sanitized_lines", f"""{ctes('raw')}
SELECT source_rank, line_no, regexp_replace(regexp_replace(line, '[?&]key=[0-9]+', '', 'g'), '[?&]id=[0-9]+', '', 'g') AS line FROM raw""")
def sanitized_lines(spark, sf):
    return publish.sanitize_lines(table(spark, sf, "raw"), ["key", "id"])


@query("dedup_values", "SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '[?#].*$', '') FROM pages)")
def dedup_values(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    bare = pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return admission.dedup_values(pages.unionByName(bare))


@query("difference_urls", """SELECT url FROM pages WHERE url NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages)""")
def difference_urls(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    return admission.difference(pages, pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url")))


@query("split_recombine", f"""{ctes('catalog')}
SELECT source_rank, line_no, url, CASE WHEN url LIKE 'rtp://%' THEN true WHEN url LIKE '%//[2409:8087:%' THEN true
  WHEN url LIKE '%.tencentplay%' THEN true ELSE quality >= 50 END AS kept FROM catalog
  WHERE CASE WHEN url LIKE 'rtp://%' THEN true WHEN url LIKE '%//[2409:8087:%' THEN true
  WHEN url LIKE '%.tencentplay%' THEN true ELSE quality >= 50 END""")
def split_recombine(spark, sf):
    """Pass-through links skip the test the others take; one flag, no split and union."""
    df = filters.flag_known_direct(table(spark, sf, "catalog"))
    through = filters.has_scheme(F.col("url"), ["udp", "rtp", "srt"]) | F.col("known_direct")
    return df.withColumn("kept", through | (F.col("quality") >= 50)).filter("kept").select(*KEY, "url", "kept")
