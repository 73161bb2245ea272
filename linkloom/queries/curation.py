"""Queries over admission, ranking and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import admission, filters, publish, ranking, runs
from linkloom.queries import sql as q
from linkloom.queries.carriers import ctes, table
from linkloom.queries.ingest import GROUPED_CTE, GROUPED_ROWS, grouped_lines
from linkloom.queries.registry import query
from linkloom.scale import rank_by
from linkloom.sources.catalogs import read_grouped_catalog

BLACKLIST, VOD = ["anvil"], ["jd.com"]
ORDER = ["PROMO", "LARGE", "MEDIUM", "SMALL", "STANDARD"]
KEY = ["source_rank", "line_no"]

# Entries with their reason, first-seen order being (source_rank, line_no).
TESTED = f"""{ctes('raw', 'catalog')},
split AS (SELECT source_rank, line_no, line, CASE WHEN contains(line, ',') THEN {q.strip("split_part(line, ',', 1)")} END AS name,
  CASE WHEN contains(line, ',') THEN {q.strip(q.after_comma('line'))} END AS url FROM raw),
tested AS (SELECT *, CASE WHEN name IS NULL THEN 'no_comma' WHEN name IN ('', '未知频道') THEN 'empty_name'
  WHEN contains(upper(name), 'ANVIL') THEN 'blacklisted' WHEN {q.private('url')} THEN 'private_ip'
  WHEN contains(lower({q.netloc('url')}), 'jd.com') THEN 'vod_domain'
  WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_url' END AS early, {q.fp('url')} AS fp FROM split)"""
CACHE_SQL = f"cache AS (SELECT DISTINCT {q.fp('url')} AS fp FROM catalog WHERE quality > 90)"
REASONS = f"""{TESTED}, {CACHE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY early IS NULL, fp ORDER BY source_rank, line_no) AS n FROM tested),
reasons AS (SELECT r.source_rank, r.line_no, r.name, r.url, r.fp, CASE WHEN early IS NOT NULL THEN early
  WHEN c.fp IS NOT NULL THEN 'cached' WHEN n > 1 THEN 'dup_fp' ELSE 'accepted' END AS reject_reason
  FROM ranked r LEFT JOIN cache c ON r.fp = c.fp)"""
NO_CACHE = f"""{TESTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY early IS NULL, fp ORDER BY source_rank, line_no) AS n FROM tested),
reasons AS (SELECT source_rank, line_no, name, url, fp, coalesce(early, CASE WHEN n > 1 THEN 'dup_fp' ELSE 'accepted' END) AS reject_reason FROM ranked),
accepted AS (SELECT * FROM reasons WHERE reject_reason = 'accepted')"""


def _cache(spark, sf):
    from linkloom.functions import urls

    rows = table(spark, sf, "catalog").filter("quality > 90")
    return rows.select(urls.fingerprint(F.col("url")).alias("fp"), F.lit("2024-01-01 05:00:00").cast("timestamp").alias("validated_at"))


def now():
    return F.lit("2024-01-01 08:00:00").cast("timestamp")


def accepted(spark, sf):
    return admission.admit(table(spark, sf, "raw"), blacklist=BLACKLIST, vod_hosts=VOD)


@query("admit_reasons", f"{REASONS} SELECT source_rank, line_no, reject_reason FROM reasons")
def admit_reasons(spark, sf):
    out = admission.admission_reasons(table(spark, sf, "raw"), _cache(spark, sf), now(), 6, BLACKLIST, VOD)
    return out.select(*KEY, "reject_reason")


@query("reject_summary", f"{REASONS} SELECT reject_reason, count(*) AS n FROM reasons GROUP BY 1")
def reject_summary(spark, sf):
    return admission.reject_summary(table(spark, sf, "raw"), _cache(spark, sf), now(), 6, BLACKLIST, VOD)


@query("admitted_entries", f"{REASONS} SELECT source_rank, line_no, name, url, fp, {q.host('url')} AS host FROM reasons WHERE reject_reason = 'accepted'")
def admitted_entries(spark, sf):
    out = admission.admit(table(spark, sf, "raw"), _cache(spark, sf), now(), 6, BLACKLIST, VOD)
    return out.select(*KEY, "name", "url", "fp", "host")


@query("blacklist_names", f"{ctes('catalog')} SELECT source_rank, line_no, name FROM catalog WHERE NOT regexp_matches(name, '(?i)anvil|red ')")
def blacklist_names(spark, sf):
    return filters.drop_blacklisted(table(spark, sf, "catalog"), ["ANVIL", "Red "]).select(*KEY, "name")


@query("dedup_first", f"""{ctes('catalog')}
SELECT source_rank, line_no, {q.fp('url')} AS fp FROM catalog
QUALIFY row_number() OVER (PARTITION BY {q.fp('url')} ORDER BY source_rank, line_no) = 1""")
def dedup_first(spark, sf):
    from linkloom.functions import urls

    df = table(spark, sf, "catalog").withColumn("fp", urls.fingerprint(F.col("url")))
    return admission.dedup_by_fingerprint(df).select(*KEY, "fp")


@query("union_priority", f"""WITH u AS (SELECT 0 AS source_rank, l_orderkey * 8 + l_linenumber AS line_no, l_partkey % 997 AS k FROM lineitem
  UNION ALL SELECT 1, o_orderkey, o_custkey % 1009 FROM orders UNION ALL SELECT 2, p_partkey, p_partkey % 1103 FROM part)
SELECT CAST(source_rank AS BIGINT) AS source_rank, line_no, concat('http://h', k, '.example.com/live/', k, '.m3u8') AS url FROM u
QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_rank, line_no) = 1""")
def union_priority(spark, sf):
    from linkloom.functions import urls

    def entries(t, line_no, k):
        url = F.concat(F.lit("http://h"), k.cast("string"), F.lit(".example.com/live/"), k.cast("string"), F.lit(".m3u8"))
        return table(spark, sf, t).select(line_no.alias("line_no"), url.alias("url"))

    c = F.col
    stacked = admission.union_sources([
        entries("lineitem", c("l_orderkey") * 8 + c("l_linenumber"), c("l_partkey") % 997),
        entries("orders", c("o_orderkey"), c("o_custkey") % 1009),
        entries("part", c("p_partkey"), c("p_partkey") % 1103),
    ])
    return admission.dedup_by_fingerprint(stacked.withColumn("fp", urls.fingerprint(c("url")))).select(*KEY, "url")


@query("topk_per_domain", f"""{NO_CACHE} SELECT source_rank, line_no, {q.host('url')} AS host FROM accepted
QUALIFY row_number() OVER (PARTITION BY {q.host('url')} ORDER BY source_rank, line_no) <= 3""")
def topk_per_domain(spark, sf):
    return admission.topk_per_domain(accepted(spark, sf), 3).select(*KEY, "host")


@query("admit_many_files", f"""{TESTED}, k AS (SELECT *, concat('file', line_no % 3) AS source_id, line_no * 4 + source_rank AS pos FROM tested),
n AS (SELECT *, row_number() OVER (PARTITION BY early IS NULL, fp ORDER BY source_id, pos) AS n FROM k)
SELECT source_id, CAST(pos AS BIGINT) AS line_no, CASE WHEN early IS NOT NULL THEN early WHEN n > 1 THEN 'dup_fp' ELSE 'accepted' END AS reject_reason FROM n""")
def admit_many_files(spark, sf):
    """One table of several files, whose line numbers are told apart by the file."""
    raw = table(spark, sf, "raw").select(
        F.concat(F.lit("file"), (F.col("line_no") % 3).cast("string")).alias("source_id"),
        (F.col("line_no") * 4 + F.col("source_rank")).alias("line_no"), "line",
    )
    reasons = admission.admission_reasons(admission.union_sources([raw]), blacklist=BLACKLIST, vod_hosts=VOD)
    return reasons.select("source_id", "line_no", "reject_reason")


@query("candidate_limit", f"""{NO_CACHE}, h AS (SELECT *, {q.host('url')} AS host FROM accepted),
f AS (SELECT *, first_value(source_rank) OVER w AS fr, first_value(line_no) OVER w AS fl FROM h WINDOW w AS (PARTITION BY host ORDER BY source_rank, line_no))
SELECT source_rank, line_no, host, row_number() OVER (ORDER BY fr, fl, source_rank, line_no) AS candidate_no FROM f QUALIFY candidate_no <= 150""")
def candidate_limit(spark, sf):
    return admission.candidate_limit(accepted(spark, sf), 150).select(*KEY, "host", "candidate_no")


# Channels: every lineitem is a link of a part-named channel.
CHANNELS = """
SELECT l_orderkey * 8 + l_linenumber AS seq, p_type AS category, p_name AS norm_name, CAST(l_quantity AS BIGINT) AS quality,
  concat('http://h', l_suppkey, '.example.com/', l_orderkey, '/', l_linenumber) AS url
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
CH = f"WITH channels AS ({CHANNELS.format(lineitem='lineitem', part='part')})"
RANK = "CASE category WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'SMALL' THEN 3 ELSE 4 END"


def channels(spark, sf):
    return spark.sql(CHANNELS, lineitem=table(spark, sf, "lineitem"), part=table(spark, sf, "part"))


@query("topk_per_name", f"""{CH} SELECT category, norm_name, seq, url, quality, row_number() OVER (PARTITION BY category, norm_name ORDER BY quality DESC, seq) AS rn
FROM channels QUALIFY rn <= 2""")
def topk_per_name(spark, sf):
    return ranking.topk_per_name(channels(spark, sf), 2).select("category", "norm_name", "seq", "url", "quality", "rn")


@query("group_best", f"{CH} SELECT category, norm_name, max(quality) AS best, min(seq) AS first_seq, count(*) AS n_links FROM channels GROUP BY ALL")
def group_best(spark, sf):
    return ranking.group_best(channels(spark, sf))


@query("global_cap", f"""{CH}, b AS (SELECT *, max(quality) OVER w AS best, min(seq) OVER w AS first_seq,
  row_number() OVER (PARTITION BY category, norm_name ORDER BY quality DESC, seq) AS rn FROM channels WINDOW w AS (PARTITION BY category, norm_name))
SELECT row_number() OVER (ORDER BY {RANK}, -best, first_seq, norm_name, rn, category) AS line_no, category, norm_name, url FROM b WHERE rn <= 2 QUALIFY line_no <= 200""")
def global_cap(spark, sf):
    df = channels(spark, sf)
    top = ranking.with_channel_stats(ranking.topk_per_name(df, 2), ranking.group_best(df))
    order = [ranking.category_rank(F.col("category"), ORDER), -F.col("best"), F.col("first_seq"), F.col("norm_name"), F.col("rn"), F.col("category")]
    return ranking.global_cap(top, order, 200).select("line_no", "category", "norm_name", "url")


@query("category_rank", f"{CH} SELECT DISTINCT category, CAST({RANK} AS BIGINT) AS cat_rank FROM channels")
def category_rank(spark, sf):
    return channels(spark, sf).select("category").distinct().withColumn("cat_rank", ranking.category_rank(F.col("category"), ORDER))


@query("quality_order", f"""{CH}, b AS (SELECT norm_name, category, max(quality) AS best, min(seq) AS first_seq FROM channels GROUP BY ALL)
SELECT category, norm_name, row_number() OVER (ORDER BY best DESC, first_seq, category, norm_name) AS position FROM b""")
def quality_order(spark, sf):
    best = ranking.group_best(channels(spark, sf))
    order = [F.desc("best"), F.asc("first_seq"), F.asc("category"), F.asc("norm_name")]
    return ranking.order_channels(best, order).select("category", "norm_name", "position")


# Brands as numbered channels: Brand#5 also as 5+, some without a number.
NUMBERED = """
SELECT p_partkey AS seq, CAST(p_size AS BIGINT) AS quality, CASE WHEN p_size % 10 = 0 THEN p_name
  WHEN p_brand = 'Brand#5' AND p_size % 2 = 0 THEN 'CCTV5+' ELSE concat('CCTV', replace(p_brand, 'Brand#', '')) END AS norm_name
FROM {part}
"""
NUM = f"""WITH n AS ({NUMBERED.format(part='part')}), b AS (SELECT norm_name, max(quality) AS best, min(seq) AS first_seq,
  TRY_CAST(regexp_extract(norm_name, '^CCTV([0-9]+)', 1) AS BIGINT) AS num FROM n GROUP BY norm_name)"""


def _numbered(spark, sf):
    return ranking.group_best(spark.sql(NUMBERED, part=table(spark, sf, "part")), ["norm_name"])


@query("natural_order", f"""{NUM} SELECT norm_name, row_number() OVER (ORDER BY coalesce(num, 999), CASE WHEN num IS NULL THEN -best
  WHEN norm_name = 'CCTV5+' THEN 1 ELSE 0 END, first_seq, norm_name) AS position FROM b""")
def natural_order(spark, sf):
    keys = ranking.natural_keys(F.col("norm_name"), F.col("best"), F.lit(True))
    order = [*keys, F.col("first_seq"), F.col("norm_name")]
    return ranking.order_channels(_numbered(spark, sf), order).select("norm_name", "position")


@query("tier_order", f"""{NUM}, t AS (SELECT *, CASE WHEN norm_name = 'CCTV5+' THEN 1 WHEN num BETWEEN 1 AND 17 THEN 0 WHEN num IS NOT NULL THEN 2 ELSE 3 END AS tier FROM b)
SELECT norm_name, row_number() OVER (ORDER BY tier, CASE WHEN tier IN (0, 2) THEN num ELSE 0 END, CASE WHEN tier = 3 THEN -best ELSE 0 END, first_seq, norm_name) AS position FROM t""")
def tier_order(spark, sf):
    keys = ranking.tier_keys(F.col("norm_name"), F.col("best"))
    order = [*keys, F.col("first_seq"), F.col("norm_name")]
    return ranking.order_channels(_numbered(spark, sf), order).select("norm_name", "position")


@query("full_order", f"""{CH} SELECT seq, row_number() OVER (ORDER BY quality DESC, category, seq) AS line_no FROM channels""")
def full_order(spark, sf):
    """Numbering of every link without a cap: a distributed sort, no single-task window."""
    return rank_by(channels(spark, sf).select("seq", "quality", "category"), [F.desc("quality"), F.asc("category"), F.asc("seq")], "line_no").select("seq", "line_no")


@query("fallback_fill", f"""{CH}, f AS (SELECT *, quality < 45 AS is_fallback FROM channels), r AS (SELECT *, row_number() OVER (PARTITION BY category, norm_name, url, is_fallback ORDER BY quality DESC, seq) AS one FROM f),
k AS (SELECT category, norm_name, seq, quality, is_fallback, row_number() OVER (PARTITION BY category, norm_name, seq % 11, is_fallback ORDER BY quality DESC, seq) AS rn,
  count(*) FILTER (NOT is_fallback) OVER (PARTITION BY category, norm_name, seq % 11) AS good, seq % 11 AS part_no FROM r)
SELECT category, norm_name, part_no, seq, quality, is_fallback, rn FROM k WHERE good > 0 AND ((NOT is_fallback AND rn <= 3) OR (is_fallback AND good < 3 AND rn <= greatest(3 - good, 1)))""")
def fallback_fill(spark, sf):
    df = channels(spark, sf).withColumn("part_no", F.col("seq") % 11)
    out = ranking.fallback_fill(df, 3, 45, ["category", "norm_name", "part_no"])
    return out.select("category", "norm_name", "part_no", "seq", "quality", "is_fallback", "rn")


@query("quota_alloc", """WITH c AS (SELECT CASE WHEN p_type IN ('PROMO', 'LARGE', 'MEDIUM', 'SMALL') THEN p_type ELSE 'STANDARD' END AS category, count(DISTINCT p_brand || p_size) AS n FROM part GROUP BY 1),
t AS (SELECT *, CASE category WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'SMALL' THEN 3 ELSE 4 END AS rank,
  sum(n) OVER () AS total, sum(CASE WHEN category = 'STANDARD' THEN n ELSE 0 END) OVER () AS other FROM c),
o AS (SELECT *, greatest(30, (other * 500) // total) AS oq FROM t),
s AS (SELECT *, CASE WHEN category = 'STANDARD' THEN oq ELSE (n * greatest(0, 500 - oq)) // greatest(total - other, 1) END AS base FROM o)
SELECT category, CAST(rank AS BIGINT) AS rank, n, CAST(base + CASE WHEN rank = min(rank) OVER () THEN 500 - sum(base) OVER () ELSE 0 END AS BIGINT) AS quota FROM s""")
def quota_alloc(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_type").alias("category"), F.concat("p_brand", F.col("p_size").cast("string")).alias("norm_name"))
    return ranking.proportional_quota(df, 500, ORDER, ["STANDARD"])


@query("cap_display3", f"""{GROUPED_CTE}, {GROUPED_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY group_run, name ORDER BY line_no) AS rn FROM rows_ WHERE name <> '' AND url <> '')
SELECT group_run, category, name, url, line_no, min(line_no) OVER (PARTITION BY group_run, name) AS name_at, rn FROM k WHERE rn <= 3""")
def cap_display3(spark, sf):
    rows = read_grouped_catalog(grouped_lines(spark, sf))
    return ranking.cap_per_display_name(rows, 3).select("group_run", "category", "name", "url", "line_no", "name_at", "rn")


@query("group_break", f"{ctes('catalog')} SELECT line_no, category, category IS DISTINCT FROM lag(category) OVER (ORDER BY line_no) AS is_break FROM catalog")
def group_break(spark, sf):
    return publish.group_break_flag(table(spark, sf, "catalog")).select("line_no", "category", "is_break")


@query("catalog_rows", f"""{ctes('catalog')}, b AS (SELECT *, category IS DISTINCT FROM lag(category) OVER (ORDER BY line_no) AS is_break FROM catalog)
SELECT line_no, CAST(0 AS BIGINT) AS part, concat(category, ',#genre#') AS text FROM b WHERE is_break
UNION ALL SELECT line_no, 1, concat(name, ',', url) FROM b""")
def catalog_rows(spark, sf):
    return publish.catalog_rows(table(spark, sf, "catalog"))


_LABELS = """SELECT * FROM (VALUES ('PROMO', 'Promo'), ('LARGE', 'Big'), ('MEDIUM', 'Big')) AS v(category, label)"""


@query("m3u_rows", f"""{ctes('catalog')}, t AS (SELECT c.*, coalesce(label, c.category) AS g FROM catalog c LEFT JOIN ({_LABELS}) l ON c.category = l.category),
b AS (SELECT *, g IS DISTINCT FROM lag(g) OVER (ORDER BY line_no) AS is_break FROM t)
SELECT line_no, CAST(0 AS BIGINT) AS part, concat('#EXTGRP:', g) AS text FROM b WHERE is_break
UNION ALL SELECT line_no, 1, concat('#EXTINF:-1 group-title="', g, '",', name) FROM b UNION ALL SELECT line_no, 2, url FROM b""")
def m3u_rows(spark, sf):
    return publish.m3u_rows(table(spark, sf, "catalog"), spark.sql(_LABELS))


@query("m3u_rows_compat", f"""{ctes('catalog')}, t AS (SELECT *, left(category, length(category) - 1) AS g FROM catalog),
b AS (SELECT *, g IS DISTINCT FROM lag(g) OVER (ORDER BY line_no) AS is_break FROM t)
SELECT line_no, CAST(0 AS BIGINT) AS part, concat('#EXTGRP:', g) AS text FROM b WHERE is_break
UNION ALL SELECT line_no, 1, concat('#EXTINF:-1 group-title="', g, '",', name) FROM b UNION ALL SELECT line_no, 2, url FROM b""")
def m3u_rows_compat(spark, sf):
    return publish.m3u_rows(table(spark, sf, "catalog"), compat=True)


@query("category_label", f"SELECT p_partkey, p_type AS category, coalesce(label, p_type) AS label FROM part LEFT JOIN ({_LABELS}) l ON p_type = l.category")
def category_label(spark, sf):
    from linkloom.operators.matching import label_join

    df = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"))
    return label_join(df, spark.sql(_LABELS)).select("p_partkey", "category", "label")


@query("catalog_summary", f"{CH} SELECT count(*) AS n_channels, count(DISTINCT category) AS n_groups FROM channels")
def catalog_summary(spark, sf):
    return runs.catalog_summary(channels(spark, sf))


@query("category_counts", f"""{CH} SELECT v.category, count(c.category) AS n, CAST(v.r AS BIGINT) AS cat_rank FROM
(VALUES ('PROMO', 0), ('LARGE', 1), ('MEDIUM', 2), ('SMALL', 3), ('STANDARD', 4), ('NONE', 5)) AS v(category, r)
LEFT JOIN channels c ON c.category = v.category GROUP BY v.category, v.r""")
def category_counts(spark, sf):
    return runs.category_counts(channels(spark, sf), ORDER + ["NONE"])


@query("enforced_quota", f"""{CH}, c AS (SELECT CASE WHEN category IN ('PROMO', 'LARGE', 'MEDIUM', 'SMALL') THEN category ELSE 'STANDARD' END AS category, count(DISTINCT norm_name) AS n FROM channels GROUP BY 1),
t AS (SELECT *, {RANK} AS rank, sum(n) OVER () AS total, sum(CASE WHEN category = 'STANDARD' THEN n ELSE 0 END) OVER () AS other FROM c),
o AS (SELECT *, greatest(30, (other * 500) // total) AS oq FROM t),
s AS (SELECT *, CASE WHEN category = 'STANDARD' THEN oq ELSE (n * greatest(0, 500 - oq)) // greatest(total - other, 1) END AS base FROM o),
qt AS (SELECT category, base + CASE WHEN rank = min(rank) OVER () THEN 500 - sum(base) OVER () ELSE 0 END AS quota FROM s),
m AS (SELECT *, CASE WHEN category IN ('PROMO', 'LARGE', 'MEDIUM', 'SMALL') THEN category ELSE 'STANDARD' END AS listed FROM channels),
r AS (SELECT category, listed, seq, quality, row_number() OVER (PARTITION BY listed ORDER BY quality DESC, seq) AS n FROM m)
SELECT r.category, seq, quality FROM r JOIN qt ON r.listed = qt.category WHERE n <= quota""")
def enforced_quota(spark, sf):
    df = channels(spark, sf)
    quota = ranking.proportional_quota(df, 500, ORDER, ["STANDARD"])
    return ranking.enforce_quota(df, quota, [-F.col("quality"), F.col("seq")], ORDER).select("category", "seq", "quality")


@query("failed_rows", f"{ctes('catalog')} SELECT concat(name, ',', url) AS line FROM catalog WHERE quality < 50")
def failed_rows(spark, sf):
    return publish.failed_rows(table(spark, sf, "catalog").filter("quality < 50"))
