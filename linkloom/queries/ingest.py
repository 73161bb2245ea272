"""Queries over catalog and playlist texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import filters, publish, runs
from linkloom.queries import sql as q
from linkloom.queries.carriers import ctes, table
from linkloom.queries.registry import query
from linkloom.scale import shared_dir
from linkloom.sources import catalogs, playlists, rulesets


def _doc_lines(source: str, key: str, text: str) -> str:
    """Non-blank trimmed lines of whole texts, as a CTE body."""
    return (
        f"SELECT {key}, CAST(line_no AS BIGINT) AS line_no, {q.strip('raw_line')} AS line FROM (SELECT {key}, "
        f"unnest(ls) AS raw_line, unnest(range(len(ls))) AS line_no FROM (SELECT {key}, {q.split_lines(text)} AS ls FROM {source}))"
    )


@query("split_catalog_lines", f"""WITH l AS ({_doc_lines('documents', 'doc_id', 'text')})
SELECT doc_id, line_no, CASE WHEN contains(line, ',') THEN {q.strip("split_part(line, ',', 1)")} END AS name,
  CASE WHEN contains(line, ',') THEN {q.strip(q.after_comma('line'))} END AS url FROM l WHERE line <> ''""")
def split_catalog_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return catalogs.split_entries(catalogs.explode_lines(docs, ["doc_id"])).select("doc_id", "line_no", "name", "url")


_PENDING = """
e AS (SELECT {key}, line_no, line, CASE
    WHEN line LIKE '#EXTINF:%' AND regexp_matches(line, ',[^,]+$') THEN 'info'
    WHEN regexp_matches(line, '^https?://') THEN 'url'
    WHEN line NOT LIKE '#%' AND contains(line, ',') AND line NOT LIKE '%,#genre#' AND {second} LIKE 'http%' THEN 'pair' END AS kind
  FROM l),
island AS (SELECT *, count(*) FILTER (kind = 'url') OVER (PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM e),
named AS (SELECT {key}, coalesce(g, 0) AS g, arg_max({info}, line_no) AS pending FROM island WHERE kind = 'info' GROUP BY ALL)
SELECT i.{key}, i.line_no, CASE WHEN pending <> '' THEN pending ELSE {netloc} END AS name, line AS url
FROM island i LEFT JOIN named n ON i.{key} = n.{key} AND coalesce(i.g, 0) = n.g WHERE kind = 'url'
UNION ALL SELECT {key}, line_no, {first}, {second} FROM e WHERE kind = 'pair'"""


def _pending(key: str) -> str:
    return _PENDING.format(
        key=key, second=q.strip(q.after_comma("line")), first=q.strip("split_part(line, ',', 1)"),
        info=q.strip("regexp_extract(line, ',([^,]+)$', 1)"), netloc=q.netloc("line"),
    )


@query("m3u_pending_name", f"{ctes('playlist')}, l AS (SELECT doc, line_no, {q.strip('line')} AS line FROM playlist), {_pending('doc')}")
def m3u_pending_name(spark, sf):
    return playlists.parse_lines(table(spark, sf, "playlist"), "pending", ["doc"])


@query("m3u_docs_pending", f"{ctes('docs')}, l AS ({_doc_lines('docs', 'doc_id', 'content')}), {_pending('doc_id')}")
def m3u_docs_pending(spark, sf):
    return playlists.ingest_playlists(table(spark, sf, "docs"), "pending", ["doc_id"])


_ADJACENT = """
r AS (SELECT *, lag(line) OVER w AS before, CAST(line LIKE '#EXTINF:%' AS INTEGER) AS is_info,
    row_number() OVER w - 1 AS pos FROM l WINDOW w AS (PARTITION BY {key} ORDER BY line_no)),
g AS (SELECT *, row_number() OVER (PARTITION BY {key}, is_info ORDER BY pos) AS k FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY {key}, is_info, pos - k ORDER BY pos) AS run_pos FROM g),
i AS (SELECT *, lag(run_pos) OVER (PARTITION BY {key} ORDER BY pos) AS before_pos FROM h),
o AS (SELECT *, coalesce(before LIKE '#EXTINF:%' AND before_pos % 2 = 1, false) AS consumed FROM i WHERE is_info = 0)
SELECT {key}, line_no, CASE WHEN NOT consumed THEN {first}
    WHEN regexp_matches(before, 'tvg-name="([^"]*)"') THEN regexp_extract(before, 'tvg-name="([^"]*)"', 1)
    WHEN contains(before, ',') THEN {after} ELSE '未知频道' END AS name,
  CASE WHEN consumed THEN line ELSE {second} END AS url
FROM o WHERE line <> '' AND line NOT LIKE '#%' AND (consumed OR contains(line, ','))"""


def _adjacent(key: str) -> str:
    return _ADJACENT.format(
        key=key, first=q.strip("split_part(line, ',', 1)"), second=q.strip(q.after_comma("line")),
        after=q.strip(q.after_comma("before")),
    )


@query("m3u_adjacent", f"{ctes('playlist')}, l AS (SELECT doc, line_no, {q.strip('line')} AS line FROM playlist), {_adjacent('doc')}")
def m3u_adjacent(spark, sf):
    return playlists.parse_lines(table(spark, sf, "playlist"), "adjacent", ["doc"])


@query("m3u_docs_adjacent", f"{ctes('docs')}, l AS ({_doc_lines('docs', 'doc_id', q.strip('content'))}), {_adjacent('doc_id')}")
def m3u_docs_adjacent(spark, sf):
    return playlists.ingest_playlists(table(spark, sf, "docs"), "adjacent", ["doc_id"])


_LEGACY = """
e AS (SELECT {key}, line_no, line, CASE
    WHEN line LIKE '#EXTINF:%' AND regexp_matches(line, 'tvg-name="([^"]*)"') THEN regexp_extract(line, 'tvg-name="([^"]*)"', 1)
    WHEN line LIKE '#EXTINF:%' AND regexp_matches(line, ',[^,]+$') THEN {info}
    WHEN line NOT LIKE '#%' AND line NOT LIKE 'http%' AND contains(line, ',') THEN {first} END AS sets,
    line LIKE 'http%' AS is_url, line NOT LIKE '#%' AND line NOT LIKE 'http%' AND contains(line, ',') AND {second} LIKE 'http%' AS is_pair
  FROM l),
island AS (SELECT *, coalesce(count(*) FILTER (is_url) OVER (PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e),
named AS (SELECT {key}, g, arg_max(sets, line_no) AS pending FROM island WHERE sets IS NOT NULL AND NOT is_url GROUP BY ALL)
SELECT i.{key}, i.line_no, CASE WHEN pending <> '' THEN pending ELSE '未知频道' END AS name, line AS url
FROM island i LEFT JOIN named n ON i.{key} = n.{key} AND i.g = n.g WHERE is_url
UNION ALL SELECT {key}, line_no, sets, {second} FROM e WHERE is_pair"""


def _legacy(key: str) -> str:
    return _LEGACY.format(
        key=key, first=q.strip("split_part(line, ',', 1)"), second=q.strip(q.after_comma("line")),
        info=q.strip("regexp_extract(line, ',([^,]+)$', 1)"),
    )


@query("m3u_legacy", f"{ctes('playlist')}, l AS (SELECT doc, line_no, {q.strip('line')} AS line FROM playlist), {_legacy('doc')}")
def m3u_legacy(spark, sf):
    return playlists.parse_lines(table(spark, sf, "playlist"), "legacy", ["doc"])


@query("m3u_docs_legacy", f"{ctes('docs')}, l AS ({_doc_lines('docs', 'doc_id', 'content')}), {_legacy('doc_id')}")
def m3u_docs_legacy(spark, sf):
    return playlists.ingest_playlists(table(spark, sf, "docs"), "legacy", ["doc_id"])


@query("sniff_format", f"""{ctes('docs')}
SELECT doc_id, len(list_filter(list_slice({q.split_lines('content')}, 1, 10), lambda x: x LIKE '#EXTM3U%')) > 0 AS is_m3u
FROM docs WHERE length(content) > 700""")
def sniff_format(spark, sf):
    return playlists.sniff_format(table(spark, sf, "docs"), min_chars=700).select("doc_id", "is_m3u")


@query("feed_short_names", f"""WITH f AS (SELECT page_id, regexp_replace(url, '[?#/]+[^/]*$', '') AS url FROM pages),
d AS (SELECT url, min(page_id) AS ord FROM f WHERE url LIKE 'http%' GROUP BY url),
s AS (SELECT *, CASE WHEN seg = '' THEN {q.netloc('url')} ELSE concat({q.netloc('url')}, '/', seg) END AS short FROM
  (SELECT *, regexp_extract(regexp_replace({q.path('url')}, '^/+|/+$', '', 'g'), '([^/]*)$', 1) AS seg FROM d))
SELECT ord, url, CASE WHEN n > 1 THEN concat(short, '#', n - 1) ELSE short END AS short_name FROM
  (SELECT *, row_number() OVER (PARTITION BY short ORDER BY ord) AS n FROM s)""")
def feed_short_names(spark, sf):
    feeds = table(spark, sf, "pages").select(
        F.col("page_id").alias("ord"), F.regexp_replace("url", "[?#/]+[^/]*$", "").alias("url")
    )
    return rulesets.feed_list(feeds).select("ord", "url", "short_name")


@query("pipe_catalog", f"""{ctes('catalog')}
SELECT line_no, category, name, url FROM catalog""")
def pipe_catalog(spark, sf):
    raw = table(spark, sf, "catalog").select("line_no", F.concat(F.col("category"), F.lit("|"), F.col("name"), F.lit(","), F.col("url")).alias("line"))
    return catalogs.read_legacy_catalog(raw).select("line_no", "category", "name", "url")


# A header every few rows, the same group at times coming back.
_GROUPED = """
SELECT line_no * 2 AS line_no, concat(category, ',#genre#') AS line FROM {catalog} WHERE quality > 60
UNION ALL SELECT line_no * 2 + 1, concat(name, ',', url) FROM {catalog}"""


def grouped_lines(spark, sf):
    return spark.sql(_GROUPED, catalog=table(spark, sf, "catalog"))


GROUPED_CTE = f"{ctes('catalog')}, grouped AS ({_GROUPED.format(catalog='catalog')})"
GROUPED_ROWS = f"""f AS (SELECT *, last_value(CASE WHEN line LIKE '%,#genre#' THEN line_no END IGNORE NULLS) OVER w AS group_run,
  last_value(CASE WHEN line LIKE '%,#genre#' THEN replace(line, ',#genre#', '') END IGNORE NULLS) OVER w AS category
  FROM grouped WINDOW w AS (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rows_ AS (SELECT line_no, group_run, category, {q.strip("split_part(line, ',', 1)")} AS name, {q.strip(q.after_comma('line'))} AS url
  FROM f WHERE line NOT LIKE '%,#genre#' AND group_run IS NOT NULL)"""


@query("group_forward_fill", f"{GROUPED_CTE}, {GROUPED_ROWS} SELECT * FROM rows_")
def group_forward_fill(spark, sf):
    return catalogs.read_grouped_catalog(grouped_lines(spark, sf)).select("line_no", "group_run", "category", "name", "url")


@query("antibot_filter", f"""SELECT 'pages' AS src, page_id AS id FROM pages WHERE NOT regexp_matches(lower(substring({q.strip('html')}, 1, 200)),
  '<!doctype|<html|[{{]"code"|<script|cloudfront|accessdenied|rate limit')
UNION ALL SELECT 'documents', doc_id FROM documents WHERE NOT regexp_matches(lower(substring({q.strip('text')}, 1, 200)),
  '<!doctype|<html|[{{]"code"|<script|cloudfront|accessdenied|rate limit')""")
def antibot_filter(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("content"))
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return filters.filter_antibot(pages.unionByName(docs)).select("src", "id")


@query("antibot_filter_legacy", f"""{ctes('docs')} SELECT doc_id FROM docs WHERE length(content) >= 50
  AND NOT regexp_matches(lower(substring({q.strip('content')}, 1, 500)), '<!doctype html|<html|[{{]"code"')""")
def antibot_filter_legacy(spark, sf):
    return filters.filter_antibot(table(spark, sf, "docs"), legacy=True).select("doc_id")


@query("feed_yield", f"""{ctes('playlist')}, l AS (SELECT doc, line_no, {q.strip('line')} AS line FROM playlist),
n AS (SELECT doc, count(*) AS n FROM l WHERE regexp_matches(line, '^https?://') OR
  (line NOT LIKE '#%' AND contains(line, ',') AND line NOT LIKE '%,#genre#' AND {q.strip(q.after_comma('line'))} LIKE 'http%') GROUP BY doc)
SELECT d.doc, coalesce(n, 0) AS n_entries, coalesce(n, 0) > 0 AS ok FROM
  (SELECT DISTINCT doc FROM l UNION SELECT -1 - page_id FROM pages) d LEFT JOIN n ON d.doc = n.doc""")
def feed_yield(spark, sf):
    lines = table(spark, sf, "playlist")
    entries = playlists.parse_lines(lines, "pending", ["doc"])
    # Pages stand for feeds without entries.
    empty = table(spark, sf, "pages").select((F.lit(-1) - F.col("page_id")).alias("doc"))
    return runs.feed_yield(lines.select("doc").unionByName(empty), entries, "doc")


# Catalog files of several kinds of line break inside physical lines, read whole and in splits.
_BREAKS = ["\x0b", "\x0c", "\x85", "\u2028", "\u2029", "\x1c"]
_SQL_BREAKS = ", ".join(f"chr({ord(b)})" for b in _BREAKS)


_FILE_RECORDS = 20_000


def _broken_lines(spark, sf):
    breaks = F.array(*[F.lit(b) for b in _BREAKS])
    between = F.element_at(breaks, (F.col("doc_id") % len(_BREAKS) + 1).cast("int"))
    tail = F.concat_ws("", F.lit("tail"), F.col("doc_id").cast("string"), F.lit(",http://h/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(F.concat(
        F.lit("doc"), F.col("doc_id").cast("string"), F.lit(","), F.regexp_replace("text", "[\\r\\n]+", " "), between, F.lit("  "), between, F.lit(" "), tail,
    ).alias("value"))


_BROKEN = f"""f AS (SELECT doc_id, ([{_SQL_BREAKS}])[CAST(doc_id % {len(_BREAKS)} + 1 AS BIGINT)] AS b, regexp_replace(text, '[\r\n]+', ' ', 'g') AS t FROM documents),
p AS (SELECT concat('doc', doc_id, ',', t, b, '  ', b, ' tail', doc_id, ',http://h/', doc_id) AS value FROM f),
e AS (SELECT {q.strip('raw')} AS line FROM (SELECT unnest({q.split_lines('value')}) AS raw FROM p)),
n AS (SELECT CASE WHEN contains(line, ',') THEN {q.strip("split_part(line, ',', 1)")} END AS name, CASE WHEN contains(line, ',') THEN {q.strip(q.after_comma('line'))} END AS url FROM e WHERE line <> '')"""


@query("large_catalog", f"WITH {_BROKEN} SELECT name, url, count(*) AS n, true AS agree FROM n GROUP BY ALL")
def large_catalog(spark, sf):
    """Both readers on the same files: the same entries, in the same order.

    Places are told and compared by digests of the entries; a text goes to one shuffle, that which counts the equal ones.
    """
    folder = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    # Files that one reader takes whole stay small; a task writes several.
    _broken_lines(spark, sf).write.option("maxRecordsPerFile", _FILE_RECORDS).text(folder)

    def digest(*cells):
        said = [part for c in cells for part in (F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))]
        return F.unhex(F.sha2(F.concat(*said), 256))

    entry, none = digest(F.col("name"), F.col("url")).alias("entry"), F.lit(None).cast("string")
    whole, split = catalogs.read_catalog(spark, folder), catalogs.read_large_catalog(spark, folder)
    keys = ["file", "place"]
    # A file written by one task, by its name below the folder.
    file = F.substring_index("source_id", "/", -1).alias("file")
    at = Window.partitionBy("file").orderBy("line_no")
    a = whole.select(file, "line_no", entry).select("file", F.row_number().over(at).alias("place"), "entry")
    b = split.select(file, "line_no", entry).select("file", F.row_number().over(at).alias("place"), F.col("entry").alias("other"))
    both = a.join(b, keys, "full_outer").withColumn("agree", F.col("entry").eqNullSafe(F.col("other")))
    # Entries that only the other reader has are counted as one without name and url.
    counted = both.groupBy(F.coalesce("entry", digest(none, none)).alias("entry")).agg(F.count("*").alias("n"), F.every("agree").alias("agree"))
    shown = whole.select(entry, "name", "url").dropDuplicates(["entry"])
    return counted.join(shown, "entry", "left").select("name", "url", "n", "agree")


@query("load_rules", """WITH o AS (SELECT p_type AS category, row_number() OVER (ORDER BY p_type) - 1 AS cat_rank FROM (SELECT DISTINCT p_type FROM part)),
k AS (SELECT p_type AS category, p_brand AS keyword, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS ord FROM (SELECT DISTINCT p_type, p_brand FROM part)),
w AS (SELECT n_name AS value, row_number() OVER (ORDER BY n_name) - 1 AS ord FROM nation)
SELECT 'rule' AS kind, category, CAST(cat_rank AS INTEGER) AS cat_rank, CAST(ord AS INTEGER) AS ord, keyword AS value FROM k JOIN o USING (category)
UNION ALL SELECT 'blacklist', NULL, NULL, CAST(ord AS INTEGER), value FROM w
UNION ALL SELECT 'order', category, CAST(cat_rank AS INTEGER), NULL, category FROM o UNION ALL SELECT 'threshold', NULL, NULL, 7, '0.25'""")
def load_rules(spark, sf):
    """A rule file written from the parts' types and brands and the nations' names, loaded as tables."""
    part = table(spark, sf, "part")
    words = part.groupBy(F.col("p_type").alias("key")).agg(F.sort_array(F.collect_set("p_brand")).alias("value"))
    by_type = words.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("rules"))
    order = part.agg(F.sort_array(F.collect_set("p_type")).alias("order"))
    black = table(spark, sf, "nation").agg(F.sort_array(F.collect_set("n_name")).alias("blacklist"))
    # One row each, joined on nothing but their being one.
    one = [df.withColumn("_one", F.lit(1)) for df in (by_type, order, black)]
    doc = one[0].join(one[1], "_one").join(one[2], "_one").select(F.to_json(F.struct(
        F.struct("order", "rules").alias("categories"), F.struct("blacklist").alias("filter"),
        F.struct(F.lit(7).alias("cache_ttl_hours"), F.lit(0.25).alias("min_speed_mbps")).alias("quality"),
    )).alias("value"))
    folder = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    doc.write.text(folder)
    got = rulesets.load_rules(spark, folder)
    none = F.lit(None)
    return (
        got.rules.select(F.lit("rule").alias("kind"), "category", "cat_rank", "ord", F.col("keyword").alias("value"))
        .union(got.keywords.select("kind", none.cast("string"), none.cast("int"), "ord", "value"))
        .union(got.category_order.select(F.lit("order"), "category", "cat_rank", none.cast("int"), F.col("category")))
        .union(got.thresholds.select(F.lit("threshold"), none.cast("string"), none.cast("int"), F.col("cache_ttl_hours").cast("int"), F.col("min_speed_mbps").cast("string")))
    )


@query("append_run_stats", f"{ctes('runs')} SELECT run_date, total, valid FROM runs ORDER BY run_date DESC LIMIT 20")
def append_run_stats(spark, sf):
    """The history of the runs, appended in three lots, and its newest rows."""
    days = table(spark, sf, "runs")
    folder = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    for lot in range(3):
        publish.append_run_stats(days.filter(F.dayofyear("run_date") % 3 == lot), folder)
    return publish.read_last_runs(spark, folder, 20, "run_date")
