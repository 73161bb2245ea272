"""Inputs of the registered queries.

The test tables hold no playlists, so each query runs on a deterministic projection of a whole
table. The projections are SQL text shared by Spark and DuckDB; ``{name}`` is an input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Catalog entries with every kind of rejection, repeated fingerprints, and a quality.
CATALOG = """
SELECT CAST(p_partkey % 5 AS BIGINT) AS source_rank, CAST(p_partkey AS BIGINT) AS line_no,
  p_type AS category, CAST(p_size * 2 AS BIGINT) AS quality, p_brand AS brand,
  CASE WHEN p_partkey % 11 = 4 THEN '' ELSE p_name END AS name,
  CASE p_partkey % 11
    WHEN 1 THEN concat('http://', CASE p_size % 5 WHEN 0 THEN '192.168.1.' WHEN 1 THEN '10.0.8.'
      WHEN 2 THEN '172.20.0.' WHEN 3 THEN '8.8.4.' ELSE '100.64.0.' END, p_size, '/live/a.m3u8')
    WHEN 2 THEN concat('http://v.jd.com/', p_partkey, '.m3u8')
    WHEN 3 THEN concat('rtp://239.1.1.', p_size, ':5000')
    WHEN 5 THEN concat('http://[', CASE p_size % 2 WHEN 0 THEN '2409:8087:' ELSE 'fe80:' END, p_size,
      '::1]:8080/live/', p_partkey % 20, '.m3u8')
    WHEN 6 THEN concat('https://cdn8.tencentplay', p_size, '.example.com/tv/', p_partkey % 20, '.php?type=m3u&key=', p_size)
    ELSE concat('http://', lower(replace(p_brand, '#', '')), '.example.com:8080/live/', p_partkey % 20,
      '/index.m3u8?id=', p_partkey) END AS url
FROM {part}
"""

# Raw lines of the same entries; some have no comma.
RAW = """
SELECT source_rank, line_no, CASE WHEN line_no % 11 = 0 THEN name ELSE concat(name, ',', url) END AS line
FROM {catalog}
"""

# Playlists of 40 entries: info lines with and without names, comments, blanks, repeated info lines.
PLAYLIST = """
SELECT CAST(floor(line_no / 40) AS BIGINT) AS doc, (line_no % 40) * 3 AS line_no,
  CASE WHEN line_no % 9 = 0 THEN '#EXTINF:-1' WHEN line_no % 5 = 0 THEN concat('#EXTINF:-1,', name)
    ELSE concat('#EXTINF:-1 tvg-name="', upper(name), '" group-title="', category, '",', name) END AS line
FROM {catalog}
UNION ALL
SELECT CAST(floor(line_no / 40) AS BIGINT), (line_no % 40) * 3 + 1,
  CASE WHEN line_no % 7 = 0 THEN '#EXTVLCOPT:x' WHEN line_no % 7 = 1 THEN ''
    WHEN line_no % 7 = 2 THEN concat(name, ',', url) WHEN line_no % 7 = 3 THEN concat(category, ',#genre#')
    ELSE concat('#EXTINF:-1,', brand) END
FROM {catalog}
UNION ALL
SELECT CAST(floor(line_no / 40) AS BIGINT), (line_no % 40) * 3 + 2, url FROM {catalog}
"""

# Probe evidence of links.
PROBE = """
SELECT event_id AS seq, user_id AS link_id, ts AS probed_at,
  CAST(CASE event_type WHEN 'error' THEN 503 WHEN 'purchase' THEN 404 WHEN 'signup' THEN 302
       WHEN 'click' THEN 206 ELSE 200 END AS BIGINT) AS status,
  value / CAST(30 AS DOUBLE) AS latency_s, value / CAST(100 AS DOUBLE) AS speed,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 15000 AS content_length,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 20 AS bytes,
  concat('width=', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 16, ' height=',
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 9) AS stdout,
  CASE event_id % 3 WHEN 0 THEN 'text/html' ELSE 'video/mp2t' END AS content_type,
  concat(CASE event_id % 5 WHEN 0 THEN '#EXTM3U' WHEN 1 THEN 'G' WHEN 2 THEN 'FLV' WHEN 3 THEN '<html>'
    ELSE '    ftyp' END, CASE WHEN event_id % 7 = 0 THEN '' ELSE props || event_type || event_type || event_type END) AS head
FROM {events}
"""

# Feed scans: some feeds are only in the first scan, some only in the second, some twice.
FEED = """
SELECT concat('http://feed', CAST(floor(doc_id / 2) AS BIGINT), '.example.com/tv.m3u') AS url, doc_id AS scan_no,
  CAST(n_chars % 2 AS BIGINT) AS snapshot, text AS content
FROM {documents}
"""

# One run per day.
RUNS = """
SELECT CAST(ts AS DATE) AS run_date, CAST(count(*) AS BIGINT) AS total,
  CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS valid
FROM {events} GROUP BY CAST(ts AS DATE)
"""

# Raw names: mixed case, brackets, traditional characters and blacklist words, alone or with a part name.
NAMES = """
SELECT CAST(p.p_partkey AS BIGINT) AS seq, CASE p.p_partkey % 3 WHEN 0 THEN v.raw
  WHEN 1 THEN concat(v.raw, '(', p.p_name, ')') ELSE concat(p.p_name, ' ', v.raw) END AS name
FROM {part} p JOIN (VALUES (0, 'CCTV-1综合'), (1, 'cctv5+ HD'), (2, 'CCTV13新闻[1080p]'), (3, '湖南卫视高清'),
  (4, '湖南电视台'), (5, '鳳凰衛視'), (6, '翡翠台'), (7, 'TVB翡翠'), (8, 'BBC News'), (9, 'NOW 体育'),
  (10, '购物测试'), (11, '少儿动漫'), (12, '音乐频道 MTV'), (13, '第一财经'), (14, '4K 超高清'),
  (15, 'Kids Cartoon')) AS v(k, raw) ON p.p_partkey % 16 = v.k
"""

# Feeds whose whole text links to other feeds, with playlist lines around it; every eleventh links in prose alone.
DOCS = """
SELECT doc_id, concat('http://feed', doc_id, '.example.com/tv.m3u') AS url, CAST(CASE WHEN doc_id % 13 = 0 THEN 404 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN doc_id % 11 = 0 THEN concat('Prose only: see http://feed', CAST(floor(doc_id / 3) AS BIGINT), '.example.com/tv.m3u for more') ELSE
  concat(CASE WHEN doc_id % 17 = 0 THEN '<html>' ELSE '#EXTM3U' END, chr(10), '#EXTINF:-1,', source, chr(10), 'http://live', doc_id % 50, '.example.org/live/', doc_id,
    '.m3u8', chr(10), text, chr(10), lang, ',http://cdn', doc_id % 9, '.example.net:8080/', doc_id, chr(10),
    'see http://feed', CAST(floor(doc_id / 2) AS BIGINT), '.example.com/tv.m3u or http://feed',
    CAST(floor(doc_id / 5) AS BIGINT), '.example.com/tv.m3u", and http://cdn', doc_id % 9,
    '.example.net/logo.png', chr(10), 'http://bit.ly/live/', doc_id % 30, chr(10), '#EXTINF:-1 tvg-name="', source, '"', chr(10),
    'https://x', doc_id % 40, '.oss-cn.example.com/tv/', doc_id) END AS content
FROM {documents}
"""

# Code-hosting urls.
REPO = """
SELECT CAST(p_partkey AS BIGINT) AS seq, concat(CASE p_partkey % 3 WHEN 0 THEN 'https://raw.githubusercontent.com/'
    WHEN 1 THEN 'https://github.com/' ELSE 'https://git.example.com/' END, lower(replace(p_brand, '#', '')), '/r', p_size,
  CASE p_partkey % 3 WHEN 1 THEN '/blob' ELSE '' END, '/main/', p_partkey, '.m3u') AS url
FROM {part}
"""

# Fetch results for mirror candidates: some originals and some mirrors answered.
FETCHED = """
SELECT concat(CASE p_partkey % 4 WHEN 0 THEN 'https://gh-proxy.com/' WHEN 1 THEN 'https://mirror.ghproxy.com/' ELSE '' END,
  'https://raw.githubusercontent.com/', lower(replace(p_brand, '#', '')), '/r', p_size, '/main/', p_partkey, '.m3u') AS url,
  CAST(CASE WHEN p_size % 6 = 0 THEN 404 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN p_size % 7 = 0 THEN concat('<html>', p_name) ELSE p_name END AS content
FROM {part}
"""

_SQL = {
    "catalog": (CATALOG, ["part"]),
    "raw": (RAW, ["catalog"]),
    "playlist": (PLAYLIST, ["catalog"]),
    "probe": (PROBE, ["events"]),
    "feed": (FEED, ["documents"]),
    "runs": (RUNS, ["events"]),
    "names": (NAMES, ["part"]),
    "docs": (DOCS, ["documents"]),
    "repo": (REPO, ["part"]),
    "fetched": (FETCHED, ["part"]),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table, or the carrier of that name."""
    if name not in _SQL:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    sql, inputs = _SQL[name]
    return spark.sql(sql, **{i: table(spark, sf, i) for i in inputs})


def ctes(*names: str) -> str:
    """``WITH`` clause defining carriers for DuckDB; end the list with further definitions."""
    done: list[str] = []

    def add(name):
        sql, inputs = _SQL[name]
        for i in inputs:
            if i in _SQL and i not in done:
                add(i)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({_SQL[n][0].format(**{i: i for i in _SQL[n][1]}).strip()})" for n in done]
    return "WITH " + ",\n".join(parts)
