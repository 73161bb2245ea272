"""The flagship query: the whole curation run over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import rules
from linkloom.operators import evidence
from linkloom.plans.curate import Options, curate
from linkloom.plans.discover import discover
from linkloom.queries import sql as q
from linkloom.queries.carriers import ctes, table
from linkloom.queries.curation import BLACKLIST, NO_CACHE, VOD, now
from linkloom.queries.discover import DISCOVERED, DISCOVERED_NAME
from linkloom.queries.registry import query
from linkloom.scale import materialize

RULES = {"4K专区": ["gear", "gizmo"], "影视剧集": ["ring"], "体育赛事": ["bolt", "plate"]}
OPTS = Options(blacklist=BLACKLIST, vod_hosts=VOD, category_rules=RULES, aliases=[("RINGX", "RING")], links_per_name=2, output_limit=300, min_speed=0.2)

def _probes(spark, sf):
    from linkloom.functions import urls

    cat = table(spark, sf, "catalog").select("line_no", urls.fingerprint(F.col("url")).alias("fp"))
    part = table(spark, sf, "part").withColumn("head", F.encode(F.concat(F.lit("#EXTM3U"), "p_name", "p_brand", "p_type"), "UTF-8"))
    rows = part.join(cat, part["p_partkey"] == cat["line_no"]).select(
        "fp", F.when(F.col("p_size") % 8 == 0, 404).otherwise(200).cast("bigint").alias("status"),
        (F.col("p_size") * 40).cast("bigint").alias("bytes"), (F.col("p_size") * 30000).cast("bigint").alias("content_length"),
        F.lit("video/mp2t").alias("content_type"), "head", (F.col("p_retailprice") / 500).alias("speed"),
        F.col("p_partkey").alias("probe_no"),
    )
    return evidence.latest_probe(rows, "fp", ["probe_no"]).drop("probe_no")


_CAT = """CASE WHEN regexp_matches(name, '(?i)gear|gizmo') THEN '4K专区' WHEN regexp_matches(name, '(?i)ring') THEN '影视剧集'
  WHEN regexp_matches(name, '(?i)bolt|plate') THEN '体育赛事' ELSE '其他频道' END"""
_RANKED = "CASE category WHEN '4K专区' THEN 0 WHEN '影视剧集' THEN 2 WHEN '体育赛事' THEN 5 ELSE 9 END"


@query("curate_catalog", f"""{NO_CACHE},
probes AS (SELECT c.fp, arg_max(p, p_partkey) AS p FROM (SELECT {q.fp('url')} AS fp, line_no FROM catalog) c JOIN part p ON c.line_no = p.p_partkey GROUP BY c.fp),
judged AS (SELECT a.*, p.p.p_size AS size, p.p.p_retailprice / CAST(500 AS DOUBLE) AS speed FROM accepted a JOIN probes p USING (fp)
  WHERE p.p.p_size % 8 <> 0 AND p.p.p_size * 40 >= 512),
valid AS (SELECT *, source_rank * 2147483648 + line_no AS seq, least(50 + CASE WHEN size * 30000 > 1000000 THEN 20 WHEN size * 30000 > 500000 THEN 10 ELSE 0 END
  + CAST(trunc(speed * 10) AS BIGINT), 100) AS quality FROM judged WHERE speed >= 0.2),
named AS (SELECT *, {_CAT} AS category, upper(replace(name, ' ', '')) AS norm_name FROM valid),
best AS (SELECT category, norm_name, max(quality) AS best, min(seq) AS first_seq FROM named GROUP BY ALL),
top AS (SELECT n.*, b.best, b.first_seq, row_number() OVER (PARTITION BY category, norm_name ORDER BY quality DESC, seq) AS rn,
  first_value(n.name) OVER (PARTITION BY category, norm_name ORDER BY quality DESC, seq) AS shown FROM named n JOIN best b USING (category, norm_name)),
o AS (SELECT row_number() OVER (ORDER BY {_RANKED}, -best, first_seq, norm_name, rn) AS line_no, category, replace(shown, ' ', '') AS name, url, quality, fp FROM top WHERE rn <= 2)
SELECT * FROM o WHERE line_no <= 300""")
def curate_catalog(spark, sf):
    return curate([table(spark, sf, "raw")], _probes(spark, sf), now(), opts=OPTS).catalog


# The whole run without caps: two raw files, discovered links, a cache, probes and second probes.
_ALL = Options(blacklist=BLACKLIST, vod_hosts=VOD, category_rules=RULES, aliases=[("RINGX", "RING")])
_FOUND = "length(url) % 7 <> 0"


def _whole_run(spark, sf):
    from linkloom.functions import urls

    raw = table(spark, sf, "raw")
    files = [raw.filter(which).select(F.lit(name).alias("source_id"), (F.col("line_no") * 8 + F.col("source_rank")).alias("line_no"), "line")
             for name, which in (("a.txt", F.col("source_rank") < 2), ("b.txt", F.col("source_rank") >= 2))]
    docs = table(spark, sf, "docs")
    # Links and probes are read several times: they are found and put together once.
    found = materialize(discover(docs.select("url", F.col("doc_id").alias("seed_rank")), docs))
    size = F.length("url")
    of_found = found.groupBy(urls.fingerprint(F.col("url")).alias("fp")).agg(F.min("url").alias("url")).select(
        "fp", F.when(size % 7 != 0, 200).otherwise(404).cast("bigint").alias("status"), F.lit(1000).cast("bigint").alias("bytes"),
        (size * 20000).cast("bigint").alias("content_length"), F.lit("video/mp2t").alias("content_type"),
        F.encode(F.concat(F.lit("#EXTM3U"), "url"), "UTF-8").alias("head"), (size / 10).alias("speed"),
    )
    listed = materialize(_probes(spark, sf))
    probes = listed.unionByName(of_found.join(listed.select("fp"), "fp", "left_anti").select(*listed.columns))
    probes = materialize(probes)
    second = probes.select("fp", F.when(F.col("bytes") % 360 == 0, 503).otherwise(200).cast("bigint").alias("status"))
    cat = table(spark, sf, "catalog").select(urls.fingerprint(F.col("url")).alias("fp"), "quality")
    recent = cat.groupBy("fp").agg(F.max("quality").alias("q")).filter("q > 90")
    cache = recent.select("fp", F.lit("2024-01-01 05:00:00").cast("timestamp").alias("validated_at"))
    return curate([files[0].unionByName(files[1]), found], probes, now(), cache, second, _ALL)


# Known direct hosts and carrier addresses pass the second probe whatever its status.
_SERVER = "lower(regexp_extract(url, '^(?:.*?://)?([^?/]*)', 1))"
_KEYS = q.words(rules.DIRECT_KEYS)[1:-1]
_THROUGH = f"""(regexp_matches({_SERVER}, '^({_KEYS})$|[.]({_KEYS})|^\\[({q.words(rules.DIRECT_IPV6_PREFIXES)[1:-1]})')
  OR {" OR ".join(f"contains(url, '{m}')" for m in rules.CARRIER_IPV6_MARKS)})"""

_RUN = f"""{ctes('docs', 'raw', 'catalog')}, {DISCOVERED},
found AS (SELECT link AS url, {DISCOVERED_NAME} AS name FROM merged),
split AS (SELECT CASE WHEN source_rank < 2 THEN 1 ELSE 2 END AS r, line_no * 8 + source_rank AS line_no, CASE WHEN contains(line, ',') THEN {q.strip("split_part(line, ',', 1)")} END AS name,
  CASE WHEN contains(line, ',') THEN {q.strip(q.after_comma('line'))} END AS url FROM raw),
every AS (SELECT * FROM split UNION ALL SELECT 9, row_number() OVER (ORDER BY url, name), name, url FROM found),
sound AS (SELECT *, {q.fp('url')} AS fp FROM every WHERE name IS NOT NULL AND name NOT IN ('', '未知频道') AND NOT contains(upper(name), 'ANVIL')
  AND NOT {q.private('url')} AND NOT contains(lower({q.netloc('url')}), 'jd.com') AND regexp_matches(url, '^https?://')),
accepted AS (SELECT * FROM sound QUALIFY row_number() OVER (PARTITION BY fp ORDER BY r, line_no) = 1),
listed AS (SELECT c.fp, arg_max(p, p_partkey) AS p FROM (SELECT {q.fp('url')} AS fp, line_no FROM catalog) c JOIN part p ON c.line_no = p.p_partkey GROUP BY c.fp),
of_found AS (SELECT {q.fp('url')} AS fp, min(url) AS url FROM found GROUP BY 1),
probes AS (SELECT fp, p.p_size % 8 <> 0 AND p.p_size * 40 >= 512 AS alive, p.p_size * 30000 AS content_length, p.p_retailprice / CAST(500 AS DOUBLE) AS speed, p.p_size * 40 AS bytes FROM listed
  UNION ALL SELECT fp, {_FOUND}, length(url) * 20000, length(url) / CAST(10 AS DOUBLE), 1000 FROM of_found WHERE fp NOT IN (SELECT fp FROM listed)),
recent AS (SELECT DISTINCT {q.fp('url')} AS fp FROM catalog WHERE quality > 90),
judged AS (SELECT a.*, coalesce(p.alive, false) OR k.fp IS NOT NULL AS alive, k.fp IS NOT NULL AS recent, p.speed,
  coalesce(p.alive, false) AND coalesce(p.speed >= 0.001, false) AND (p.bytes % 360 <> 0 OR {_THROUGH}) AS passed,
  coalesce(CASE WHEN p.alive THEN 50 + CASE WHEN content_length > 1000000 THEN 20 WHEN content_length > 500000 THEN 10 ELSE 0 END END, 0) AS base
  FROM accepted a LEFT JOIN probes p USING (fp) LEFT JOIN recent k USING (fp)),
valid AS (SELECT *, CASE WHEN speed >= 0.001 THEN least(base + CAST(trunc(speed * 10) AS BIGINT), 100) ELSE base END AS quality FROM judged WHERE passed OR recent),
named AS (SELECT *, {_CAT} AS category, upper(replace(name, ' ', '')) AS norm_name, r * 1000000000000 + line_no AS seq FROM valid),
top AS (SELECT *, max(quality) OVER w AS best, min(seq) OVER w AS first_seq, row_number() OVER (PARTITION BY category, norm_name ORDER BY quality DESC, seq) AS rn,
  first_value(name) OVER (PARTITION BY category, norm_name ORDER BY quality DESC, seq) AS shown FROM named WINDOW w AS (PARTITION BY category, norm_name)),
o AS (SELECT row_number() OVER (ORDER BY {_RANKED}, -best, first_seq, norm_name, rn) AS line_no, category, replace(shown, ' ', '') AS name, url, CAST(quality AS BIGINT) AS quality, fp FROM top)"""


@query("curate_with_discovery", f"{_RUN} SELECT * FROM o")
def curate_with_discovery(spark, sf):
    return _whole_run(spark, sf).catalog


@query("run_record", f"""{_RUN}, j AS (SELECT count(*) AS total, count(*) FILTER (NOT alive) AS failed, count(*) FILTER (alive AND NOT recent AND coalesce(speed < 0.001, false)) AS filtered FROM judged)
SELECT category, count(*) AS n, total, (SELECT count(*) FROM valid) AS valid, failed, filtered, (SELECT count(*) FROM o) AS written,
  (SELECT count(*) FROM valid) * CAST(100 AS DOUBLE) / total AS success_rate FROM o, j GROUP BY ALL""")
def run_record(spark, sf):
    """The history row of the whole run, a row per category."""
    stats = _whole_run(spark, sf).stats
    return stats.select(F.explode("by_category").alias("category", "n"), "total", "valid", "failed", "filtered", "written", "success_rate")
