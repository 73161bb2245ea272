"""Queries over probe evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import scores
from linkloom.operators import evidence, filters, publish, runs
from linkloom.queries import sql as q
from linkloom.queries.carriers import ctes, table
from linkloom.queries.registry import query

C = ctes("probe")
LADDER = (
    "CAST(least(CASE WHEN {lat} <= 1 THEN 60 WHEN {lat} <= 3 THEN 50 WHEN {lat} <= 5 THEN 40 WHEN {lat} <= 10 THEN 30 "
    "WHEN {lat} <= 15 THEN 20 ELSE 10 END + CASE WHEN {spd} >= 2 THEN 40 WHEN {spd} >= 1 THEN 30 WHEN {spd} >= CAST(0.2 AS DOUBLE) THEN 20 "
    "WHEN {spd} >= CAST(0.05 AS DOUBLE) THEN 10 ELSE 5 END, 100) AS BIGINT)"
)
BASE = "CAST(50 + CASE WHEN content_length > 1000000 THEN 20 WHEN content_length > 500000 THEN 10 ELSE 0 END AS BIGINT)"
MEDIA = (
    "CASE WHEN octet_length(encode(head)) < 16 THEN 'unknown' WHEN head LIKE '#EXTM3U%' THEN 'm3u8' WHEN head LIKE 'FLV%' THEN 'flv' "
    "WHEN substring(head, 5, 4) = 'ftyp' THEN 'mp4' {ts} ELSE 'unknown' END"
)
STRICT = MEDIA.format(ts="WHEN strpos(head, 'G') BETWEEN 1 AND 188 AND (length(head) < strpos(head, 'G') + 188 OR substr(head, strpos(head, 'G') + 188, 1) = 'G') THEN 'ts'")
LOOSE = MEDIA.format(ts="WHEN true THEN 'ts'")


def probes(spark, sf):
    return table(spark, sf, "probe").withColumn("head", F.encode("head", "UTF-8"))


@query("quality_base", f"{C} SELECT seq, {BASE} AS quality FROM probe")
def quality_base(spark, sf):
    return table(spark, sf, "probe").select("seq", scores.quality_base(F.col("content_length")).alias("quality"))


@query("quality_ladder", f"{C} SELECT seq, {LADDER.format(lat='latency_s', spd='speed')} AS quality FROM probe")
def quality_ladder(spark, sf):
    return table(spark, sf, "probe").select("seq", scores.quality_ladder(F.col("latency_s"), F.col("speed")).alias("quality"))


@query("speed_bonus", f"""{C} SELECT seq, least({BASE} + CAST(trunc(speed * 10) AS BIGINT), 100) AS quality,
  {BASE} + CAST(trunc(speed * 10) AS BIGINT) AS uncapped FROM probe""")
def speed_bonus(spark, sf):
    base = scores.quality_base(F.col("content_length"))
    return table(spark, sf, "probe").select(
        "seq", scores.speed_bonus(base, F.col("speed")).alias("quality"),
        scores.speed_bonus(base, F.col("speed"), capped=False).alias("uncapped"),
    )


@query("throughput", f"""{C} SELECT seq, CASE WHEN latency_s > 0 THEN CAST(bytes AS DOUBLE) / 1024 / 1024 / latency_s ELSE 0 END AS mbps,
  CASE WHEN bytes < 1024 THEN 0 ELSE round(CAST(bytes AS DOUBLE) / 1024 / 1024 / latency_s, 4) END AS mbps_legacy FROM probe""")
def throughput(spark, sf):
    b, s = F.col("bytes"), F.col("latency_s")
    return table(spark, sf, "probe").select(
        "seq", scores.throughput(b, s).alias("mbps"), scores.throughput(b, s, legacy=True).alias("mbps_legacy")
    )


@query("default_quality", f"""{C} SELECT seq, coalesce(nullif(CASE WHEN status = 404 THEN NULL ELSE content_length // 15000 % 5 END, 0), 5) AS quality FROM probe""")
def default_quality(spark, sf):
    found = F.when(F.col("status") != 404, F.expr("content_length div 15000 % 5"))
    return table(spark, sf, "probe").select("seq", scores.default_quality(found, 5).alias("quality"))


@query("quality_gate", f"{C}, s AS (SELECT seq, {LADDER.format(lat='latency_s', spd='speed')} AS quality FROM probe) SELECT * FROM s WHERE quality >= 60")
def quality_gate(spark, sf):
    scored = table(spark, sf, "probe").select("seq", scores.quality_ladder(F.col("latency_s"), F.col("speed")).alias("quality"))
    return filters.min_quality(scored, 60)


@query("speed_gate", f"{C} SELECT count(*) FILTER (speed >= 0.5) AS kept, count(*) FILTER (speed < 0.5) AS removed FROM probe")
def speed_gate(spark, sf):
    return evidence.speed_counts(table(spark, sf, "probe"), 0.5)


@query("speed_applied", f"""{C} SELECT seq, speed, least({BASE} + CAST(trunc(speed * 10) AS BIGINT), 100) AS quality FROM probe WHERE speed >= 0.5""")
def speed_applied(spark, sf):
    df = table(spark, sf, "probe").withColumn("quality", scores.quality_base(F.col("content_length")))
    return evidence.apply_speed(df, 0.5).select("seq", "speed", "quality")


@query("resolution_gate", f"""{C}, r AS (SELECT seq, CAST(regexp_extract(stdout, 'width=([0-9]+)', 1) AS INTEGER) AS width,
  CAST(regexp_extract(stdout, 'height=([0-9]+)', 1) AS INTEGER) AS height FROM probe) SELECT * FROM r WHERE width >= 640 AND height >= 480""")
def resolution_gate(spark, sf):
    return filters.min_resolution(table(spark, sf, "probe")).select("seq", "width", "height")


@query("payload_type", f"{C} SELECT seq, {STRICT} AS media_type, {LOOSE} AS media_type_loose FROM probe")
def payload_type(spark, sf):
    head = F.col("head")
    return probes(spark, sf).select(
        "seq", evidence.media_type(head).alias("media_type"), evidence.media_type(head, strict=False).alias("media_type_loose")
    )


@query("fatal_text", """SELECT conv_id, turn, regexp_matches(lower(text), 'tion of|the of|de la') OR NOT regexp_matches(lower(text), 'codec_type=video|codec_type=audio|ing|en') AS fatal
FROM (SELECT conv_id, turn, text FROM conversations)""")
def fatal_text(spark, sf):
    """Whole conversation texts stand for probe output, with phrases that occur in them."""
    from linkloom.functions.text import contains_any

    text = F.lower(F.col("text"))
    dead = contains_any(text, ["tion of", "the of", "de la"]) | ~contains_any(text, rules.STREAM_MARKS + ["ing", "en"])
    return table(spark, sf, "conversations").select("conv_id", "turn", dead.alias("fatal"))


@query("fatal_flag", f"""{C}, t AS (SELECT seq, CASE status WHEN 503 THEN 'Server returned 5XX: Connection REFUSED' WHEN 404 THEN '404 Not Found' ELSE '' END AS stderr,
  CASE WHEN seq % 4 = 0 THEN 'codec_type=data' ELSE 'codec_type=VIDEO' END AS out FROM probe)
SELECT seq, regexp_matches(lower(stderr), {q.words(rules.FATAL_PHRASES)}) OR lower(out) NOT LIKE '%codec_type=video%' AS fatal FROM t""")
def fatal_flag(spark, sf):
    err = F.when(F.col("status") == 503, "Server returned 5XX: Connection REFUSED").when(F.col("status") == 404, "404 Not Found").otherwise("")
    df = table(spark, sf, "probe").withColumns(
        {"stderr": err, "stdout": F.when(F.col("seq") % 4 == 0, "codec_type=data").otherwise("codec_type=VIDEO")}
    )
    return evidence.flag_fatal(df).select("seq", "fatal")


ALIVE = f"(status IN (200, 206) AND bytes >= 512 AND NOT (content_type LIKE '%html%' AND head NOT LIKE '#EXTM3U%') AND {STRICT} <> 'unknown')"


@query("probe_alive", f"{C} SELECT seq, {ALIVE} AS alive, CASE WHEN {ALIVE} THEN {BASE} END AS quality FROM probe")
def probe_alive(spark, sf):
    return evidence.evaluate_probe(probes(spark, sf)).select("seq", "alive", "quality")


_LINK = "concat(CASE link_id % 5 WHEN 0 THEN 'udp://239.0.0.' WHEN 1 THEN 'http://cdn8.aliyun' WHEN 2 THEN 'http://a.migu.cn/' WHEN 3 THEN 'http://[240e:77::]/' ELSE 'http://h.example.com/' END, link_id)"


@query("probe_second", f"""{C}, l AS (SELECT seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE status END AS status, {_LINK} AS url FROM probe)
SELECT seq, CASE WHEN url LIKE 'udp://%' THEN true WHEN url LIKE 'http://a.migu%' OR url LIKE 'http://cdn8.aliyun%' THEN true WHEN url LIKE '%[240e:%' THEN true
  ELSE coalesce(status < 500, false) END AS direct_ok FROM l""")
def probe_second(spark, sf):
    df = table(spark, sf, "probe").select("seq", F.when(F.col("seq") % 9 != 0, F.col("status")).alias("status"), F.expr(_LINK).alias("url"))
    return evidence.evaluate_second_probe(df).select("seq", "direct_ok")


@query("probe_legacy", f"""{C}, l AS (SELECT *, {_LINK} AS url, CASE WHEN seq % 6 = 0 THEN 'codec_type=video' ELSE '' END AS so,
  CASE status WHEN 503 THEN 'connection refused' ELSE '' END AS se, CASE WHEN seq % 8 = 1 THEN 206 WHEN seq % 8 = 2 THEN 403 END AS get_status FROM probe),
v AS (SELECT *, url LIKE '%//[%' AS v6, (so <> '' AND se = '') OR status IN (200, 206, 301, 302, 304) OR coalesce(get_status IN (200, 206), false) AS reached FROM l)
SELECT seq, v6 OR (reached AND speed >= 0.5) AS alive, CASE WHEN v6 THEN 100 WHEN reached AND speed >= 0.5 THEN {LADDER.format(lat='round(latency_s, 2)', spd='speed')} END AS quality,
  CASE WHEN v6 THEN NULL WHEN NOT reached THEN concat('http ', coalesce(get_status, status)) WHEN speed < 0.5 THEN 'slow' END AS reason FROM v""")
def probe_legacy(spark, sf):
    df = table(spark, sf, "probe").withColumns({
        "name": F.lit("x"), "url": F.expr(_LINK), "elapsed_s": F.col("latency_s"),
        "stdout": F.when(F.col("seq") % 6 == 0, "codec_type=video").otherwise(""),
        "stderr": F.when(F.col("status") == 503, "connection refused").otherwise(""),
        "get_status": F.when(F.col("seq") % 8 == 1, 206).when(F.col("seq") % 8 == 2, 403),
    })
    return evidence.evaluate_probe_legacy(df, min_mbps=0.5).select("seq", "alive", "quality", "reason")


@query("link_revalidate", f"""{C}, p AS (SELECT concat('http://l', seq // 6) AS url, CASE WHEN seq % 2 = 0 THEN 'HEAD' ELSE 'GET' END AS method, status, bytes, head, seq FROM probe),
u AS (SELECT url, arg_max(status, seq) FILTER (method = 'HEAD') AS hs, arg_max(status, seq) FILTER (method = 'GET') AS gs, arg_max(bytes, seq) FILTER (method = 'GET') AS gb,
  arg_max(head, seq) FILTER (method = 'GET') AS t FROM p GROUP BY url)
SELECT url, coalesce(hs IN (200, 206) OR (hs IN (301, 302, 304, 403, 405) AND gs IN (200, 206) AND gb >= 16 AND (lower(t) LIKE '%m3u%' OR length(trim(t)) > 32)), false) AS ok FROM u""")
def link_revalidate(spark, sf):
    p = table(spark, sf, "probe").select(
        F.expr("concat('http://l', seq div 6)").alias("url"), F.when(F.col("seq") % 2 == 0, "HEAD").otherwise("GET").alias("method"),
        "status", "bytes", "head", "seq",
    )
    return evidence.revalidate_links(p, order=["seq"]).select("url", "ok")



@query("probe_join", f"""{ctes('catalog', 'probe')}, latest AS (SELECT link_id, seq, {ALIVE} AS alive FROM
  (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY probed_at DESC, seq DESC) AS n FROM probe) WHERE n = 1)
SELECT source_rank, c.line_no, l.seq, coalesce(l.alive, false) AS alive FROM catalog c LEFT JOIN latest l ON c.line_no % 1009 = l.link_id""")
def probe_join(spark, sf):
    newest = evidence.latest_probe(probes(spark, sf), "link_id", ["probed_at", "seq"])
    judged = evidence.evaluate_probe(newest)
    candidates = table(spark, sf, "catalog").withColumn("link_id", F.col("line_no") % 1009).select("source_rank", "line_no", "link_id")
    return evidence.attach_evidence(candidates, judged, "link_id").select("source_rank", "line_no", "seq", "alive")


@query("split_valid_failed", f"""{C} SELECT 'valid' AS side, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM probe WHERE {ALIVE}
UNION ALL SELECT 'failed', count(*), CAST(sum(seq) AS BIGINT) FROM probe WHERE NOT {ALIVE}""")
def split_valid_failed(spark, sf):
    valid, failed = evidence.split_valid_failed(evidence.evaluate_probe(probes(spark, sf)))

    def side(df, name):
        return df.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.sum("seq").alias("seqs"))

    return side(valid, "valid").unionByName(side(failed, "failed"))


@query("run_summary", f"""{C} SELECT count(*) AS total, count(*) FILTER ({ALIVE}) AS valid, count(*) FILTER (NOT {ALIVE}) AS failed,
  count(*) FILTER (speed < 1) AS filtered, count(*) FILTER (speed >= 1 AND {ALIVE}) AS written,
  count(*) FILTER ({ALIVE}) * CAST(100 AS DOUBLE) / count(*) AS success_rate, max(latency_s) AS duration_s FROM probe""")
def run_summary(spark, sf):
    df = evidence.evaluate_probe(probes(spark, sf))
    slow = F.col("speed") < 1
    return runs.run_summary(df, written=~slow & F.col("alive"), filtered=slow, duration_s=F.col("latency_s"))


@query("running_valid_rate", f"""{C} SELECT seq, count(*) OVER w AS done, CAST(sum(CASE WHEN status < 400 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS valid_so_far,
  CAST(sum(CASE WHEN status < 400 THEN 1 ELSE 0 END) OVER w AS BIGINT) * CAST(100 AS DOUBLE) / count(*) OVER w AS valid_pct FROM probe
WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def running_valid_rate(spark, sf):
    df = table(spark, sf, "probe").select("seq", "status")
    return evidence.running_valid_rate(df, "seq", F.col("status") < 400).drop("status")


@query("run_delta", f"""{ctes('runs')} SELECT run_date, total, valid, total - lag(total) OVER w AS d_total, valid - lag(valid) OVER w AS d_valid FROM runs WINDOW w AS (ORDER BY run_date)""")
def run_delta(spark, sf):
    df = table(spark, sf, "runs").withColumn("day", F.unix_date("run_date").cast("bigint"))
    return runs.run_delta(df, "day", ["total", "valid"]).drop("day")


@query("last_runs", f"{ctes('runs')} SELECT * FROM runs ORDER BY run_date DESC LIMIT 10")
def last_runs(spark, sf):
    return runs.keep_last_runs(table(spark, sf, "runs"), [F.desc("run_date")], 10)


_NOW = "2024-01-20 00:00:00"


@query("ttl_cache_antijoin", f"""{C}, cache AS (SELECT md5(CAST(link_id AS VARCHAR)) AS fp, max(probed_at) AS validated_at FROM probe WHERE status < 400 AND probed_at < TIMESTAMP '{_NOW}' GROUP BY 1)
SELECT seq, md5(CAST(link_id AS VARCHAR)) AS fp FROM probe WHERE md5(CAST(link_id AS VARCHAR)) NOT IN (SELECT fp FROM cache WHERE validated_at >= TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR)""")
def ttl_cache_antijoin(spark, sf):
    p = table(spark, sf, "probe").withColumn("fp", F.md5(F.col("link_id").cast("string")))
    now = F.lit(_NOW).cast("timestamp_ntz")
    cache = p.filter((F.col("status") < 400) & (F.col("probed_at") < now)).groupBy("fp").agg(F.max("probed_at").alias("validated_at"))
    return filters.drop_recent(p, cache, now, 6).select("seq", "fp")


@query("cache_upsert", f"""{C}, old AS (SELECT md5(CAST(link_id AS VARCHAR)) AS fp, max(probed_at) AS validated_at FROM probe WHERE probed_at < TIMESTAMP '{_NOW}' GROUP BY 1),
u AS (SELECT * FROM old UNION ALL SELECT DISTINCT md5(CAST(link_id AS VARCHAR)), TIMESTAMP '{_NOW}' FROM probe WHERE status = 206)
SELECT fp, max(validated_at) AS validated_at FROM u GROUP BY fp HAVING max(validated_at) >= TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR""")
def cache_upsert(spark, sf):
    p = table(spark, sf, "probe").withColumn("fp", F.md5(F.col("link_id").cast("string")))
    now = F.lit(_NOW).cast("timestamp_ntz")
    old = p.filter(F.col("probed_at") < now).groupBy("fp").agg(F.max("probed_at").alias("validated_at"))
    return publish.updated_cache(p.filter("status = 206").select("fp").distinct(), old, now, 6)
