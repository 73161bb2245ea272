import glob
import json

from pyspark.sql import functions as F

from linkloom.operators import publish
from linkloom.sources import catalogs, rulesets

ROWS = [(0, "4K专区", "a", "http://h/1"), (1, "央视频道", "b", "http://h/2?token=1"), (2, "央视频道", "b", "http://h/3"), (3, "自定", "c", "u,v")]


def catalog(spark):
    return spark.createDataFrame(ROWS, "line_no long, category string, name string, url string")


def text_of(path):
    return "".join(open(p, encoding="utf8").read() for p in sorted(glob.glob(f"{path}/part-*"))).splitlines()


def test_grouped_text_round_trip(spark, tmp_path):
    publish.write_catalog(catalog(spark), f"{tmp_path}/c")
    lines = text_of(f"{tmp_path}/c")
    assert lines[0] == "4K专区,#genre#" and len(lines) == 7
    raw = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    back = catalogs.read_grouped_catalog(raw).orderBy("line_no").collect()
    assert [(r.category, r.name, r.url) for r in back] == [r[1:] for r in ROWS]


def test_m3u(spark, tmp_path):
    publish.write_m3u(catalog(spark), f"{tmp_path}/m")
    assert text_of(f"{tmp_path}/m") == [
        "#EXTM3U", "", "#EXTGRP:4K", '#EXTINF:-1 group-title="4K",a', "http://h/1", "#EXTGRP:CCTV", '#EXTINF:-1 group-title="CCTV",b',
        "http://h/2?token=1", '#EXTINF:-1 group-title="CCTV",b', "http://h/3", "#EXTGRP:自定", '#EXTINF:-1 group-title="自定",c', "u,v",
    ]
    compat = [r.text for r in publish.m3u_rows(catalog(spark), compat=True).orderBy("line_no", "part").collect()]
    assert compat[0] == "#EXTGRP:4K专" and compat[1] == '#EXTINF:-1 group-title="4K专",a'


def test_breaks_do_not_depend_on_blocks(spark):
    for block in (1, 2, 100):
        got = publish.group_break_flag(catalog(spark).repartition(3), block=block).orderBy("line_no").collect()
        assert [r.is_break for r in got] == [True, True, False, True]


def test_sanitized_lines(spark):
    df = spark.createDataFrame([("a,http://h/p?key=1&x=2",), ("g,#genre#",), ("no comma?key=1",)], "line string")
    assert [r.line for r in publish.sanitize_lines(df).collect()] == ["a,http://h/p?x=2", "g,#genre#", "no comma?key=1"]


def test_tables_and_failed(spark, tmp_path):
    publish.write_catalog_table(catalog(spark), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").filter("category = '央视频道'").count() == 2
    publish.write_failed(catalog(spark), f"{tmp_path}/f")
    assert "c,u,v" in text_of(f"{tmp_path}/f")


def test_state_versions(spark, tmp_path):
    path = f"{tmp_path}/cache"
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    old = spark.createDataFrame([("a", "2024-01-01 23:00:00"), ("b", "2024-01-01 01:00:00"), ("c", "2024-01-01 20:00:00")], "fp string, at string")
    publish.write_state(old.select("fp", F.col("at").cast("timestamp").alias("validated_at")), path, 1)
    valid = spark.createDataFrame([("c",), ("d",)], "fp string")
    publish.write_state(publish.updated_cache(valid, publish.read_state(spark, path), now, 6), path, 2)
    got = {r.fp: str(r.validated_at) for r in publish.read_state(spark, path).collect()}
    assert got == {"a": "2024-01-01 23:00:00", "c": "2024-01-02 00:00:00", "d": "2024-01-02 00:00:00"}


def test_run_history(spark, tmp_path):
    for i in range(13):
        publish.append_run_stats(spark.range(1).select(F.lit(i).alias("run_ts"), F.lit(i * 10).alias("total")), f"{tmp_path}/runs")
    assert sorted(r.run_ts for r in publish.read_last_runs(spark, f"{tmp_path}/runs", 10).collect()) == list(range(3, 13))


def test_rule_json(spark, tmp_path):
    doc = {
        "sources": {"web_sources": ["http://h/a/x.m3u", "ftp://no", "http://h/b/x.m3u", "http://h/a/x.m3u", "http://h/", "http://h/c/x.m3u?q"]},
        "categories": {"order": ["B", "A"], "rules": {"A": ["a1", " ", "a2"], "B": ["b1"]}},
        "filter": {"blacklist": ["w"], "vod_domains": ["v", "x"], "overseas_keywords": [], "playlist_whitelist": ["g"], "playlist_blacklist": ["d"]},
        "network": {"timeout_cn": 8, "timeout_overseas": 15}, "quality": {"cache_ttl_hours": 6, "min_speed_mbps": 0.001},
    }
    (tmp_path / "rules.json").write_text(json.dumps(doc, indent=2), encoding="utf8")
    t = rulesets.load_rules(spark, f"{tmp_path}/rules.json")
    assert rulesets.rule_mapping(t.rules) == {"B": ["b1"], "A": ["a1", "a2"]}
    assert {(r.kind, r.value) for r in t.keywords.collect()} == {("blacklist", "w"), ("vod", "v"), ("vod", "x"), ("allow", "g"), ("deny", "d")}
    assert t.thresholds.first().cache_ttl_hours == 6
    assert [(r.category, r.cat_rank) for r in t.category_order.orderBy("cat_rank").collect()] == [("B", 0), ("A", 1)]
    feeds = rulesets.feed_list(t.feeds, block=2).orderBy("ord").collect()
    assert [r.short_name for r in feeds] == ["h/x.m3u", "h/x.m3u#1", "h", "h/x.m3u#2"]
