import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import admission, runs
from linkloom.plans.curate import PUBLISHED, Options, curate, name_channels, options_from_rules
from linkloom.plans.watch import watch
from linkloom.sources.catalogs import explode_lines, read_catalog, read_docs
from linkloom.sources.rulesets import load_rules


def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def probes_of(spark, rows):
    df = spark.createDataFrame(rows, "url string, status int, bytes long, content_length long, speed double")
    head = F.encode(F.lit("#EXTM3U" + "x" * 20), "UTF-8")
    return df.select(urls.fingerprint(F.col("url")).alias("fp"), "status", "bytes", "content_length", "speed", F.lit("").alias("content_type"), head.alias("head"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines_of(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def test_curate_end_to_end(spark):
    lines = lines_of(spark, [
        "CCTV-2,http://a/2", "CCTV1综合,http://a/1", "cctv-1 HD,http://b/1", "CCTV-1,http://c/1", "湖南卫视高清,http://a/h", "湖南电视台,http://b/h",
        "测试,http://a/t", "CCTV5+,http://a/5p", "CCTV5,http://a/5", "dead,http://a/dead", "slow,http://a/slow", "BBC,http://a/bbc", "gone,http://a/gone",
    ])
    ok = ["2", "1", "h", "5p", "5", "bbc", "gone"]
    rows = [(f"http://a/{x}", 200, 900, 600_000, 1.0) for x in ok] + [("http://b/1", 200, 900, 2_000_000, 1.0), ("http://c/1", 200, 900, 0, 0.5), ("http://b/h", 206, 900, 0, 1.0)]
    rows += [("http://a/dead", 404, 900, 0, 1.0), ("http://a/slow", 200, 900, 0, 0.0)]
    second = spark.createDataFrame([(f"http://a/{x}", 200) for x in ok[:-1]] + [("http://b/1", 404), ("http://c/1", 200), ("http://b/h", 200), ("http://a/gone", 503)], "url string, status int")
    second = second.select(urls.fingerprint(F.col("url")).alias("fp"), "status")
    result = curate([lines], probes_of(spark, rows), now(), second_probes=second, opts=PUBLISHED)
    got = [(r.category, r.name, r.url) for r in result.catalog.orderBy("line_no").collect()]
    assert got == [
        ("港澳台频", "BBC", "http://a/bbc"), ("央视频道", "CCTV-1综合", "http://b/1"), ("央视频道", "CCTV-1综合", "http://a/1"),
        ("央视频道", "CCTV-2财经", "http://a/2"), ("央视频道", "CCTV-5", "http://a/5"), ("央视频道", "CCTV-5+", "http://a/5p"),
        ("卫视频道", "湖南卫视", "http://a/h"), ("卫视频道", "湖南卫视", "http://b/h"),
    ]
    assert [r.url for r in result.failed.collect()] == ["http://a/dead"]
    stats = result.stats.first()
    assert (stats.total, stats.valid, stats.failed, stats.filtered, stats.written) == (12, 9, 1, 1, 8)
    assert stats.by_category == {"港澳台频": 1, "央视频道": 5, "卫视频道": 2}
    assert tuple(stats.by_overseas) == (8, 1) and abs(stats.success_rate - 75.0) < 1e-9
    # Counted while written: no aggregate, exchange or subquery over the tables of the run.
    assert not any(x in plan_of(result.stats) for x in ("Aggregate", "Exchange", "Subquery"))
    assert result.cache.count() == 9
    capped = curate([lines], probes_of(spark, rows), now(), opts=Options(output_limit=3, share=False))
    assert [r.line_no for r in capped.catalog.orderBy("line_no").collect()] == [1, 2, 3]


def test_recently_validated_links_stay_published(spark):
    lines = lines_of(spark, ["A台,http://a/1", "B台,http://a/2"])
    cache = spark.createDataFrame([("http://a/1", "2024-01-01 11:00:00")], "url string, at string").select(
        urls.fingerprint(F.col("url")).alias("fp"), F.col("at").cast("timestamp").alias("validated_at"))
    probes = probes_of(spark, [("http://a/2", 200, 900, 0, 1.0)])
    keep = curate([lines], probes, now(), cache, opts=Options(min_speed=None))
    assert {r.url for r in keep.catalog.collect()} == {"http://a/1", "http://a/2"}
    skip = curate([lines], probes, now(), cache, opts=Options(min_speed=None, reuse_recent=False))
    assert {r.url for r in skip.catalog.collect()} == {"http://a/2"}


def second_of(spark, rows):
    df = spark.createDataFrame(rows, "url string, status int")
    return df.select(urls.fingerprint(F.col("url")).alias("fp"), "status")


def cache_of(spark, rows):
    df = spark.createDataFrame(rows, "url string, at string")
    return df.select(urls.fingerprint(F.col("url")).alias("fp"), F.col("at").cast("timestamp").alias("validated_at"))


def test_lines_files_discovered_links_and_cache_together(spark, tmp_path):
    """Default options: raw lines of two files, discovered links, a cache and second probes."""
    for name, text in (("a.txt", "A台,http://a/1\nB台,http://a/2\n"), ("b.txt", "C台,http://b/1\nA again,http://a/1?x\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    files = explode_lines(read_docs(spark, str(tmp_path)))
    found = spark.createDataFrame([("D", "http://d/1", "d"), ("E", "http://d/2", "d"), ("F", "http://a/2", "d")], "name string, url string, domain string")
    alive = ["http://a/1", "http://b/1", "http://d/1", "http://d/2"]
    probes = probes_of(spark, [(u, 200, 900, 0, 1.0) for u in alive])
    cache = cache_of(spark, [("http://a/2", "2024-01-01 11:00:00"), ("http://d/2", "2024-01-01 10:00:00"), ("http://old", "2024-01-01 01:00:00")])
    second = second_of(spark, [(u, 200) for u in alive[:3]] + [("http://d/2", 503)])
    run = curate([files, found], probes, now(), cache, second)
    assert {r.url for r in run.catalog.collect()} == {"http://a/1", "http://a/2", "http://b/1", "http://d/1", "http://d/2"}
    assert {r.name for r in run.catalog.collect()} == {"A台", "B台", "C台", "D", "E"}
    # Links kept because they were proved before keep their time, so that they expire; the others are stamped.
    stamps = {r.fp: str(r.validated_at) for r in run.cache.collect()}
    assert sorted(stamps.values()) == ["2024-01-01 10:00:00", "2024-01-01 11:00:00"] + ["2024-01-01 12:00:00"] * 3
    assert run.stats.first().duration_s > 0


def test_many_files_have_entries_of_their_own(spark, tmp_path):
    (tmp_path / "1.txt").write_text("x,http://h/1\ny,http://h/2\n")
    (tmp_path / "2.txt").write_text("z,http://h/1\nw,http://h/3\nno comma\n")
    raw = admission.union_sources([read_catalog(spark, str(tmp_path))])
    reasons = sorted((r["name"], r["reject_reason"]) for r in admission.admission_reasons(raw).collect() if r["name"])
    assert reasons == [("w", "accepted"), ("x", "accepted"), ("y", "accepted"), ("z", "dup_fp")]
    assert admission.admission_reasons(raw).count() == 5
    assert {r["name"] for r in admission.admit(raw).collect()} == {"x", "y", "w"}


def test_line_numbers_of_any_size(spark):
    rows = [(0, 2**31, "a,http://h/1"), (1, 0, "b,http://h/1"), (0, 2**62, "c,http://h/2")]
    raw = spark.createDataFrame(rows, "source_rank long, line_no long, line string")
    got = {r["name"]: r["reject_reason"] for r in admission.admission_reasons(raw).collect()}
    assert got == {"a": "accepted", "b": "dup_fp", "c": "accepted"}


def test_options_from_rules(spark, tmp_path):
    import json

    doc = {"categories": {"order": ["B", "其他频道"], "rules": {"B": ["bee"]}}, "filter": {"blacklist": ["bad"], "vod_domains": ["v.com"], "playlist_blacklist": ["deny.me"]},
           "quality": {"cache_ttl_hours": 2, "min_speed_mbps": 0.5, "enable_resolution_filter": True, "min_resolution_width": 640, "min_resolution_height": 480}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    opts = options_from_rules(load_rules(spark, str(tmp_path / "r.json")))
    assert opts.blacklist == ["bad"] and opts.category_rules == {"B": ["bee"]} and list(opts.category_order) == ["B", "其他频道"]
    assert (opts.ttl_hours, opts.min_speed, opts.min_width, opts.min_height) == (2.0, 0.5, 640, 480)
    assert opts.deny_domains == ["deny.me"] and opts.overseas == Options().overseas
    lines = lines_of(spark, ["a bee,http://h/1", "bad one,http://h/2", "low,http://h/3", "slow,http://h/4", "narrow,http://h/5"])
    rows = probes_of(spark, [(f"http://h/{i}", 200, 900, 0, 0.1 if i == 4 else 1.0) for i in range(1, 6)])
    rows = rows.withColumn("stdout", F.when(F.col("fp") == urls.fingerprint(F.lit("http://h/5")), "width=320 height=200").otherwise("width=1280 height=720"))
    got = {(r.category, r.name) for r in curate([lines], rows, now(), opts=opts).catalog.collect()}
    assert got == {("B", "abee"), ("其他频道", "low")}


def test_supplied_character_table(spark):
    df = spark.createDataFrame([("X臺",)], "name string")
    opts = Options(characters=("X臺", "Y台"), category_rules={"影视剧集": ["y台"]})
    assert name_channels(df, opts).first()["category"] == "影视剧集"


def test_watch(spark):
    feeds = spark.createDataFrame([(0, "http://h/a"), (1, "http://h/b"), (2, "http://h/c"), (3, "http://h/d")], "ord int, url string")
    scan = spark.createDataFrame([("http://h/a", "new", "e1"), ("http://h/b", "same", None), ("http://h/d", "first", "e4"), ("http://other", "x", None)], "url string, content string, etag string")
    state = spark.createDataFrame([("http://h/a", "oldhash", "e0"), ("http://h/b", "51037a4a37730f52c8732586d3aaa316", "eb"), ("http://h/c", "kept", "ec"), ("http://unlisted", "z", None)], "url string, hash string, etag string")
    w = watch(feeds, state, scan)
    changes = w.changes.collect()
    assert [(r.name, r.url, r.old_hash, r.old_etag, r.new_etag) for r in changes] == [("h/a", "http://h/a", "oldhash", "e0", "e1")]
    assert tuple(w.summary.first()) == (1, "CHANGES")
    kept = {r.url: (r.hash, r.etag) for r in w.state.collect()}
    assert kept["http://h/c"] == ("kept", "ec") and set(kept) == {f"http://h/{x}" for x in "abcd"}
    again = watch(feeds, w.state, scan)
    assert tuple(again.summary.first()) == (0, "NO_CHANGES")


def test_run_record_is_the_same_either_way(spark):
    lines = lines_of(spark, ["CCTV-2,http://a/2", "CCTV1综合,http://a/1", "dead,http://a/dead", "slow,http://a/slow", "BBC,http://a/bbc"])
    rows = [(f"http://a/{x}", 200, 900, 600_000, 1.0) for x in ("2", "1", "bbc")] + [("http://a/dead", 404, 900, 0, 1.0), ("http://a/slow", 200, 900, 0, 0.0)]
    both = [curate([lines], probes_of(spark, rows), now(), opts=Options(share=share)).stats.drop("duration_s").first() for share in (True, False)]
    assert both[0] == both[1] and both[0].valid == 3
    none = curate([lines], probes_of(spark, rows).filter("false"), now()).stats.first()
    assert (none.total, none.valid, none.written, none.by_category, none.success_rate) == (5, 0, 0, {}, 0.0)


def test_counters_refuse_unannounced_categories(spark):
    counters = runs.RunCounters(["x"])
    df = spark.createDataFrame([("x", True, False), ("y", True, False)], "category string, alive boolean, overseas boolean")
    for part in (counters.judged(df), counters.channels(df), counters.catalog(df)):
        part.collect()
    with pytest.raises(ValueError):
        counters.record(spark, "r", now())


def test_whole_run_reads_links_and_probes_put_together_once(spark, monkeypatch):
    from linkloom.queries import flagship

    got = []
    monkeypatch.setattr(flagship, "curate", lambda *args: got.extend(args))
    flagship._whole_run(spark, "/root/testdata/sf0.001")
    for df in (got[0][1], got[1]):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" not in plan and "Join" not in plan and df.count() > 0
