import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import admission, filters


def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def line_table(spark, lines):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "source_rank long, line_no long, line string")


def cache_of(spark, urls_at):
    from linkloom.functions import urls

    df = spark.createDataFrame(urls_at, "url string, at string")
    return df.select(urls.fingerprint(F.col("url")).alias("fp"), F.col("at").cast("timestamp").alias("validated_at"))


LINES = [
    ("no comma here", "no_comma"), (" ,http://h/a", "empty_name"), ("未知频道,http://h/a", "empty_name"),
    ("购物台,http://h/a", "blacklisted"), ("A,http://192.168.0.9/x", "private_ip"), ("A,http://v.jd.com/x", "vod_domain"),
    ("A,rtp://h/x", "bad_url"), ("A,http://old/x", "accepted"), ("A,http://recent/x", "cached"), ("B,http://recent/x?q", "cached"),
    ("A,http://new/x", "accepted"), ("B,https://NEW/x?y=1", "dup_fp"), ("C, http://new/y ", "accepted"), ("D,http://[fe80::1]/x", "private_ip"),
    ("E,http://x.com/live/goodiptv.club", "accepted"), ("E,http://goodiptv.club/huya/1", "vod_domain"),
]


def test_reasons_in_order(spark):
    raw = line_table(spark, [x for x, _ in LINES])
    cache = cache_of(spark, [("http://recent/x", "2024-01-01 07:00:00"), ("http://old/x", "2024-01-01 05:00:00")])
    got = admission.admission_reasons(raw, cache, now(), 6).orderBy("line_no").collect()
    assert [r.reject_reason for r in got] == [x for _, x in LINES]
    summary = {r.reject_reason: r.n for r in admission.reject_summary(raw, cache, now(), 6).collect()}
    want = {}
    for _, reason in LINES:
        want[reason] = want.get(reason, 0) + 1
    assert summary == want
    accepted = admission.admit(raw, cache, now(), 6).orderBy("line_no").collect()
    assert [r.line_no for r in accepted] == [i for i, (_, x) in enumerate(LINES) if x == "accepted"]
    assert accepted[2].host == "new" and accepted[2].url == "http://new/y"
    no_cache = {r.line_no: r.reject_reason for r in admission.admission_reasons(raw).collect()}
    assert no_cache[8] == "accepted" and no_cache[9] == "dup_fp"


def test_hot_fingerprint_and_partitioning(spark):
    """A third of the lines share one fingerprint; the result does not depend on the partitioning."""
    rnd = random.Random(2)
    lines = [f"n{i},http://hot/x?{i}" if i % 3 == 0 else f"n{i},http://h{rnd.randrange(40)}/x" for i in range(600)]
    raw = line_table(spark, lines)
    results = []
    for parts in (1, 7):
        shuffled = raw.repartition(parts, F.rand(parts))
        reasons = {r.line_no: r.reject_reason for r in admission.admission_reasons(shuffled).collect()}
        accepted = sorted(r.line_no for r in admission.admit(shuffled).collect())
        assert accepted == sorted(k for k, v in reasons.items() if v == "accepted")
        results.append((reasons, accepted))
    assert results[0] == results[1]
    assert len(results[0][0]) == 600
    again = admission.admit(admission.admit(raw).select("source_rank", "line_no", "name", "url"))
    assert again.count() == len(results[0][1])


def test_source_priority(spark):
    local = line_table(spark, ["L,http://h/1"]).drop("source_rank")
    web = line_table(spark, ["W,http://h/1", "W,http://h/2"]).drop("source_rank")
    found = line_table(spark, ["F,http://h/2", "F,http://h/3"]).drop("source_rank")
    got = admission.admit(admission.union_sources([local, web, found])).collect()
    assert sorted((r.name, r.url) for r in got) == [("F", "http://h/3"), ("L", "http://h/1"), ("W", "http://h/2")]


def test_candidate_limit_orders_hosts_by_first_entry(spark):
    lines = ["a,http://b/1", "a,http://a/1", "a,http://b/2", "a,http://c/1", "a,http://a/2"]
    accepted = admission.admit(line_table(spark, lines))
    got = admission.candidate_limit(accepted, 4).orderBy("candidate_no").collect()
    assert [r.url for r in got] == ["http://b/1", "http://b/2", "http://a/1", "http://a/2"]
    assert admission.topk_per_domain(accepted, 1).count() == 3
    assert admission.topk_per_domain(accepted, 0).count() == 5


@pytest.mark.parametrize("match,kept", [("contains", ["http://x.org/"]), ("suffix", ["http://my-jd.com/", "http://x.org/"])])
def test_vod_matching(spark, match, kept):
    df = spark.createDataFrame([("http://jd.com/",), ("http://a.jd.com/",), ("http://my-jd.com/",), ("http://x.org/",)], "url string")
    assert sorted(r.url for r in filters.drop_vod(df, ["jd.com"], match).collect()) == kept


def test_resolution(spark):
    df = spark.createDataFrame([("width=1920\nheight=1080",), ("1280x720",), ("width=320 height=240",), ("none",), ("id 1024x768 ok",)], "stdout string")
    assert {(r.width, r.height) for r in filters.min_resolution(df).collect()} == {(1920, 1080), (1280, 720)}
    assert filters.min_resolution(df, legacy=True).count() == 3


def test_recent_and_schemes(spark):
    cache = cache_of(spark, [("http://r/x", "2024-01-01 06:00:00"), ("http://o/x", "2024-01-01 05:59:59")])
    df = cache.select("fp")
    assert filters.drop_recent(df, cache, now(), 6).count() == 1
    urls = spark.createDataFrame([("http://a/x",), ("srt://a",), ("rtsp://a/x",), ("rtsp:x",), ("HTTP://a",)], "url string")
    assert filters.keep_schemes(urls).count() == 1
    assert filters.keep_schemes(urls, filters.PROBED_SCHEMES).count() == 2
    assert filters.keep_schemes(urls, filters.VALID_SCHEMES, need_host=True).count() == 3
