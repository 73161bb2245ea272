import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.functions import scores
from linkloom.operators import evidence


def test_media_types(spark):
    heads = [b"#EXTM3U" + b" " * 20, b"G" + b"\0" * 187, b"FLV" + b"\1" * 20, b"\0\0\0\1ftypisom" + b"\0" * 9, b"\0" * 16, b"G", b"<html>" + b"x" * 30]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, head binary")
    strict = [r.media_type for r in evidence.classify_payload(df).orderBy("i").collect()]
    assert strict == ["m3u8", "ts", "flv", "mp4", "unknown", "unknown", "unknown"]
    loose = [r.media_type for r in evidence.classify_payload(df, strict=False).orderBy("i").collect()]
    assert loose[4:] == ["ts", "unknown", "ts"]


@pytest.mark.parametrize("latency,speed,score", [(3.0, 0.2, 70), (0.5, 5.0, 100), (1.0, 1.0, 90), (10.1, 0.05, 30), (16.0, 0.0, 15), (5.0, 1.99, 70)])
def test_ladder(spark, latency, speed, score):
    row = spark.range(1).select(scores.quality_ladder(F.lit(latency), F.lit(speed)).alias("q")).first()
    assert row.q == score


def test_probe_verdicts(spark):
    good = bytearray(b"#EXTM3U" + b"x" * 30)
    rows = [
        (0, 200, 512, "text/html", 2_000_000, good), (1, 206, 511, "", 0, good), (2, 404, 900, "", 0, good),
        (3, 200, 900, "text/html", 0, bytearray(b"G" * 40)), (4, 206, 900, "video/mp2t", 600_000, bytearray(b"G" * 40)), (5, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, status int, bytes long, content_type string, content_length long, head binary")
    got = evidence.evaluate_probe(df).orderBy("i").collect()
    assert [r.alive for r in got] == [True, False, False, False, True, False]
    assert [r.quality for r in got] == [70, None, None, None, 60, None]


def test_second_probe(spark):
    rows = [(0, "udp://x", None), (1, "http://a.migu.cn/x", None), (2, "http://[240e:1::]/", None), (3, "http://h/", 404), (4, "http://h/", 500), (5, "http://h/", None), (6, "", 200), (7, "http://h/", 206)]
    got = evidence.evaluate_second_probe(spark.createDataFrame(rows, "i int, url string, status int")).orderBy("i").collect()
    assert [r.direct_ok for r in got] == [True, True, True, True, False, False, False, True]
    strict = evidence.evaluate_second_probe(spark.createDataFrame(rows, "i int, url string, status int"), max_status=400).orderBy("i").collect()
    assert not strict[3].direct_ok


def test_legacy_verdict_is_not_valid_on_failure(spark):
    schema = "i int, name string, url string, stdout string, stderr string, status int, get_status int, elapsed_s double, speed double"
    rows = [
        (0, "n" * 150, "http://[::1]/", "", "", None, None, None, None),
        (1, "n", "http://h/", "codec_type=video", "", None, None, 0.5, 3.0),
        (2, "n", "http://h/", "codec_type=video", "Connection refused", 404, 403, 0.5, 3.0),
        (3, "n", "http://h/", "", "", 302, None, 4.0, 0.0),
        (4, "n", "http://h/", "", "", None, None, None, None),
        (5, "n", "http://h/", "", "", 403, 206, 2.0, 0.1),
    ]
    got = evidence.evaluate_probe_legacy(spark.createDataFrame(rows, schema)).orderBy("i").collect()
    assert [r.alive for r in got] == [True, True, False, False, False, True]
    assert [r.quality for r in got] == [100, 100, None, None, None, 60]
    assert [r.reason for r in got] == [None, None, "http 403", "slow", "unreachable", None]
    assert len(got[0].name) == 150
    cut = evidence.evaluate_probe_legacy(spark.createDataFrame(rows, schema), name_length=100).orderBy("i").first()
    assert len(cut.name) == 100
    unchecked = evidence.evaluate_probe_legacy(spark.createDataFrame(rows, schema), speed_check=False).orderBy("i").collect()
    assert unchecked[3].alive and unchecked[3].quality == 70


def test_revalidate(spark):
    rows = [
        ("a", "HEAD", 200, 0, None), ("b", "HEAD", 403, 0, None), ("b", "GET", 206, 20, "#EXTM3U"), ("c", "HEAD", 403, 0, None), ("c", "GET", 200, 20, "short"),
        ("d", "HEAD", 500, 0, None), ("d", "GET", 200, 99, "#EXTM3U"), ("e", "HEAD", 301, 0, None), ("f", "HEAD", 405, 0, None), ("f", "GET", 200, 99, "y" * 33),
    ]
    df = spark.createDataFrame(rows, "url string, method string, status int, bytes int, head string")
    assert {r.url for r in evidence.revalidate_links(df).filter("ok").collect()} == {"a", "b", "f"}
    assert {r.url for r in evidence.revalidate_links(df, legacy=True).filter("ok").collect()} == {"a", "b", "d", "e"}


def test_speed_and_latest(spark):
    df = spark.createDataFrame([("x", 1, 50, 0.0005), ("x", 2, 95, 2.0), ("y", 1, 50, 0.29)], "fp string, probed_at int, quality long, speed double")
    assert sorted(r.quality for r in evidence.apply_speed(df).collect()) == [52, 100]
    assert evidence.apply_speed(df, capped=False).agg(F.max("quality")).first()[0] == 115
    assert {r.fp: r.quality for r in evidence.latest_probe(df).collect()} == {"x": 95, "y": 50}


def test_running_rate_over_blocks(spark):
    df = spark.range(50).select(F.col("id").alias("seq"))
    a = evidence.running_valid_rate(df, "seq", F.col("seq") % 3 == 0, block=8).orderBy("seq").collect()
    valid = 0
    for i, r in enumerate(a):
        valid += i % 3 == 0
        assert (r.done, r.valid_so_far) == (i + 1, valid) and abs(r.valid_pct - valid * 100 / (i + 1)) < 1e-9


def test_throughput_of_no_time_by_sql(spark):
    rows = [(2000, 0.0), (1000, 0.0), (1024, 0.5), (3_000_000, 0.7), (None, 1.0), (2000, None), (0, None)]
    df = spark.createDataFrame(rows, "b bigint, s double")
    b, s = F.col("b"), F.col("s")
    got = df.select(scores.throughput(b, s).alias("m"), scores.throughput(b, s, legacy=True).alias("l")).collect()
    con = duckdb.connect()
    want = [con.execute("""SELECT CASE WHEN s > 0 THEN CAST(b AS DOUBLE) / 1024 / 1024 / s ELSE 0 END,
      CASE WHEN b < 1024 THEN 0 ELSE round(CAST(b AS DOUBLE) / 1024 / 1024 / s, 4) END FROM (SELECT ?::BIGINT AS b, ?::DOUBLE AS s)""", r).fetchone() for r in rows]
    # Unknown sizes count as nothing measured in the present form.
    assert [(r["m"], r["l"]) for r in got] == [(m or 0.0, l) for m, l in want]
