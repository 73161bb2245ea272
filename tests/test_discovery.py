from pyspark.sql import functions as F

from linkloom.operators import discovery, filters
from linkloom.plans.discover import discover

TEXT = """#EXTM3U
#EXTINF:-1,http://in.info/list.m3u
http://plain.com/page
http://a.com/live/list
chan , rtsp://x
chan,http://any.com/x
see http://sub.com/two.m3u8, "http://sub.com/list.txt" and http://c.com:8080/abcdef) or http://h.com/epg.xml
HTTP://UP.com/feed.m3u'
"""


def test_links(spark):
    docs = spark.createDataFrame([("d", TEXT)], "source_id string, content string")
    assert {r.link for r in discovery.extract_line_urls(docs).collect()} == {"http://a.com/live/list", "http://any.com/x"}
    links = {r.link for r in discovery.extract_links(docs).collect()}
    assert {"http://in.info/list.m3u", "http://sub.com/two.m3u", "http://sub.com/list.txt", "http://c.com:8080/abcdef",
            "HTTP://UP.com/feed.m3u", "http://a.com/live/list"} <= links
    assert not any("epg.xml" in x for x in links)


def test_frontier_takes_the_last_seed(spark):
    docs = spark.createDataFrame(
        [
            ("s1", "go http://sub.com/list.m3u\nn,http://direct.com/1"), ("s2", "go http://sub.com/list.m3u\nn,http://direct.com/1"),
            ("http://sub.com/list.m3u", "n,http://pair.com/1\nhttp://below.com/live/1\nhttp://bit.ly/live/x\nhttp://plain.com/page\ngo http://third.com/list.m3u"),
            ("http://third.com/list.m3u", "http://too.deep/live/1"), ("s4", "prose only, see http://prose.com/list.m3u"), ("http://prose.com/list.m3u", "http://prose.com/live/2"),
        ],
        "url string, content string",
    )
    seeds = spark.createDataFrame([("s1", 1, "one"), ("s2", 2, "two"), ("s3", 3, "three"), ("s4", 4, "four")], "url string, seed_rank long, domain string")
    got = {r.link: r.domain for r in discovery.expand_frontier(seeds, docs).collect()}
    assert got == {"http://direct.com/1": "two", "http://below.com/live/1": "two"}
    plan = discovery.expand_frontier(seeds, docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_frontier_cap_keeps_every_seed(spark):
    subs = "n,http://own.com/1\ngo " + " ".join(f"http://sub.com/l{i:02d}.m3u" for i in range(30))
    docs = spark.createDataFrame([("s1", subs), ("s2", subs)] + [(f"http://sub.com/l{i:02d}.m3u", f"http://x.com/live/{i}") for i in range(30)], "url string, content string")
    seeds = spark.createDataFrame([("s1", 1, "one"), ("s2", 2, "two")], "url string, seed_rank long, domain string")
    assert discovery.expand_frontier(seeds, docs, cap=4).count() == 5
    assert discovery.expand_frontier(seeds, docs).count() == 31


def test_discover_uses_mirrors(spark):
    raw = "https://raw.githubusercontent.com/o/r/main/a.m3u"
    docs = spark.createDataFrame(
        [
            (raw, 500, ""), ("https://testingcf.jsdelivr.net/gh/o/r@main/a.m3u", 200, "<html>blocked"),
            ("https://mirror.ghproxy.com/" + raw, 200, "n,http://h.com/live/one.m3u8\nn,http://h.com/12.ts"),
        ],
        "url string, status int, content string",
    )
    seeds = spark.createDataFrame([(raw, 0)], "url string, seed_rank long")
    got = {r.url: r.name for r in discover(seeds, docs).collect()}
    assert got == {"http://h.com/live/one.m3u8": "raw.githubusercontent.com", "http://h.com/12.ts": "raw.githubusercontent.com"}


def test_ranks_and_antibot(spark):
    df = spark.createDataFrame([("http://h/1",), ("https://github.com/x",), ("http://bit.ly/1",), ("http://a/1",)], "url string")
    assert [r.url for r in discovery.rank_by_domain_score(df, 3).orderBy("position").collect()] == ["https://github.com/x", "http://a/1", "http://h/1"]
    docs = spark.createDataFrame([("a" * 300 + "<html>",), ("  <!DOCTYPE html>",), ("Rate Limit exceeded",), ("x",)], "content string")
    assert filters.filter_antibot(docs).count() == 2
    assert filters.filter_antibot(docs, legacy=True).count() == 0
    names = spark.createDataFrame([("http://h/a/list.m3u", "h"), ("http://h/a/123.m3u", "h"), ("http://h/abc.m3u", "h")], "link string, domain string")
    assert {r.name for r in discovery.name_discovered(names).collect()} == {"list (h)", "h"}
    assert filters.sane_candidates(df.unionByName(spark.createDataFrame([("javascript:void(0) something",), ("http://long.example/x",)], "url string"))).count() == 3


def test_links_are_sought_on_likely_lines_alone(spark, monkeypatch):
    prose = "no link here, at all\n" * 50
    links = ["http://a.example.com/live/x.m3u8", "HTTPS://B.example.com:8080/tv/1", "name,http://c.example.com/q", "http\u017f://d.example.com/live/z", "n,httpfoo"]
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x1c", "\u2028", "\x85", " ", "\t"]
    texts = [prose + b.join([" ", *links, "x"]) + b + prose + b.join(links) for b in breaks] + [None, "", "\n", prose, links[0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")

    def found():
        c = F.col("content")
        return [tuple(r) for r in df.select("i", discovery.found_links(c), discovery.line_links(c)).orderBy("i").collect()]

    got = found()
    kept = {r.i: r.n for r in df.select("i", F.length(discovery._likely(F.col("content"))).alias("n")).collect()}
    assert kept[0] < 1000 and kept[len(breaks) + 3] == 0
    monkeypatch.setattr(discovery, "_likely", lambda content: content)
    assert got == found() and all(got[i][1] for i in range(len(breaks)))


def test_beginnings_are_judged_without_a_pass_over_the_text(spark):
    from linkloom.operators.filters import filter_antibot

    texts = ["\u3000\n <HTML> x", " " * 300 + "<html", "x" * 195 + "<html>", "x" * 196 + "<html>", " {\"code\" ", "fine  ", "", " \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    out = filter_antibot(df)
    assert [r.i for r in out.orderBy("i").collect()] == [3, 5, 6, 7]
    assert "ltrim(" in out._jdf.queryExecution().optimizedPlan().toString().lower()
