import ipaddress
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls

URLS = [
    "http://a.b:80/x/y.m3u8?b=2&a=1&a=3#f", "https://U:p@Host.COM:8443/p;x=1", "rtp://239.1.1.1:5000",
    "http://[2409:8087::1]:88/live", "http://a_b.com/中文 空格?x=1", "http://h", "http://h?x", "http://h#f",
    "http://h/a;b/c;d?e", "http://user@h:8/p@q", "ftp://h/x.tar.gz", "http://h/.m3u", "http://h/a/..", "",
]


def values(spark, items, **columns):
    df = spark.createDataFrame(list(enumerate(items)), "i int, u string")
    return df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()


def test_parts_equal_urlparse(spark):
    u = F.col("u")
    got = values(spark, URLS, netloc=urls.netloc(u), path=urls.path(u), query=urls.query(u), host=urls.host(u), scheme=urls.scheme(u))
    for url, r in zip(URLS, got):
        p = urlparse(url)
        assert (r.netloc, r.path, r.query, r.host, r.scheme) == (p.netloc, p.path, p.query, p.hostname or "", p.scheme), url


def test_non_public_hosts_equal_ipaddress(spark):
    rnd = random.Random(3)
    hosts = ["localhost", "example.com", "1.2.3", "256.1.1.1", "01.2.3.4", "::", "::1", "fe80::1", "fc00::5", "2001:db8::1",
             "2001:4860:4860::8888", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:3::9", "64:ff9b:1::1", "1::2::3", ":1", "12345::",
             "2409:8087:7000:20::a", "192.0.0.9", "192.0.0.8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7"]
    firsts = [0, 10, 100, 127, 169, 172, 192, 198, 203, 239, 240, 255, 8]
    hosts += [f"{rnd.choice(firsts)}.{rnd.choice([0, 16, 18, 31, 32, 51, 64, 168, 254])}.{rnd.choice([0, 2, 100, 113])}.{rnd.randrange(256)}" for _ in range(300)]
    hosts += [str(ipaddress.IPv6Address(rnd.getrandbits(128) >> rnd.choice([0, 0, 64, 112]))) for _ in range(100)]

    def expected(h):
        try:
            ip = ipaddress.ip_address(h)
        except ValueError:
            return False
        return ip.is_private or ip.is_loopback or ip.is_reserved

    got = values(spark, hosts, flag=urls.is_non_public(F.col("u")))
    wrong = [(h, r.flag) for h, r in zip(hosts, got) if r.flag != expected(h)]
    assert not wrong


@pytest.mark.parametrize(
    "url,expected",
    [
        ("http://h/1.m3u8", False), ("http://h/12345.m3u", False), ("http://h/a.m3u", False), ("http://h/ab.M3U8", True),
        ("http://h/epg.xml", False), ("http://h/list.txt", True), ("http://h/list.m3u?token=1", False),
        ("http://h/x/live/y", True), ("http://h/x.php?type=m3u", True), ("http://h:8080/abcdef", True),
        ("http://h:8080/ab", False), ("http://h:8080/stream", True), ("http://h/page", False), ("http://h/feeds", True),
    ],
)
def test_playlist_urls(spark, url, expected):
    assert values(spark, [url], x=urls.is_playlist(F.col("u")))[0].x is expected


def test_fingerprints(spark):
    us = ["http://H/live.php?id=a", "https://h/live.php?id=b", "http://h/live.php?b=1&a=2", "http://h/live.php?a=2&b=1"]
    r = values(spark, us, fp=urls.fingerprint(F.col("u")), c=urls.canonical(F.col("u")), k=urls.canonical(F.col("u"), ["id"]))
    assert len({x.fp for x in r}) == 1 and len(r[0].fp) == 16
    assert r[0].c != r[1].c and r[2].c == r[3].c == "http://h/live.php?a=2&b=1"
    assert r[2].k == "http://h/live.php" and r[0].k == "http://h/live.php?id=a"


def test_sanitize(spark):
    us = [
        "http://h/p?token=1&x=2&TOKEN=3", "http://h/p?x=&y=1", "http://h/p?x=1&y=2&x=3", "http://h/p?a=%7E*&sign=q#frag",
        "http://h/p?x=a+b%20c", "http://h/p", "name only", "http://h/p?md5=1",
    ]
    r = [x.s for x in values(spark, us, s=urls.sanitize(F.col("u")))]
    assert r == [
        "http://h/p?x=2", "http://h/p?y=1", "http://h/p?x=1&x=3&y=2", "http://h/p?a=~%2A#frag",
        "http://h/p?x=a+b+c", "http://h/p", "name only", "http://h/p",
    ]
    again = [x.s for x in values(spark, r, s=urls.sanitize(F.col("u")))]
    assert again == r


def test_scores_direct_and_mirrors(spark):
    us = ["https://x.oss-cn-hangzhou.aliyuncs.com/a", "https://raw.githubusercontent.com/o/r/main/d/a.m3u", "http://bit.ly/x",
          "http://a.jsdelivr.net/x", "http://h/x", "https://mygithub.io/x", "https://github.com/o/r/raw/dev/a.m3u"]
    r = values(spark, us, s=urls.domain_score(F.col("u")), d=urls.is_known_direct(F.col("u")), m=urls.mirrors(F.col("u")))
    assert [x.s for x in r] == [80, 100, 0, 60, 30, 70, 100]
    assert [x.d for x in r] == [True, False, False, True, False, False, False]
    assert [len(x.m) for x in r] == [1, 4, 1, 1, 1, 1, 5]
    assert r[6].m[1] == "https://raw.githubusercontent.com/o/r/dev/a.m3u"
    assert r[1].m[1] == "https://testingcf.jsdelivr.net/gh/o/r@main/d/a.m3u"
