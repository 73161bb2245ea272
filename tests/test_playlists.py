"""Playlist parsing against a plain sequential reading of random documents, in both input forms."""

import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from linkloom.sources import catalogs, playlists

POOL = [
    "#EXTINF:-1,One", "#EXTINF:-1 tvg-name=\"T\" group-title=\"g\",Two, Three", "#EXTINF:-1", "#EXTINF:-1,", "#EXTINF:-1 tvg-name=\"\",Q",
    "#EXTVLCOPT:x", "", "  ", "http://h.com/a", "https://k.com/b,c", "name,http://z.com/1", "name,rtmp://z.com/1", "group,#genre#",
    "other", "#EXTM3U", " http://sp.com/x ", "#EXTINF:-1, Four ",
]


def documents():
    rnd = random.Random(5)
    return ["\n".join(rnd.choice(POOL) for _ in range(rnd.randrange(1, 25))) for _ in range(250)]


def last_comma(line):
    tail = line.rsplit(",", 1)
    return tail[1].strip() if len(tail) == 2 and tail[1] else None


def tvg(line):
    return line.split('tvg-name="', 1)[1].split('"', 1)[0] if 'tvg-name="' in line else None


def read_pending(lines):
    waiting = None
    for line in lines:
        if line.startswith("#EXTINF:"):
            waiting = last_comma(line) if last_comma(line) is not None else waiting
        elif line.startswith(("http://", "https://")):
            yield waiting or urlparse(line).netloc, line
            waiting = None
        elif line and line[0] != "#" and "," in line and not line.endswith(",#genre#"):
            name, rest = line.split(",", 1)
            if rest.strip().startswith("http"):
                yield name.strip(), rest.strip()


def read_legacy(lines):
    waiting = None
    for line in lines:
        if line.startswith("#EXTINF:"):
            found = tvg(line) if tvg(line) is not None else last_comma(line)
            waiting = found if found is not None else waiting
        elif line.startswith("http"):
            yield waiting or "未知频道", line
            waiting = None
        elif line and line[0] != "#" and "," in line:
            waiting, rest = (x.strip() for x in line.split(",", 1))
            if rest.startswith("http"):
                yield waiting, rest


def read_adjacent(lines):
    queue = list(lines)
    while queue:
        line = queue.pop(0)
        if line.startswith("#EXTINF:") and queue:
            name = tvg(line)
            if name is None:
                name = line.split(",", 1)[1].strip() if "," in line else "未知频道"
            url = queue.pop(0)
            if url and url[0] != "#":
                yield name, url
        elif line and line[0] != "#" and "," in line:
            name, url = line.split(",", 1)
            yield name.strip(), url.strip()


READERS = {"pending": read_pending, "legacy": read_legacy, "adjacent": read_adjacent}


@pytest.mark.parametrize("mode", playlists.MODES)
def test_both_forms_equal_sequential_reading(spark, mode):
    docs = documents()
    want = {}
    for i, d in enumerate(docs):
        lines = [x.strip() for x in (d.strip() if mode == "adjacent" else d).splitlines()]
        want[i] = sorted(READERS[mode](lines))
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, content string")
    by_doc = {i: [] for i in want}
    for r in playlists.ingest_playlists(df, mode, ["doc"]).collect():
        by_doc[r.doc].append((r.name, r.url))
    assert {k: sorted(v) for k, v in by_doc.items()} == want

    content = F.trim(F.col("content")) if mode == "adjacent" else F.col("content")
    text = F.regexp_replace(content, r"^\s+|\s+$", "") if mode == "adjacent" else content
    lines = df.select("doc", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line_no", F.col("line_no").cast("bigint"))
    for block in (3, 1 << 18):
        by_line = {i: [] for i in want}
        for r in playlists.parse_lines(lines, mode, ["doc"], block=block).collect():
            by_line[r.doc].append((r.name, r.url))
        assert {k: sorted(v) for k, v in by_line.items()} == want


def test_document_form_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "#EXTINF:-1,A\nhttp://h/a")], "doc int, content string")
    for mode in playlists.MODES:
        plan = playlists.ingest_playlists(df, mode, ["doc"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_consecutive_info_lines(spark):
    df = spark.createDataFrame([(1, "#EXTINF:-1,A\n#EXTINF:-1,B\nhttp://h/u")], "doc int, content string")
    assert playlists.ingest_playlists(df, "adjacent", ["doc"]).count() == 0
    assert [(r.name, r.url) for r in playlists.ingest_playlists(df, "pending", ["doc"]).collect()] == [("B", "http://h/u")]


def test_sniff_format(spark):
    long = "x" * 120
    df = spark.createDataFrame([(1, "#EXTM3U\n" + long), (2, long), (3, "#EXTM3U"), (4, "\n" * 12 + "#EXTM3U" + long)], "doc int, content string")
    assert {r.doc: r.is_m3u for r in playlists.sniff_format(df).collect()} == {1: True, 2: False, 4: False}


def test_read_catalog_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A,http://h/a,b\r\n\n  B , http://h/b  C\x0bD,x\n", encoding="utf8")
    got = catalogs.read_catalog(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()
    assert [(r.name, r.url) for r in got] == [("A", "http://h/a,b"), ("B", "http://h/b"), (None, None), ("D", "x")]


def test_large_files_keep_their_order(spark, tmp_path):
    breaks = ["\n", "\r\n", "\x0b", "\x0c", "\x85", "\u2028", "\u2029"]
    for name, n in (("a", 5000), ("b", 3000), ("c", 10)):
        text = "".join((f"{name}{i},http://h/{i}" if i % 7 else "") + breaks[i % len(breaks)] for i in range(n))
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = catalogs.read_large_catalog(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [(r.source_id[-5], r.name) for r in sorted(rows, key=lambda r: (r.source_id, r.line_no))]
    assert got == [(x, f"{x}{i}") for x, n in (("a", 5000), ("b", 3000), ("c", 10)) for i in range(n) if i % 7]
    assert len({(r.source_id, r.line_no) for r in rows}) == len(rows)
    whole = catalogs.read_catalog(spark, str(tmp_path)).collect()
    assert [(r.source_id, r.name, r.url) for r in sorted(whole, key=lambda r: (r.source_id, r.line_no))] == [
        (r.source_id, r.name, r.url) for r in sorted(rows, key=lambda r: (r.source_id, r.line_no))]


def test_grouped_catalog(spark):
    lines = ["x,http://before", "g1,#genre#", "a,u1", "g2,#genre#", "g1,#genre#", "b,u2", "plain", "c,u3"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no bigint, line string")
    for block in (2, 1000):
        got = catalogs.read_grouped_catalog(df, block=block).orderBy("line_no").collect()
        assert [(r.group_run, r.category, r.name, r.url) for r in got] == [(1, "g1", "a", "u1"), (4, "g1", "b", "u2"), (4, "g1", "c", "u3")]


def test_legacy_catalog(spark):
    df = spark.createDataFrame([("cat|n,u,v",), ("n,u",), ("|,",)], "line string")
    got = catalogs.read_legacy_catalog(df).collect()
    assert [(r.category, r.name, r.url) for r in got] == [("cat", "n", "u,v"), ("", "", "")]


def test_large_catalog_moves_texts_once(spark, request):
    from linkloom.queries.ingest import large_catalog

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan is known before the run
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.enabled"))
    out = large_catalog(spark, "/root/testdata/sf0.001")
    assert out.filter("not agree or n < 1").count() == 0
    moved = []

    def walk(node):
        if node.nodeName() == "Exchange":
            moved.append(node.output().toString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert moved and sum("name#" in m or "first#" in m for m in moved) == 1
