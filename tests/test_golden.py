"""Facts of the published daily list: order of categories, and order and labels of the numbered channels."""

from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import names
from linkloom.operators import ranking

# Group titles and channel labels as published, in their order.
CATEGORIES = ["4K专区", "港澳台频", "影视剧集", "央视频道", "卫视频道", "体育赛事", "少儿动漫", "新闻资讯", "音乐频道", "其他频道"]
NUMBERED = [
    "CCTV-1综合", "CCTV-2财经", "CCTV-3综艺", "CCTV-4中文国际", "CCTV-5体育", "CCTV-5+体育", "CCTV-6电影", "CCTV-7国防军事", "CCTV-8电视剧",
    "CCTV-9纪录", "CCTV-10科教", "CCTV-11戏曲", "CCTV-12社会与法", "CCTV-13新闻", "CCTV-14少儿", "CCTV-15音乐", "CCTV-17农业农村",
]


def test_category_order(spark):
    assert list(rules.CATEGORY_ORDER) == CATEGORIES
    df = spark.createDataFrame([(c,) for c in reversed(CATEGORIES)], "category string")
    assert [r["category"] for r in df.orderBy(ranking.category_rank(F.col("category"))).collect()] == CATEGORIES


def test_numbered_channels_keep_their_labels_category_and_order(spark):
    rows = [(i, n) for i, n in enumerate(NUMBERED)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "i int, name string").withColumns({
        "category": names.classify(F.col("name")), "shown": names.display(F.col("name")), "norm": names.normalize(F.col("name")),
    })
    assert {r["category"] for r in df.collect()} == {"央视频道"}
    order = ranking.natural_keys(F.col("norm"), F.lit(50), F.lit(True))
    got = df.orderBy(*order).collect()
    assert [r["name"] for r in got] == NUMBERED
    plain = [(r["shown"], r["name"]) for r in got if "+" not in r["name"]]
    assert all(shown.split("-")[1][:1] == name.split("-")[1][:1] for shown, name in plain)
