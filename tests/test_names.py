import pytest
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import names
from linkloom.operators import matching

CASES = [
    # raw, normalised, shown, category
    ("CCTV-1综合", "CCTV-1", "CCTV-1综合", "央视频道"),
    ("湖南卫视高清", "湖南卫视", "湖南卫视", "卫视频道"),
    ("湖南经济频道", "湖南CCTV-2", "湖南经济频道", "卫视频道"),
    ("TVBS新闻", "TVBS新闻新闻", "TVBS新闻", "港澳台频"),
    ("CCTV-1综合频道", "CCTV-1CCTV-1", "CCTV-1综合", "央视频道"),
    ("CCTV4K", "CCTV-4K", "CCTV-4中文国际", "央视频道"),
    ("cctv5+ HD", "CCTV-5+", "CCTV-5+", "央视频道"),
    ("CCTV5+体育", "CCTV-5+", "CCTV-5+体育", "央视频道"),
    ("鳳凰衛視", "凤凰", "凤凰卫视", "卫视频道"),
    ("湖南电视台", "湖南卫视", "湖南电视台", "卫视频道"),
    ("翡翠　台 [HD]", "翡翠", "翡翠台", "港澳台频"),
    ("高清HD", "", "", "其他频道"),
    ("", "", "", "其他频道"),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "i int, name string")
    n = F.col("name")
    return df.select("i", names.normalize(n).alias("n"), names.display(n).alias("d"), names.classify(n).alias("c")).orderBy("i").collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_names(results, i):
    r = results[i]
    assert (r.n, r.d, r.c) == CASES[i][1:]


def test_legacy_clean(spark):
    cases = {
        "📺 CCTV-05+ 高清": "CCTV5+", "CCTV4K超高清": "CCTV4K", "湖南卫视(备)高清": "湖南卫视",
        "  ": "未知频道", "【x】": "未知频道", "HBO2高清版": "HBO2高清版",
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r.name: r.c for r in df.select("name", names.clean_legacy(F.col("name")).alias("c")).collect()}
    assert got == cases


def test_table_forms_equal_literal_forms(spark):
    raw = [c[0] for c in CASES] + ["凤凰卫视中文台", "中央十一台x", "A" * 40]
    df = spark.createDataFrame([(x,) for x in raw], "name string")
    aliases = spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(rules.ALIASES)], "alias string, canonical string, ord int")
    by_table = {r.name: r.canonical for r in matching.alias_partial(df, aliases).collect()}

    def first_contained(n):
        for a, c in rules.ALIASES:
            if a in n:
                return n.replace(a, c)
        return n

    assert by_table == {n: first_contained(n) for n in raw}
    exact = {r.name: r.canonical for r in matching.alias_exact(df, aliases).collect()}
    assert exact == {n: dict(rules.ALIASES).get(n) for n in raw}

    words = [(cat, rank, w) for rank, cat in enumerate(rules.CATEGORY_ORDER) for w in rules.CATEGORY_RULES.get(cat, [])]
    table = spark.createDataFrame(words, "category string, cat_rank int, keyword string")
    got = {r.name: r.category for r in matching.classify_by_table(df, table, "其他频道").collect()}
    want = {n: next((c for c, _, w in words if w.lower() in n.lower()), "其他频道") for n in raw}
    assert got == want
    plan = matching.classify_by_table(df, table, "x")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_case_sensitivity(spark):
    df = spark.createDataFrame([("测试 a",), ("Free tv",), ("ok",)], "name string")
    flags = df.select(names.is_blacklisted(F.col("name"), ["FREE", "测试"]).alias("a"), names.is_blacklisted(F.col("name"), ["FREE"], False).alias("b")).collect()
    assert [r.a for r in flags] == [True, True, False] and not any(r.b for r in flags)
