"""Queries over channel names."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import names
from linkloom.operators import filters, matching, runs
from linkloom.queries import sql as q
from linkloom.queries.carriers import ctes, table
from linkloom.queries.registry import query

C = ctes("names")


def _simple(c: str) -> str:
    return f"translate({c}, '{rules.TRADITIONAL}', '{rules.SIMPLIFIED}')"


def _clean(c: str) -> str:
    for p in rules.NAME_NOISE:
        c = f"regexp_replace({c}, {q.quote(p)}, '', 'gi')"
    c = f"regexp_replace({c}, '[\\s_·•]+', '', 'g')"
    return q.strip(f"regexp_replace({c}, '^[\\s_·•\\-]+|[\\s_·•\\-]+$', '', 'g')")


def _aliases(c: str) -> str:
    """Exact aliases, then contained ones in order, over a column name."""
    exact = " ".join(f"WHEN {c} = '{a}' THEN '{b}'" for a, b in rules.ALIASES)
    partial = " ".join(f"WHEN contains({c}, '{a}') THEN replace({c}, '{a}', '{b}')" for a, b in rules.ALIASES)
    return f"CASE {exact} {partial} ELSE {c} END"


@query("name_simplify", f"{C} SELECT seq, {_simple('name')} AS name FROM names")
def name_simplify(spark, sf):
    return table(spark, sf, "names").select("seq", names.simplify(F.col("name")).alias("name"))


@query("name_clean", f"{C}, s AS (SELECT seq, {_simple('name')} AS s FROM names) SELECT seq, {_clean('s')} AS name FROM s")
def name_clean(spark, sf):
    return table(spark, sf, "names").select("seq", names.clean(names.simplify(F.col("name"))).alias("name"))


@query("name_normalize", f"""{C}, s AS (SELECT seq, upper({_simple('name')}) AS s FROM names), c AS (SELECT seq, {_clean('s')} AS c FROM s),
a AS (SELECT seq, {_aliases('c')} AS a FROM c),
t AS (SELECT seq, regexp_replace(a, '^(CCTV-?[0-9]+[+]?)({"|".join(rules.CCTV_TYPE_SUFFIXES)})?$', '\\1') AS t FROM a)
SELECT seq, regexp_replace(regexp_replace(regexp_replace(t, '^CCTV([0-9]+[+]?)$', 'CCTV-\\1'),
  '(卫视|电视)({"|".join(rules.QUALITY_SUFFIXES)})?$', '\\1'), '\\s+', '', 'g') AS name FROM t""")
def name_normalize(spark, sf):
    return table(spark, sf, "names").select("seq", names.normalize(F.col("name")).alias("name"))


def _labels() -> str:
    out = []
    for n, word, shown in rules.CCTV_LABELS:
        if n == 5:
            out.append(f"WHEN contains(name, '{word}') AND num = '5' THEN concat('CCTV-5', plus, '{shown}')")
        else:
            out.append(f"WHEN contains(name, '{word}') OR num = '{n}' THEN 'CCTV-{n}{shown}'")
    return " ".join(out)


@query("name_display", f"""{C}, s AS (SELECT seq, name, {_simple('name')} AS s FROM names), c AS (SELECT seq, name, {_clean('s')} AS c FROM s),
m AS (SELECT *, regexp_extract(c, '(?i)^CCTV[-\\s]*([0-9]+)([+])?', 1) AS num, regexp_extract(c, '(?i)^CCTV[-\\s]*([0-9]+)([+])?', 2) AS plus FROM c)
SELECT seq, CASE WHEN num = '' THEN c {_labels()} ELSE concat('CCTV-', num, plus) END AS name FROM m""")
def name_display(spark, sf):
    return table(spark, sf, "names").select("seq", names.display(F.col("name")).alias("name"))


def _legacy_prefix() -> str:
    out = []
    for p in rules.LEGACY_OVERSEAS_PREFIXES:
        pattern = f"(?i)({p}[A-Za-z0-9一-鿿]+)"
        out.append(
            f"CASE WHEN starts_with(upper(n), '{p.upper()}') AND length(n) > {len(p) + 1} "
            f"THEN nullif(regexp_extract(n, '{pattern}', 1), '') END"
        )
    return f"coalesce({', '.join(out)}, n)"


def _legacy_number(c: str) -> str:
    num = f"TRY_CAST(regexp_extract(upper({c}), 'CCTV[^0-9]*?([0-9]{{1,2}})', 1) AS INTEGER)"
    return (
        f"CASE WHEN {num} IS NULL THEN {c} WHEN {num} = 5 AND contains({c}, '+') THEN 'CCTV5+' "
        f"WHEN {num} = 4 AND contains(upper({c}), 'K') THEN 'CCTV4K' ELSE concat('CCTV', {num}) END"
    )


_SUFFIX = r"(?i)([-_—～•·:\s|/\\]+|HD|1080p|720p|360p|540p|高清|超清|超高清|标清|主线|备用\d*|线路\d*)$"


@query("name_clean_legacy", f"""{C}, p AS (SELECT seq, name AS n FROM names), x AS (SELECT seq, {_legacy_prefix()} AS n FROM p),
y AS (SELECT seq, regexp_replace(n, '\\(.*?\\)|\\[.*?\\]|【.*?】|《.*?》|<.*?>|[{{].*[}}]|（.*?）', '', 'g') AS n FROM x),
z AS (SELECT seq, n, regexp_extract(n, '(?i)(CCTV\\s*[-—_～•·:\\s]*[0-9]{{1,2}}[+]?)', 1) AS num,
  regexp_matches(n, '(?i)4K|8K|UHD|ULTRAHD|2160|HDR|超高清|杜比视界') AS hires, trim({_simple(f"regexp_replace(n, '{_SUFFIX}', '')")}) AS rest FROM y)
SELECT seq, CASE WHEN NOT hires AND num <> '' THEN {_legacy_number('num')} ELSE
  CASE WHEN rest = '' THEN '未知频道' ELSE trim({_legacy_number('rest')}) END END AS name FROM z""")
def name_clean_legacy(spark, sf):
    return table(spark, sf, "names").select("seq", names.clean_legacy(F.col("name")).alias("name"))


def _classify(c: str) -> str:
    steps = []
    for cat in rules.CATEGORY_ORDER:
        ws = rules.CATEGORY_RULES.get(cat)
        if ws:
            steps.append(f"WHEN regexp_matches({c}, '(?i)' || {q.words(ws)}) THEN '{cat}'")
    return (
        f"CASE WHEN regexp_matches({c}, '(?i)CCTV-?[0-9]') THEN '央视频道' WHEN contains({c}, '卫视') THEN '卫视频道' "
        f"{' '.join(steps)} WHEN regexp_matches({c}, '中央|央视') THEN '央视频道' ELSE '其他频道' END"
    )


CLASSIFIED = f"{C}, s AS (SELECT seq, name, {_simple('name')} AS s FROM names), k AS (SELECT seq, name, {_classify('s')} AS category FROM s)"


@query("keyword_classify", f"{CLASSIFIED} SELECT seq, category FROM k")
def keyword_classify(spark, sf):
    return table(spark, sf, "names").select("seq", names.classify(F.col("name")).alias("category"))


@query("keyword_classify_counts", f"{CLASSIFIED} SELECT category, count(*) AS n FROM k GROUP BY 1")
def keyword_classify_counts(spark, sf):
    df = table(spark, sf, "names").withColumn("category", names.classify(F.col("name")))
    return runs.category_counts(df, None)


@query("classify_legacy", f"""{C}, s AS (SELECT seq, {_simple('name')} AS s FROM names)
SELECT seq, CASE WHEN regexp_matches(s, {q.words(rules.BLACKLIST)}) THEN '其他' {" ".join(
    f"WHEN regexp_matches(s, '(?i)' || {q.words(ws)}) THEN '{cat}'" for cat, ws in ((c, rules.CATEGORY_RULES.get(c)) for c in rules.CATEGORY_ORDER) if ws)}
  ELSE '其他频道' END AS category FROM s""")
def classify_legacy(spark, sf):
    return table(spark, sf, "names").select("seq", names.classify_legacy(F.col("name")).alias("category"))


# A rule per part type and noun; keywords are words of part names.
_RULES = """SELECT min(p_partkey) AS cat_rank, p_type AS category, split_part(p_name, ' ', 2) AS keyword FROM {part}
GROUP BY p_type, split_part(p_name, ' ', 2)"""


@query("classify_by_table", f"""{C}, r AS ({_RULES.format(part='part')}), u AS (SELECT DISTINCT name FROM names),
m AS (SELECT u.name, arg_min(category, cat_rank) AS category FROM u JOIN r ON contains(lower(u.name), lower(keyword)) GROUP BY 1)
SELECT n.seq, coalesce(m.category, 'none') AS category FROM names n LEFT JOIN m ON n.name = m.name""")
def classify_by_table(spark, sf):
    rule_table = spark.sql(_RULES, part=table(spark, sf, "part"))
    return matching.classify_by_table(table(spark, sf, "names"), rule_table, "none").select("seq", "category")


# Keywords of one to some forty letters in whole documents: single letters, short words, and passages of the benchmark.
_KEYWORDS = """SELECT CAST(item_id AS BIGINT) * 4 + n AS cat_rank, concat('k', item_id % 50, '-', n) AS category, CASE n WHEN 0 THEN substring(text, 1, 40) WHEN 1 THEN substring(text, 3, 2)
  WHEN 2 THEN upper(substring(text, 5, 7)) ELSE '' END AS keyword FROM {benchmark} CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(n)"""


@query("classify_texts", f"""WITH r AS ({_KEYWORDS.format(benchmark='benchmark')}),
m AS (SELECT doc_id, arg_min(category, cat_rank) AS category FROM documents JOIN r ON length(keyword) > 0 AND contains(lower(text), lower(keyword)) GROUP BY 1)
SELECT doc_id, coalesce(category, 'none') AS category FROM documents LEFT JOIN m USING (doc_id)""")
def classify_texts(spark, sf):
    """The table form on long texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rule_table = spark.sql(_KEYWORDS, benchmark=table(spark, sf, "benchmark"))
    return matching.classify_by_table(docs, rule_table, "none", "text").select("doc_id", "category")


_ALIASES = "SELECT * FROM (VALUES {rows}) AS v(alias, canonical, ord)".format(
    rows=", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(rules.ALIASES))
)


@query("alias_exact", f"{C} SELECT seq, name, canonical FROM names LEFT JOIN ({_ALIASES}) ON name = alias")
def alias_exact(spark, sf):
    return matching.alias_exact(table(spark, sf, "names"), spark.sql(_ALIASES)).select("seq", "name", "canonical")


@query("alias_partial", f"""{C}, a AS ({_ALIASES}), m AS (SELECT seq, arg_min(alias, ord) AS alias, arg_min(canonical, ord) AS canonical
  FROM names JOIN a ON contains(name, alias) GROUP BY seq)
SELECT n.seq, coalesce(replace(n.name, alias, canonical), n.name) AS canonical FROM names n LEFT JOIN m ON n.seq = m.seq""")
def alias_partial(spark, sf):
    return matching.alias_partial(table(spark, sf, "names"), spark.sql(_ALIASES)).select("seq", "canonical")


REGION = f"regexp_matches(name, '(?i)' || {q.words(rules.OVERSEAS_KEYWORDS)})"


@query("region_flag", f"{C} SELECT seq, {REGION} AS overseas, CAST(CASE WHEN {REGION} THEN 15 ELSE 8 END AS BIGINT) AS timeout_s FROM names")
def region_flag(spark, sf):
    return filters.flag_region(table(spark, sf, "names")).select("seq", "overseas", "timeout_s")


@query("region_counts", f"{C} SELECT count(*) FILTER (NOT {REGION}) AS cn, count(*) FILTER ({REGION}) AS overseas FROM names")
def region_counts(spark, sf):
    return runs.region_counts(filters.flag_region(table(spark, sf, "names")))


@query("blacklist_default", f"{C} SELECT seq, name FROM names WHERE NOT regexp_matches(name, {q.words(rules.BLACKLIST)})")
def blacklist_default(spark, sf):
    return filters.drop_blacklisted(table(spark, sf, "names")).select("seq", "name")
