"""Grouping, ranking and capping of channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.scale import first_per_key, first_rows, rank_by, rank_within, top_per_key

GROUP = ("category", "norm_name")


def group_best(df: DataFrame, keys: Sequence[str] = GROUP, seq: str = "seq") -> DataFrame:
    """Best quality and first entry per channel."""
    return df.groupBy(*keys).agg(
        F.max("quality").alias("best"), F.min(seq).alias("first_seq"), F.count("*").alias("n_links")
    )


def topk_per_name(df: DataFrame, k: int, keys: Sequence[str] = GROUP, seq: str = "seq") -> DataFrame:
    """The best ``k`` links per channel, with ``rn`` as their rank; 0 ranks and keeps all."""
    if k <= 0:
        return rank_within(df, list(keys), [F.desc("quality"), F.asc(seq)], "rn")
    return top_per_key(df, list(keys), [F.desc("quality"), F.asc(seq)], k, "rn")


def category_rank(category: Column, order: Sequence[str] = tuple(rules.CATEGORY_ORDER)) -> Column:
    """Position of a category; unlisted ones share the last place."""
    table = F.array(*[F.lit(c) for c in order])
    found = F.array_position(table, category)
    return F.when(found > 0, found - 1).otherwise(len(order) - 1).cast("bigint")


def listed_category(category: Column, order: Sequence[str] = tuple(rules.CATEGORY_ORDER)) -> Column:
    """The category itself, or the last of the order where it is not listed."""
    return F.when(category.isin(list(order)), category).otherwise(F.lit(order[-1]))


def natural_keys(norm_name: Column, best: Column, numbered: Column, prefix: str = "CCTV-?") -> list[Column]:
    """Order of channels inside a category.

    Numbered categories go by channel number, ``5+`` right after 5, the rest last by quality;
    other categories go by quality.
    """
    number = F.regexp_extract(norm_name, rf"(?iU)^{prefix}(\d+)(\+?)", 1).try_cast("bigint")
    plus = F.regexp_extract(norm_name, rf"(?iU)^{prefix}(\d+)(\+?)", 2)
    main = F.when(~numbered | number.isNull(), 999).otherwise(number)
    minor = F.when(~numbered | number.isNull(), -best).when((number == 5) & (plus != ""), 1).otherwise(0)
    return [F.when(numbered, main).otherwise(0), minor]


def tier_keys(name: Column, best: Column, prefix: str = "CCTV", last: int = 17, plus: str = "CCTV5+") -> list[Column]:
    """Earlier order: numbers up to ``last``, then the plus channel, higher numbers, the rest by quality."""
    number = F.regexp_extract(name, rf"{prefix}(\d+)$", 1).try_cast("bigint")
    tier = (
        F.when(number.between(1, last), 0).when(name == plus, 1).when(number.isNotNull(), 2).otherwise(3)
    )
    return [tier, F.when(tier.isin(0, 2), number).otherwise(0), F.when(tier == 3, -best).otherwise(0)]


def order_channels(best: DataFrame, keys: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the position of each channel under a list of order columns."""
    return rank_by(best, keys, name)


def numbered_category(category: Column) -> Column:
    return category.rlike("央视|央視")


def output_order(df: DataFrame, keys: Sequence[str] = GROUP) -> list[Column]:
    """Order of published rows; needs ``best``, ``first_seq`` and ``rn`` beside the channel keys."""
    cat = F.col("category")
    return [
        category_rank(cat),
        *natural_keys(F.col(keys[-1]), F.col("best"), numbered_category(cat)),
        F.col("first_seq"),
        F.col(keys[-1]),
        F.col("rn"),
    ]


def with_channel_stats(top: DataFrame, stats: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Add ``best`` and ``first_seq`` (from ``group_best``) to the top rows of each channel."""
    return top.join(stats.select(*keys, "best", "first_seq"), list(keys))


def global_cap(df: DataFrame, order: Sequence[Column], limit: int, name: str = "line_no") -> DataFrame:
    """The first ``limit`` rows in output order (ascending expressions), numbered; 0 keeps and numbers all rows."""
    return rank_by(df, order, name) if limit <= 0 else first_rows(df, order, limit, name)


def cap_per_display_name(df: DataFrame, k: int, run: str = "group_run", order: str = "line_no") -> DataFrame:
    """At most ``k`` urls per name inside a group run; ``name_at`` is where the name first appeared."""
    usable = df.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    top = top_per_key(usable, [run, "name"], [F.col(order)], k, "rn")
    # At most k rows per name are left, so this window is small.
    return top.withColumn("name_at", F.min(order).over(Window.partitionBy(run, "name")))


def fallback_fill(
    df: DataFrame, k: int, threshold: int, keys: Sequence[str] = ("category", "name"), seq: str = "seq"
) -> DataFrame:
    """The best ``k`` good links per name; names short of ``k`` are topped up from weak links.

    Names without a good link get nothing. ``is_fallback`` marks the added rows.
    """
    flagged = df.withColumn("is_fallback", F.col("quality") < threshold)
    top = top_per_key(flagged, [*keys, "is_fallback"], [F.desc("quality"), F.asc(seq)], max(k, 1), "rn")
    # At most 2k rows per name are left, so this window is small.
    good = F.count_if(~F.col("is_fallback")).over(Window.partitionBy(*keys))
    room = F.greatest(F.lit(k) - F.col("_good"), F.lit(1))
    return (
        top.withColumn("_good", good)
        .filter((F.col("_good") > 0) & (~F.col("is_fallback") | ((F.col("_good") < k) & (F.col("rn") <= room))))
        .drop("_good")
    )


def proportional_quota(
    df: DataFrame,
    limit: int,
    order: Sequence[str] = tuple(rules.CATEGORY_ORDER),
    other: Sequence[str] = (rules.OTHER_CATEGORY,),
    name: str = "norm_name",
    floor: int = 30,
) -> DataFrame:
    """Integer quota per category: ``other`` categories by share but at least ``floor``, the rest
    by floor share of what is left, the remainder to the first category present. Unlisted categories count as the last one."""
    names = df.select(listed_category(F.col("category"), order).alias("category"), name).distinct()
    counts = names.groupBy("category").agg(F.count("*").alias("n"))
    # One row per category from here on: as many rows as the category table has.
    everything = Window.partitionBy()
    is_other = F.col("category").isin(list(other))
    total, n_other = F.sum("n").over(everything), F.sum(F.when(is_other, F.col("n")).otherwise(0)).over(everything)
    c = counts.withColumns({"rank": category_rank(F.col("category"), order), "_total": total, "_other": n_other})
    c = c.withColumn("_oq", F.greatest(F.lit(floor), F.expr(f"_other * {limit}L div greatest(_total, 1)")))
    c = c.withColumn("_pq", F.greatest(F.lit(0), F.lit(limit) - F.col("_oq")))
    share = F.expr("n * _pq div greatest(_total - _other, 1)")
    c = c.withColumn("_q", F.when(is_other, F.col("_oq")).otherwise(share).cast("bigint"))
    left = F.lit(limit) - F.sum("_q").over(everything)
    first = F.col("rank") == F.min("rank").over(everything)
    quota = F.col("_q") + F.when(first, left).otherwise(0)
    return c.withColumn("quota", quota.cast("bigint")).select("category", "rank", "n", "quota")


def enforce_quota(df: DataFrame, quota: DataFrame, order: Sequence[Column], categories: Sequence[str] = tuple(rules.CATEGORY_ORDER)) -> DataFrame:
    """Keep each category's first ``quota`` rows in output order (ascending expressions); unlisted categories share the last one's
    quota."""
    listed = df.withColumn("_listed", listed_category(F.col("category"), categories))
    quotas = quota.select(F.col("category").alias("_listed"), "quota")
    return first_per_key(listed, ["_listed"], order, quotas, "quota", "_n").drop("_n", "_listed")
