"""Run statistics and their history."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.operators.ranking import category_rank
from linkloom.scale import lag_in_order


def region_counts(df: DataFrame) -> DataFrame:
    """Valid links at home and overseas."""
    return df.agg(F.count_if(~F.col("overseas")).alias("cn"), F.count_if("overseas").alias("overseas"))


def category_counts(df: DataFrame, order: Sequence[str] | None = tuple(rules.CATEGORY_ORDER)) -> DataFrame:
    """Rows per category; with an ``order`` every listed category appears, zero or not."""
    counts = df.groupBy("category").agg(F.count("*").alias("n"))
    if order is None:
        return counts
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in order])).alias("category"))
    return (
        listed.join(counts, "category", "left")
        .select("category", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("cat_rank", category_rank(F.col("category"), order))
    )


def run_summary(
    links: DataFrame, written: Column | None = None, filtered: Column | None = None, duration_s: Column | None = None
) -> DataFrame:
    """One row of totals over links with an ``alive`` flag."""
    total, valid = F.count("*"), F.count_if("alive")
    zero = F.lit(0).cast("bigint")
    return links.agg(
        total.alias("total"),
        valid.alias("valid"),
        (total - valid).alias("failed"),
        F.coalesce(F.count_if(filtered) if filtered is not None else zero, zero).alias("filtered"),
        F.coalesce(F.count_if(written) if written is not None else zero, zero).alias("written"),
        F.coalesce(F.try_divide(valid * 100.0, total), F.lit(0.0)).alias("success_rate"),
        (F.max(duration_s) if duration_s is not None else F.lit(0.0)).cast("double").alias("duration_s"),
    )


def run_record(
    judged: DataFrame, channels: DataFrame, catalog: DataFrame, run_id: str, run_ts: Column,
    filtered: Column | None = None, duration_s: float = 0.0,
) -> DataFrame:
    """The history row of one run.

    ``judged`` are the candidates with ``alive``, ``channels`` the links valid in the end with
    ``overseas``, ``catalog`` the written rows with ``category``. All parts are aggregates,
    brought together as scalar subqueries.
    """
    written = catalog.groupBy("category").agg(F.count("*").alias("n"))
    # One entry per category, as many as the category table has.
    by_category = written.agg(F.map_from_entries(F.collect_list(F.struct("category", "n")))).scalar()
    regions = region_counts(channels).select(F.struct("cn", "overseas")).scalar()
    row = run_summary(judged, filtered=filtered).drop("valid", "written", "duration_s").withColumns(
        {
            "valid": channels.agg(F.count("*")).scalar(),
            "written": catalog.agg(F.count("*")).scalar(),
            "by_category": by_category,
            "by_overseas": regions,
        }
    )
    rate = F.coalesce(F.try_divide(F.col("valid") * 100.0, F.col("total")), F.lit(0.0))
    return row.select(
        F.lit(run_id).alias("run_id"), run_ts.alias("run_ts"), "total", "valid", "failed", "filtered", "written",
        rate.alias("success_rate"), F.lit(float(duration_s)).alias("duration_s"), "by_category", "by_overseas",
    )


class RunCounters:
    """Counts what a run writes while it is written: each table is handed through once, and nothing is read again.

    ``categories`` are those that the catalog can have.
    """

    def __init__(self, categories: Sequence[str]):
        self.categories = list(dict.fromkeys(categories))
        self.parts = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("judged", "channels", "catalog")}

    def judged(self, df: DataFrame, filtered: Column | None = None) -> DataFrame:
        """Candidates with ``alive``; ``filtered`` tells those taken out for their speed."""
        out = F.count_if(F.coalesce(filtered, F.lit(False)) if filtered is not None else F.lit(False))
        return df.observe(self.parts["judged"], F.count("*").alias("total"), F.count_if("alive").alias("alive"), out.alias("filtered"))

    def channels(self, df: DataFrame) -> DataFrame:
        """The links valid in the end, with ``overseas``."""
        return df.observe(self.parts["channels"], F.count("*").alias("valid"), F.count_if("overseas").alias("overseas"), F.count_if(~F.col("overseas")).alias("cn"))

    def catalog(self, df: DataFrame) -> DataFrame:
        """The written rows, with ``category``."""
        each = [F.count_if(F.col("category") == c).alias(f"c{i}") for i, c in enumerate(self.categories)]
        return df.observe(self.parts["catalog"], F.count("*").alias("written"), *each)

    def record(self, spark: SparkSession, run_id: str, run_ts: Column, duration_s: float = 0.0) -> DataFrame:
        """The history row, as of ``run_record``; the three tables must have been written."""
        judged, channels, catalog = (self.parts[n].get for n in ("judged", "channels", "catalog"))
        by_category = {c: catalog[f"c{i}"] for i, c in enumerate(self.categories) if catalog[f"c{i}"]}
        if sum(by_category.values()) != catalog["written"]:
            raise ValueError("the catalog has categories that were not announced")
        total, valid = judged["total"], channels["valid"]
        schema = (
            "total bigint, valid bigint, failed bigint, filtered bigint, written bigint, success_rate double, duration_s double, "
            "by_category map<string,bigint>, by_overseas struct<cn:bigint,overseas:bigint>"
        )
        row = (
            total, valid, total - judged["alive"], judged["filtered"], catalog["written"], valid * 100.0 / total if total else 0.0,
            float(duration_s), by_category, (channels["cn"], channels["overseas"]),
        )
        return spark.createDataFrame([row], schema).select(F.lit(run_id).alias("run_id"), run_ts.alias("run_ts"), "*")


def catalog_summary(catalog: DataFrame, group: str = "category") -> DataFrame:
    """Channel lines and groups of a catalog."""
    per_group = catalog.groupBy(group).agg(F.count("*").alias("n"))
    return per_group.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_channels"), F.count("*").alias("n_groups"))


def feed_yield(docs: DataFrame, entries: DataFrame, key: str = "source_id") -> DataFrame:
    """Entries per feed, feeds without any included."""
    counts = entries.groupBy(key).agg(F.count("*").alias("n"))
    return docs.select(key).distinct().join(counts, key, "left").select(
        key, F.coalesce("n", F.lit(0)).alias("n_entries"), (F.coalesce("n", F.lit(0)) > 0).alias("ok")
    )


def yield_summary(per_feed: DataFrame) -> DataFrame:
    return per_feed.agg(
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("n_entries"), F.lit(0)).alias("extracted"),
    )


def run_delta(runs: DataFrame, order: str, measures: Sequence[str], keys: Sequence[str] = (), **scale) -> DataFrame:
    """Add ``d_<measure>``: difference to the previous run. ``order`` is an integer run position."""
    out = lag_in_order(runs, order, F.struct(*measures), "_prev", keys, **scale)
    return out.withColumns({f"d_{m}": F.col(m) - F.col(f"_prev.{m}") for m in measures}).drop("_prev")


def keep_last_runs(runs: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The newest ``n`` runs."""
    return runs.orderBy(*order).limit(n)
