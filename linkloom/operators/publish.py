"""Published forms of a catalog and the state tables kept between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions import urls
from linkloom.operators.matching import label_join
from linkloom.operators.runs import keep_last_runs
from linkloom.scale import lag_in_order
from linkloom.sources.statetables import StateTable

GENRE = ",#genre#"


def group_break_flag(catalog: DataFrame, group: str = "category", order: str = "line_no", **scale) -> DataFrame:
    """Add ``is_break``: the group differs from that of the previous row."""
    out = lag_in_order(catalog, order, F.col(group), "_prev", **scale)
    return out.withColumn("is_break", ~F.col(group).eqNullSafe(F.col("_prev"))).drop("_prev")


def catalog_rows(catalog: DataFrame, order: str = "line_no", **scale) -> DataFrame:
    """Lines of the grouped text, ordered by (``line_no``, ``part``): headers have part 0."""
    flagged = group_break_flag(catalog, "category", order, **scale)
    header = F.when(F.col("is_break"), F.concat("category", F.lit(GENRE)))
    return _parts(flagged, order, [header, F.concat_ws(",", "name", "url")])


def m3u_rows(
    catalog: DataFrame, labels: DataFrame | None = None, order: str = "line_no", compat: bool = False, **scale
) -> DataFrame:
    """Lines of the M3U text, ordered by (``line_no``, ``part``), without the file header.

    ``compat`` reproduces a known fault of published files: group titles lose their last
    character and are not translated.
    """
    if compat:
        titled = catalog.withColumn("label", F.expr("substring(category, 1, length(category) - 1)"))
    elif labels is not None:
        titled = label_join(catalog, labels)
    else:
        table = F.create_map(*[F.lit(x) for kv in rules.CATEGORY_LABELS.items() for x in kv])
        titled = catalog.withColumn("label", F.coalesce(F.try_element_at(table, F.col("category")), "category"))
    flagged = group_break_flag(titled, "label", order, **scale)
    header = F.when(F.col("is_break"), F.concat(F.lit("#EXTGRP:"), "label"))
    info = F.concat(F.lit('#EXTINF:-1 group-title="'), "label", F.lit('",'), "name")
    return _parts(flagged, order, [header, info, F.col("url")])


def _parts(df: DataFrame, order: str, texts: Sequence[Column]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).cast("bigint").alias("part"), t.alias("text")) for i, t in enumerate(texts)])
    return df.select(F.col(order).alias("line_no"), F.inline(F.filter(parts, lambda p: p["text"].isNotNull())))


def write_lines(rows: DataFrame, path: str, head: Sequence[str] = ()) -> None:
    """Write ordered text lines; part files sort in line order."""
    text = rows.select("line_no", "part", "text")
    if head:
        first = rows.sparkSession.range(1).select(
            F.lit(-1).cast("bigint").alias("line_no"), F.posexplode(F.array(*[F.lit(h) for h in head])).alias("part", "text")
        )
        text = first.withColumn("part", F.col("part").cast("bigint")).unionByName(text)
    text.orderBy("line_no", "part").select("text").write.mode("overwrite").text(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    write_lines(catalog_rows(catalog), path)


def write_catalog_table(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").partitionBy("category").parquet(path)


def write_m3u(catalog: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    write_lines(m3u_rows(catalog, labels), path, head=["#EXTM3U", ""])


def failed_rows(failed: DataFrame) -> DataFrame:
    """Archive lines of failed links."""
    return failed.select(F.concat_ws(",", "name", "url").alias("line"))


def write_failed(failed: DataFrame, path: str) -> None:
    failed_rows(failed).write.mode("overwrite").text(path)


def sanitize_lines(lines: DataFrame, sensitive: Sequence[str] = tuple(rules.SENSITIVE_PARAMS)) -> DataFrame:
    """Strip sensitive parameters from the url of ``name,url`` lines; other lines stay as they are."""
    line = F.col("line")
    is_channel = ~F.contains(line, F.lit(GENRE)) & F.contains(line, F.lit(","))
    url = F.substr(line, F.instr(line, ",") + F.lit(1))
    cleaned = F.concat(F.substring_index(line, ",", 1), F.lit(","), urls.sanitize(url, sensitive))
    return lines.withColumn("line", F.when(is_channel, cleaned).otherwise(line))


def sanitize_catalog(catalog: DataFrame, sensitive: Sequence[str] = tuple(rules.SENSITIVE_PARAMS)) -> DataFrame:
    return catalog.withColumn("url", urls.sanitize(F.col("url"), sensitive))


def updated_cache(valid: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = 6) -> DataFrame:
    """Validation times after a run: the links given are stamped ``now``, expired ones dropped.

    Give the links that evidence of this run proved, not those kept because they were proved before.
    """
    stamped = valid.select("fp", now.alias("validated_at"))
    merged = cache.select("fp", "validated_at").unionByName(stamped)
    newest = merged.groupBy("fp").agg(F.max("validated_at").alias("validated_at"))
    return newest.filter(F.col("validated_at") >= now - F.make_dt_interval(secs=F.lit(ttl_hours * 3600)))


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def state_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a state table, oldest first; empty tables count."""
    store, where = _folder(spark, path)
    if not store.exists(where):
        return []
    found = []
    for entry in store.listStatus(where):
        name = entry.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("version=") and store.exists(done):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def write_state(df: DataFrame, path: str, version: int, keep: int = 3) -> None:
    """Write the next version of a state table beside the older ones, of which the last ``keep`` stay in all.

    A table cannot be overwritten while it is being read; a version becomes visible only when
    its job commits, so a lost run leaves the previous state in place.
    """
    df.write.mode("overwrite").parquet(f"{path}/version={version:020d}")
    spark = df.sparkSession
    store, _ = _folder(spark, path)
    for old in state_versions(spark, path)[:-keep]:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old:020d}"), True)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest committed version of a state table; other versions are not read."""
    versions = state_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no committed version below {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]:020d}")


def cache_table(spark: SparkSession, path: str, parts: int = 64) -> StateTable:
    """Validation times by fingerprint, changed part by part: for caches too large to rewrite."""
    return StateTable(spark, path, "fp", "fp string, validated_at timestamp", parts)


def feed_table(spark: SparkSession, path: str, parts: int = 64) -> StateTable:
    """The last good scan of every feed, changed part by part."""
    return StateTable(spark, path, "url", "url string, scan_no long, hash string, etag string", parts)


def stamp(cache: StateTable, valid: DataFrame, now: Column, ttl_hours: float = 6, job: str = "", number: int | None = None) -> int:
    """Bring the links of ``valid`` into a cache as validated ``now``; the parts written lose their expired stamps.

    Returns the version. A ``number`` that ``job`` has committed before changes nothing.
    """
    def resolve(old: DataFrame, changes: DataFrame) -> DataFrame:
        merged = old.unionByName(changes).groupBy("fp").agg(F.max("validated_at").alias("validated_at"))
        return merged.filter(F.col("validated_at") >= now - F.make_dt_interval(secs=F.lit(ttl_hours * 3600)))

    return cache.upsert(valid.select("fp", now.alias("validated_at")), resolve, job, number)


def write_feed_scan(state: StateTable, scan: DataFrame, job: str = "", number: int | None = None) -> int:
    """Bring the good scans (``url``, ``scan_no``, ``hash``, ``etag``) of a run into the state; failed ones leave it alone."""
    def resolve(old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.unionByName(changes.select(*old.columns))
        return both.groupBy(F.col("url").alias("_url")).agg(F.max_by(F.struct(*old.columns), F.struct("scan_no", "hash")).alias("_s")).select("_s.*")

    return state.upsert(scan.filter("hash is not null"), resolve, job, number)


def append_run_stats(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def read_last_runs(spark: SparkSession, path: str, n: int, order: str = "run_ts") -> DataFrame:
    """History as kept: the newest ``n`` runs."""
    return keep_last_runs(spark.read.parquet(path), [F.desc(order)], n)


def write_feed_state(state: DataFrame, path: str, version: int) -> None:
    write_state(state, path, version)


def write_feed_changes(changes: DataFrame, path: str) -> None:
    changes.write.mode("overwrite").json(path)
