"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "curate_catalog", "admit_reasons", "admitted_entries", "reject_summary", "union_priority", "candidate_limit",
    "topk_per_name", "global_cap", "full_order", "fallback_fill", "quota_alloc", "enforced_quota",
    "split_catalog_lines", "m3u_pending_name", "m3u_adjacent", "m3u_docs_pending", "group_forward_fill", "m3u_rows",
    "name_normalize", "name_display", "keyword_classify", "classify_by_table",
    "playlist_url_filter", "private_hosts", "private_blocks_join", "url_sanitize",
    "page_links", "line_urls", "frontier_depth1", "merge_discovered", "mirror_first_success",
    "probe_alive", "probe_legacy", "link_revalidate", "running_valid_rate", "cache_upsert", "feed_compare",
    "stream_dedup_ttl", "stream_feed_changes", "stream_admit",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    from linkloom.queries import QUERIES

    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/part.parquet").count()
    times = {}
    for name in wanted:
        start = time.time()
        # The noop sink runs the whole plan without moving rows to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
