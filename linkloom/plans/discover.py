"""Discovery run: from seed feeds and fetched documents to named entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import discovery
from linkloom.scale import materialize


def discover(seeds: DataFrame, docs: DataFrame, cap: int | None = None, **domains) -> DataFrame:
    """Entries (``name``, ``url``, ``domain``) for every link the seeds lead to.

    ``seeds`` has ``url`` and ``seed_rank``. ``docs`` has ``url``, ``status`` and ``content`` of
    everything fetched; mirrors of a seed stand in when the seed itself failed. ``domains`` may hold ``allow`` and ``deny``. The
    result is a source for ``curate``, of lowest priority where it comes last.
    """
    tried = discovery.expand_mirrors(seeds.select("url"))
    reached = discovery.first_success(tried, docs)
    named = seeds.withColumn("domain", discovery.base_domain(F.col("url"))).join(reached, "url")
    # A row per seed, read several times below.
    opened = materialize(named.select(F.col("candidate").alias("url"), "seed_rank", "domain"))
    good = discovery.filter_antibot(docs.filter("status = 200"))
    found = discovery.name_discovered(discovery.expand_frontier(opened, good, cap, **domains))
    return found.select("name", F.col("link").alias("url"), "domain")
