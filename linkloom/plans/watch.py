"""Monitor run: from two scans to changes and the next state."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from linkloom.operators import monitoring
from linkloom.sources.rulesets import feed_list


class Watch(NamedTuple):
    changes: DataFrame
    summary: DataFrame
    state: DataFrame


def watch(feeds: DataFrame, state: DataFrame, scan: DataFrame) -> Watch:
    """Compare a scan (``url``, ``content``, ``etag``) of the listed feeds with the kept state."""
    listed = feed_list(feeds)
    fetched = monitoring.content_hash(scan).join(listed.select("url"), "url", "left_semi")
    compared = monitoring.compare_feeds(state.join(listed.select("url"), "url", "left_semi"), fetched)
    return Watch(
        monitoring.feed_changes(compared, listed),
        monitoring.change_summary(compared),
        monitoring.next_state(compared),
    )
