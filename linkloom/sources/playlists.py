"""Playlist ingestion.

Two inputs are supported. ``ingest_playlists`` takes whole documents, where every rule looks
only at neighbouring lines of the same cell, so parsing is a map-only step without a shuffle.
``parse_lines`` takes a table of lines and follows the order of ``line_no`` with blocked windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions.text import after_comma, before_comma, has_comma, let, lines, strip
from linkloom.functions.urls import netloc
from linkloom.scale import fill_in_order, lag_in_order

MODES = ("pending", "adjacent", "legacy")


def _is_info(line: Column) -> Column:
    return line.startswith("#EXTINF:")


def _is_url(line: Column, mode: str) -> Column:
    return line.startswith("http") if mode == "legacy" else line.rlike("^https?://")


def _tvg_name(line: Column) -> Column:
    quoted = r'tvg-name="([^"]*)"'
    return F.when(line.rlike(quoted), F.regexp_extract(line, quoted, 1))


def _after_last_comma(line: Column) -> Column:
    return F.when(line.rlike(r",[^,]+$"), strip(F.regexp_extract(line, r",([^,]+)$", 1)))


def _info_name(line: Column, mode: str) -> Column:
    """Name announced by an info line; NULL when it announces none."""
    if mode == "pending":
        return _after_last_comma(line)
    if mode == "legacy":
        return F.coalesce(_tvg_name(line), _after_last_comma(line))
    first = F.when(has_comma(line), strip(after_comma(line))).otherwise(rules.UNKNOWN_NAME)
    return F.coalesce(_tvg_name(line), first)


def _pair_name(line: Column) -> Column:
    return before_comma(line)


def _is_pair(line: Column, mode: str) -> Column:
    """A ``name,http...`` line; the plain mode drops group headers."""
    pair = has_comma(line) & ~line.startswith("#") & strip(after_comma(line)).startswith("http")
    return pair & ~line.endswith(",#genre#") if mode == "pending" else pair


def _event(line: Column, mode: str) -> Column:
    """What a line means to the pending-name rule; NULL for lines that do not matter."""

    def event(kind, name, url):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), url.alias("url"))

    none = F.lit(None).cast("string")
    out = F.when(_is_info(line) & _info_name(line, mode).isNotNull(), event("info", _info_name(line, mode), none))
    out = out.when(_is_url(line, mode), event("url", none, line))
    if mode == "legacy":
        # A pair with any second part overwrites the pending name, even when it yields no entry.
        overwrite = has_comma(line) & ~line.startswith("#")
        out = out.when(_is_pair(line, mode), event("pair", _pair_name(line), strip(after_comma(line))))
        return out.when(overwrite, event("info", _pair_name(line), none))
    return out.when(_is_pair(line, mode), event("pair", _pair_name(line), strip(after_comma(line))))


def _emit_name(event: Column, prev: Column, mode: str) -> Column:
    """Name of an emitted url event, given the previous name-changing event."""
    carries = prev["kind"].isin("info", "pair") if mode == "legacy" else prev["kind"] == "info"
    pending = F.when(carries & (prev["name"] != ""), prev["name"])
    fallback = F.lit(rules.UNKNOWN_NAME) if mode == "legacy" else netloc(event["url"])
    return F.when(event["kind"] == "pair", event["name"]).otherwise(F.coalesce(pending, fallback))


def group_title(line: Column) -> Column:
    return F.regexp_extract(line, r'group-title="([^"]*)"', 1)


def parse_lines(
    raw: DataFrame, mode: str = "pending", keys: Sequence[str] = ("source_id",), order: str = "line_no", **scale
) -> DataFrame:
    """Entries (``keys``, ``order``, ``name``, ``url``) of a table of playlist lines."""
    if mode == "adjacent":
        return _parse_lines_adjacent(raw, keys, order, **scale)
    event = let(strip(F.col("line")), lambda line: _event(line, mode))
    rows = raw.select(*keys, order, event.alias("event")).filter("event IS NOT NULL")
    # Pairs leave the pending name alone in the pending mode, so they are looked through.
    event = F.col("event")
    change = event if mode == "legacy" else F.when(event["kind"] != "pair", event)
    linked = fill_in_order(rows, order, change, "prev", keys, exclusive=True, **scale)
    return linked.filter("event.url IS NOT NULL").select(
        *keys, order, _emit_name(event, F.col("prev"), mode).alias("name"), event["url"].alias("url")
    )


def _parse_lines_adjacent(raw: DataFrame, keys, order, **scale) -> DataFrame:
    """The URL must be the next physical line, which is always consumed.

    In a run of info lines every second one is consumed by its predecessor, so the line after
    the run belongs to the last info line exactly when the run length is odd. ``order`` must be
    the physical line number, counted from 0.
    """
    rows = raw.withColumn("line", strip(F.col("line"))).select(*keys, order, "line")
    seen = lag_in_order(rows, order, F.col("line"), "before", keys, **scale)
    others = seen.filter(~_is_info(F.col("line")))
    others = lag_in_order(others, order, F.col(order), "prev_other", keys, **scale)
    run = F.col(order) - F.coalesce("prev_other", F.lit(-1)) - 1
    return _emit_adjacent(others.withColumn("odd", run % 2 == 1), [*keys, order])


def _emit_adjacent(df: DataFrame, out: Sequence[str]) -> DataFrame:
    line = F.col("line")
    name = F.when(F.col("odd"), _info_name(F.col("before"), "adjacent")).otherwise(_pair_name(line))
    url = F.when(F.col("odd"), line).otherwise(strip(after_comma(line)))
    usable = (line != "") & ~line.startswith("#") & (F.col("odd") | has_comma(line))
    return df.filter(usable).select(*out, name.alias("name"), url.alias("url"))


def ingest_playlists(docs: DataFrame, mode: str = "pending", keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Entries of whole playlist documents (``content``), parsed cell by cell without a shuffle."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "adjacent":
        return _ingest_adjacent(docs, keys)
    # Lines that cannot matter are dropped before anything is computed for them.
    marks = "#EXTINF:|http" if mode == "pending" else "#EXTINF:|http|,"
    numbered = F.transform(lines(F.col("content")), lambda x, i: F.struct(i.cast("bigint").alias("line_no"), x.alias("line")))
    numbered = F.filter(numbered, lambda e: e["line"].rlike(marks))
    numbered = F.transform(
        numbered,
        lambda e: F.struct(e["line_no"].alias("line_no"), let(strip(e["line"]), lambda y: _event(y, mode)).alias("event")),
    )
    events = F.filter(numbered, lambda e: e["event"].isNotNull())

    def link(arr):
        return F.transform(
            arr,
            lambda e, i: F.struct(
                e["line_no"].alias("line_no"), e["event"].alias("event"),
                F.when(i > 0, F.get(arr, i - 1)["event"]).alias("prev"),
            ),
        )

    def emitted(arr):
        # Pairs leave the pending name alone in the pending mode, so they are linked apart.
        if mode == "legacy":
            return link(arr)
        is_pair = lambda e: e["event"]["kind"] == "pair"
        return F.concat(let(F.filter(arr, lambda e: ~is_pair(e)), link), link(F.filter(arr, is_pair)))

    linked = F.filter(let(events, emitted), lambda e: e["event"]["url"].isNotNull())
    rows = docs.select(*keys, F.explode(linked).alias("e")).select(*keys, "e.*")
    return rows.select(
        *keys, "line_no",
        _emit_name(F.col("event"), F.col("prev"), mode).alias("name"),
        F.col("event.url").alias("url"),
    )


def _ingest_adjacent(docs: DataFrame, keys) -> DataFrame:
    def number(ls):
        return F.transform(
            ls,
            lambda x, i: F.struct(
                i.cast("bigint").alias("line_no"), x.alias("line"), F.when(i > 0, F.get(ls, i - 1)).alias("before")
            ),
        )

    def runs(others):
        return F.transform(
            others,
            lambda e, i: F.struct(
                e["line_no"].alias("line_no"), e["line"].alias("line"), e["before"].alias("before"),
                ((e["line_no"] - F.coalesce(F.when(i > 0, F.get(others, i - 1)["line_no"]), F.lit(-1)) - 1) % 2 == 1)
                .alias("odd"),
            ),
        )

    trimmed = F.transform(lines(strip(F.col("content"))), strip)
    others = F.filter(let(trimmed, number), lambda e: ~_is_info(e["line"]))
    rows = docs.select(*keys, F.explode(let(others, runs)).alias("e")).select(*keys, "e.*")
    return _emit_adjacent(rows, [*keys, "line_no"])


def sniff_format(docs: DataFrame, min_chars: int = 100, head_lines: int = 10) -> DataFrame:
    """Drop documents of at most ``min_chars`` characters and tell playlists from plain text."""
    head = F.slice(lines(F.col("content")), 1, head_lines)
    return docs.filter(F.length("content") > min_chars).withColumn(
        "is_m3u", F.exists(head, lambda x: x.startswith("#EXTM3U"))
    )
