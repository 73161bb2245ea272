"""Quotation linking: reply-ordered conversations from messages that quote each other.

Lines are parsed into quote levels by their leading marks. Runs of lines of one level make passages; the hash of a quoted
passage, its white space and case evened out, is joined to the earliest message that wrote the passage itself. The
lowest quoted level that finds an earlier message gives the reply's parent; parents make threads.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import map_rows, saved
from linkloom.scale import rank_in_order

_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
_INTRODUCES = re.compile(r".*\b(?:wrote|writes|said|escribió|schrieb|a écrit)\s*:\s*$", re.IGNORECASE)


def levels(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without marks) of each line. The line that introduces a quotation counts with it, as an empty one."""
    out = []
    for line in (text or "").splitlines():
        m = _MARKS.match(line)
        out.append((m.group(1).count(">"), line[m.end():]) if m else (0, line))
    for i in range(len(out) - 1):
        if out[i + 1][0] > out[i][0] and _INTRODUCES.match(out[i][1]):
            out[i] = (out[i + 1][0], "")
    return out


def passages(text: str | None) -> list[tuple[int, str]]:
    """(level, passage) in order: runs of lines of one level, parted by blank lines."""
    out: list[tuple[int, list[str]]] = []
    open_level = None
    for level, line in levels(text):
        if not line.strip():
            open_level = None
        elif level == open_level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
            open_level = level
    return [(level, "\n".join(lines)) for level, lines in out]


def normal(passage: str) -> str:
    return " ".join(passage.lower().split())


def digest(passage: str) -> bytes:
    return hashlib.md5(normal(passage).encode("utf-8", "replace"), usedforsecurity=False).digest()


def own_text(text: str | None) -> str:
    """A message without its quotations: passages of level 0, parted by blank lines."""
    return "\n\n".join(p for level, p in passages(text) if level == 0)


def parsed(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, hashes array<struct<level, hash, size>>) of each message."""
    def work(batches):
        for b in batches:
            out = {"id": b["id"], "own": [], "hashes": []}
            for text in b["text"]:
                found = passages(text)
                out["own"].append("\n\n".join(p for level, p in found if level == 0))
                out["hashes"].append([{"level": level, "hash": digest(p), "size": len(p)} for level, p in found])
            yield out

    rows = messages.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, "id bigint, own string, hashes array<struct<level:int,hash:binary,size:int>>", work)


def link(messages: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """(id, own, parent_id, thread_id, depth, position) of each message; ids grow with time.

    A message replies to the earliest message that wrote what it quotes: of the originals of its lowest quoted level that
    precede it, the one with most quoted characters, ties to the smallest id. A thread is named by its first message; ``depth``
    counts the replies above, ``position`` orders the thread so that replies follow what they answer. Messages
    without quotations, with quotations nobody wrote earlier, and NULL or empty texts start threads. Rows that repeat an
    id are kept, with what any of them quotes; NULL ids are kept, linked to nothing, each with NULL thread and position. Other columns are not read.
    """
    parts = saved(parsed(messages, id_col, text_col), "quotes")
    each = parts.filter("id is not null").select("id", F.explode("hashes").alias("p")).select("id", "p.level", "p.hash", "p.size")
    originals = each.filter("level = 0").groupBy("hash").agg(F.min("id").alias("original"))
    quoted = each.filter("level > 0").groupBy("id", "level", "hash").agg(F.sum("size").alias("size"))
    found = quoted.join(originals, "hash").filter("original < id")
    best = Window.partitionBy("id").orderBy("level", F.desc("size"), "original")
    parents = saved(
        found.groupBy("id", "level", "original").agg(F.sum("size").alias("size"))
        .withColumn("place", F.row_number().over(best)).filter("place = 1").select("id", F.col("original").alias("parent_id")), "quotes",
    )
    nodes = (
        parts.filter("id is not null").select("id").distinct()
        .join(parents, "id", "left").join(_roots(parents), "id", "left")
        .select("id", "parent_id", F.coalesce("root", "id").alias("thread_id"), F.coalesce("depth", F.lit(0)).alias("depth"))
    )
    placed = rank_in_order(nodes, "id", "position", ["thread_id"], block=1 << 14)
    out = parts.select("id", "own").join(placed.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id")
    return out.select(F.col("id").alias(id_col), "own", "parent_id", "thread_id", "depth", "position")


def _roots(parents: DataFrame) -> DataFrame:
    """(id, root, depth) of every message with a parent, by doubling: rounds grow with the logarithm of the depth."""
    now = parents.select("id", F.col("parent_id").alias("root"), F.lit(1).alias("depth"), F.lit(True).alias("open"))
    while True:
        above = now.select(F.col("id").alias("_at"), F.col("root").alias("next"), F.col("depth").alias("more"))
        # Messages without a parent have no row: what hangs on one is settled.
        settled = now.filter(~F.col("open"))
        joined = now.filter("open").join(above, F.col("root") == F.col("_at"), "left")
        moved = joined.select(
            "id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("open"),
        )
        now = saved(settled.unionByName(moved), "quotes")
        if now.filter("open").isEmpty():
            return now.select("id", "root", "depth")
