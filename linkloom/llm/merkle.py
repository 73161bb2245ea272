"""Merkle dataset manifest: a persistent tree over the rows of each source, and over the sources.

Rows are leaves, in order of their ids within their source. Every ``FAN`` consecutive nodes have a parent, until one is left,
the source's subroot; the subroots make the dataset's root in the same way. Leaves are dealt in aligned blocks of
FAN ** levels, so a block's nodes are built in one task; the levels above have one row per run of nodes and are joined.
A tampered leaf makes a version of the tree that shares all nodes but its ancestors: these are copied inside the leaf's block,
and the copy goes on along the block's path through the upper levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import _arrow_schema, saved
from linkloom.scale import rank_by

FAN = 16
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def parents(nodes: Sequence[str], fan: int) -> list[str]:
    return [digest(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]


def block_levels(leaves: Sequence[str], fan: int, levels: int, alone: bool) -> list[list[str]]:
    """The levels of a block, leaves first. A block that is ``alone`` in its source ends at its first single node; one of several
    always has ``levels`` levels above its leaves."""
    out = [list(leaves)]
    while len(out[-1]) > 1 if alone else len(out) <= levels:
        out.append(parents(out[-1], fan))
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
    """Rows of consecutive equal (g, block), as column lists; a group is one block, so bounded."""
    key, held = None, {}
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(columns["g"], columns["block"]))
        start = 0
        while start < len(keys):
            end = start + 1
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if keys[start] != key:
                if key is not None:
                    yield key, held
                key, held = keys[start], {c: [] for c in columns}
            for c, values in columns.items():
                held[c] += values[start:end]
            start = end
    if key is not None:
        yield key, held


def _per_block(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work`` turns the rows of one block, in order of ``pos``, into output columns."""
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches):
        for key, block in _grouped(batches):
            yield pa.RecordBatch.from_pydict(work(key, block), schema=arrow)

    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(run, schema)


def _placed(docs: DataFrame, columns: Sequence[str], id_col: str, group_col: str, text_col: str, tampered: Column, fan: int, levels: int) -> DataFrame:
    """(g, block, pos, n, id, leaf, changed) of every row; ``changed`` is the tampered row's leaf, NULL where nothing is tampered."""
    lowered = F.translate(F.col(text_col), _UPPER, _LOWER)
    leaves = saved(docs.select(
        # NULL comes first, before the empty string.
        F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit("")).alias("g"),
        F.col(id_col).alias("id"), leaf(*[F.col(c) for c in columns]).alias("leaf"),
        F.when(tampered, leaf(*[lowered if c == text_col else F.col(c) for c in columns])).alias("changed"),
    ), "merkle")
    ranked = rank_by(leaves, [F.col("g"), F.col("id").asc_nulls_first(), F.col("leaf")], "at")
    first = ranked.groupBy("g").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumnRenamed("g", "_g")
    pos = F.col("at") - F.col("first")
    return ranked.join(first, F.col("g") == F.col("_g")).select(
        "g", F.floor(pos / fan**levels).alias("block"), pos.alias("pos"), "n", "id", "leaf", "changed"
    )


def _ascend(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """Build the levels above ``nodes`` (g, i, h, m: m nodes of g): the runs of each level, and the root (g, h) of every g."""
    now, runs, tops = nodes, [], [nodes.filter("m = 1")]
    while not now.filter("m > 1").isEmpty():
        run = saved(
            now.filter("m > 1").groupBy("g", F.floor(F.col("i") / fan).alias("i"), F.ceil(F.col("m") / fan).alias("m"))
            .agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("kids"))  # at most ``fan``
            .withColumn("h", F.sha2(F.array_join(F.transform("kids", lambda k: k["h"]), ""), 256)), "merkle",
        )
        runs.append(run)
        now = run.select("g", "i", "h", "m")
        tops.append(now.filter("m = 1"))
    return runs, reduce(DataFrame.union, [t.select("g", "h") for t in tops])


_PATH = "array<struct<l:string,r:string>>"


def _paths(nodes: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """(g, i, path) of every node: what stands left and right of it among its siblings, then of its ancestors among theirs."""
    none = F.expr(f"cast(array() as {_PATH})")
    above = None
    for run in reversed(runs):
        if above is None:
            parent = run.withColumn("path", none)
        else:
            up = above.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("path"))
            parent = run.join(up, (F.col("g") == F.col("_g")) & (F.col("i") == F.col("_i")), "left").withColumn("path", F.coalesce("path", none))
        all_h = F.transform("kids", lambda k: k["h"])
        kids = parent.select("g", "path", all_h.alias("hs"), F.posexplode("kids"))
        sides = F.struct(
            F.array_join(F.slice("hs", F.lit(1), F.col("pos")), "").alias("l"),
            F.array_join(F.slice("hs", F.col("pos") + 2, F.size("hs")), "").alias("r"),
        )
        above = kids.select("g", F.col("col.i").alias("i"), F.concat(F.array(sides), F.col("path")).alias("path"))
    single = nodes.filter("m = 1").select("g", "i", none.alias("path"))
    return single if above is None else single.union(above)


def every_fifth(id_column: Column) -> Column:
    """Where 5 divides the crc32 of the decimal id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5)) == 0


def manifest(
    docs: DataFrame, tampered: Column | None = None, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source",
    text_col: str = "text", fan: int = FAN, levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified, copied) of every row.

    The leaf hashes ``columns``. ``tampered`` tells the rows whose text had its A-Z lower-cased; each makes a version of the
    tree, whose root is ``folded_root`` (that of the others is the root folded from their own leaf). ``copied`` are the nodes
    that the version has of its own in its block, leaf first: level, position in the source, hash. ``proof_sha256`` hashes
    the siblings on the way from the leaf to the root, level by level, left to right.

    Rows with a NULL id come first in their source and are never tampered; NULL sources are one source, the first. NULL columns
    and empty texts are different leaves. Rows that repeat an id are leaves each, in order of their hashes, so equal rows
    are interchangeable. An empty table has no rows here. Other columns are not read.
    """
    tampered = every_fifth(F.col(id_col)) if tampered is None else tampered
    kind = docs.schema[id_col].dataType.simpleString()
    rows = saved(_placed(docs, columns, id_col, group_col, text_col, tampered, fan, levels), "merkle")
    size = fan**levels

    def top(key, block):
        built = block_levels(block["leaf"], fan, levels, block["n"][0] <= size)
        return {"g": [key[0]], "i": [key[1]], "h": [built[-1][0]], "m": [-(-block["n"][0] // size)]}

    blocks = saved(_per_block(rows.select("g", "block", "pos", "n", "leaf"), "g string, i bigint, h string, m bigint", top), "merkle")
    runs, subroots = _ascend(blocks, fan)
    # Sources in order, as nodes of one tree.
    ordered = saved(rank_by(subroots, [F.col("g")], "at"), "merkle")
    sources = ordered.select(F.lit("").alias("g"), (F.col("at") - 1).alias("i"), "h", F.lit(ordered.count()).cast("bigint").alias("m"))
    source_runs, root = _ascend(sources, fan)
    over = _paths(sources, source_runs).select((F.col("i") + 1).alias("_at"), F.col("path").alias("over"))
    found = root.first()  # one row, or none of an empty table
    per_source = ordered.join(over, F.col("at") == F.col("_at")).select(
        F.col("g").alias("_g"), F.col("h").alias("subroot"), F.lit(found["h"] if found else None).cast("string").alias("root"), "over"
    )
    heads = _paths(blocks, runs).join(per_source, F.col("g") == F.col("_g")).select(
        "g", F.col("i").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "subroot", "root", F.concat("path", "over").alias("path")
    )

    def prove(key, block):
        path, subroot, root = block["path"][0], block["subroot"][0], block["root"][0]
        n, leaves, changed = block["n"][1], block["leaf"][1:], block["changed"][1:]
        built = block_levels(leaves, fan, levels, n <= size)
        upper = "".join(s["l"] + s["r"] for s in path)
        shared: dict[int, str] = {}  # siblings above the leaves, by the leaf's parent
        out = {c: [] for c in ("proof_sha256", "folded_root", "verified", "copied")}
        for k, (own, new) in enumerate(zip(leaves, changed)):
            if k // fan not in shared:
                sides, at = [], k // fan
                for level in built[1:-1]:
                    lo = at - at % fan
                    sides += level[lo:at] + level[at + 1:lo + fan]
                    at //= fan
                shared[k // fan] = "".join(sides) + upper
            lo = k - k % fan
            siblings = leaves[lo:k] + leaves[k + 1:lo + fan] if len(built) > 1 else []
            out["proof_sha256"].append(digest(*siblings, shared[k // fan]))
            node, at, copies = new or own, k, []
            for level in range(len(built)):
                if level:
                    kids, lo = built[level - 1], at - at % fan
                    node, at = digest(*kids[lo:at], node, *kids[at + 1:lo + fan]), at // fan
                if new is not None:
                    copies.append({"level": level, "i": key[1] * fan ** max(levels - level, 0) + at, "hash": node})
            for s in path:
                node = digest(s["l"], node, s["r"])
            out["folded_root"].append(node)
            out["verified"].append(node == root)
            out["copied"].append(copies if new is not None else None)
        return {"id": block["id"][1:], "leaf": leaves, "subroot": [subroot] * len(leaves), "root": [root] * len(leaves), **out}

    # A block's path travels with its rows, as the first of them.
    both = heads.unionByName(rows, allowMissingColumns=True)
    return _per_block(
        both, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
        "copied array<struct<level:int,i:bigint,hash:string>>", prove,
    ).withColumnRenamed("id", id_col)
