"""Embedding near-duplicates by product quantisation.

Unit vectors are put into coarse inverted lists; the residual to the list's centre is coded per subspace. A vector
probes the lists that a vector at the threshold's distance may lie in, compares itself with their codes by table
look-ups, and drops a stored vector only where the looked-up distance exceeds the threshold by more than that vector's own
coding error, which is kept beside the code. The exact cosine decides for the others.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import fraction_hash, map_rows, saved
from linkloom.llm.graph import components
from linkloom.llm.topk import usable

#: Vectors that the index is fitted on, at most about; every vector is indexed.
SAMPLE = 16_384
MOST_LISTS = 1024
LIST_ROWS = 256
CODES = 256
SUBSPACE = 4
BLOCK = 2048
MOST_DIMENSIONS = 64
#: Vectors of the sample that are compared with all rows to learn how far real neighbours lie from each other's lists.
TRIALS = 2048
#: Trial pairs have at most this much more than the threshold cosine; their distances are counted in steps of 1 / STEPS.
BAND = 0.02
STEPS = 2000


@dataclass(frozen=True)
class Index:
    centres: np.ndarray  # lists x dimensions
    books: tuple[np.ndarray, ...]  # per subspace: codes x its dimensions
    margin: float  # how much farther (squared) than the nearest centre a probed one may be

    @property
    def cuts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.centres.shape[1]), len(self.books))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return _squared(x, self.centres)

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its code stands for."""
        rest = x - self.centres[lists]
        codes, error = [], np.zeros(len(x))
        for cut, book in zip(self.cuts, self.books):
            d = _squared(rest[:, cut], book)
            best = d.argmin(1)
            codes.append(best.astype(np.uint8))
            error += d[np.arange(len(x)), best]
        return np.stack(codes, 1), np.sqrt(np.maximum(error, 0))

    def looked_up(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded vectors of one list: a sum of one table entry per subspace."""
        rest = q - self.centres[which]
        out = np.zeros((len(q), len(codes)), np.float32)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            out += _squared(rest[:, cut], book).astype(np.float32)[:, codes[:, m]]
        return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _centres(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; empty clusters keep their centre."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(steps):
        near = _squared(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, n_lists: int, cosine: float, miss: float = 1e-3, seed: int = 0) -> Index:
    """Fit on unit vectors. The least margin of the probes comes from partners of the sample's vectors at exactly the
    threshold cosine, in random directions; all but ``miss`` of these pairs must be found by either end. ``widened`` adds real
    neighbours."""
    rng = np.random.default_rng(seed)
    centres = _centres(sample, n_lists, 8, rng)
    near = _squared(sample, centres).argmin(1)
    rest = sample - centres[near]
    some = rest[rng.permutation(len(rest))[: 4 * 2048]]
    cuts = np.array_split(np.arange(sample.shape[1]), max(1, sample.shape[1] // SUBSPACE))
    books = tuple(_centres(some[:, c], CODES, 5, rng) for c in cuts)
    q = sample[rng.permutation(len(sample))[:4096]]
    side = rng.standard_normal(q.shape)
    side -= (side * q).sum(1, keepdims=True) * q
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    partner = cosine * q + np.sqrt(1 - cosine**2) * side
    at = np.arange(len(q))
    d, e = _squared(q, centres), _squared(partner, centres)
    # Either end may find the other, as in ``widened``.
    beyond = np.minimum(d[at, e.argmin(1)] - d.min(1), e[at, d.argmin(1)] - e.min(1))
    return Index(centres, books, float(np.quantile(beyond, 1 - miss)) + 1e-6)


def widened(index: Index, rows: DataFrame, trials: np.ndarray, cosine: float, miss: float) -> Index:
    """The margin is raised until all but ``miss`` of the pairs of a trial vector and a row, with a cosine from the threshold to
    ``BAND`` above it, are found by either end. Pairs are counted by their distance, in a table of fixed size."""
    shared = rows.sparkSession.sparkContext.broadcast((index, trials))

    def work(batches):
        ix, q = shared.value
        dq = ix.distances(q)
        home_q, near_q = dq.argmin(1), dq.min(1)
        counts = np.zeros(4 * STEPS + 2, np.int64)  # squared distances of unit vectors are at most 4
        for b in batches:
            if not b["v"]:
                continue
            x = _unit(b["v"])
            dx = ix.distances(x)
            home_x, near_x = dx.argmin(1), dx.min(1)
            cosines = q @ x.T
            i, j = np.nonzero((cosines >= cosine) & (cosines < cosine + BAND))
            beyond = np.minimum(dq[i, home_x[j]] - near_q[i], dx[j, home_q[i]] - near_x[j])
            counts += np.bincount(np.ceil(np.clip(beyond, 0, 4) * STEPS).astype(int), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield {"step": some.tolist(), "n": counts[some].tolist()}

    found = map_rows(rows.select("v"), "step int, n bigint", work).groupBy("step").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    if not found:
        return index
    steps = np.array(sorted((r["step"], r["n"]) for r in found))
    below = np.cumsum(steps[:, 1])
    enough = steps[np.searchsorted(below, (1 - miss) * below[-1]), 0] / STEPS
    return replace(index, margin=max(index.margin, float(enough) + 1e-6))


def _unit(values: list) -> np.ndarray:
    x = np.array(values, dtype=np.float64)
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # keeps squares of very large and very small components finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(index: Index, which: int, q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float):
    """Index pairs (query, stored) with at least the cosine."""
    reach = np.sqrt(2 - 2 * cosine) + error + 1e-4  # the table sums are single precision
    a, b = np.nonzero(index.looked_up(q, which, codes) <= (reach * reach)[None, :].astype(np.float32))
    keep_a, keep_b = [], []
    for i in range(0, len(a), 1 << 17):
        ia, ib = a[i:i + (1 << 17)], b[i:i + (1 << 17)]
        sure = np.einsum("ij,ij->i", q[ia], x[ib]) >= cosine
        keep_a.append(ia[sure])
        keep_b.append(ib[sure])
    none = np.zeros(0, int)
    return np.concatenate([none, *keep_a]), np.concatenate([none, *keep_b])


def near_duplicates(
    rows: DataFrame, cosine: float = 0.9, miss: float = 1e-3, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors link if their cosine is at least ``cosine``; a link is found by either end, and counts for both, unless each lies
    in a list beyond the other's probes (a share of about ``miss`` of the links near the threshold, as measured on pairs of
    ``TRIALS`` of the vectors with all others; less above it). Equal vectors are indexed
    once and counted each. NULL, empty and zero vectors, and those with NULL or non-finite components, link with nothing, as
    do vectors of different dimensions. Rows that repeat an id are vectors of their own and share its component; a NULL id
    has the component NULL unless its vector equals or links with others. Other columns are not read. More than
    ``MOST_DIMENSIONS`` different dimensions are refused.
    """
    spark = rows.sparkSession
    v = F.col(vector_col)
    live = usable(v) & F.exists(v, lambda x: x != 0)
    base = rows.select(
        F.col(id_col).alias("id"), F.when(live, F.xxhash64(v)).alias("h1"), F.when(live, F.xxhash64(F.lit(1), v)).alias("h2"),
        F.when(live, v).alias("v"),
    )
    distinct = saved(
        base.filter("h1 is not null").groupBy("h1", "h2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "pq",
    )
    found = [_one_dimension(distinct.filter(F.col("dim") == r["dim"]), r["dim"], r["n"], cosine, miss) for r in _dimensions(distinct)]
    counts, edges = spark.createDataFrame([], "h1 bigint, h2 bigint, linked bigint"), spark.createDataFrame([], "u bigint, v bigint")
    for c, e in found:
        counts, edges = counts.union(c), edges.union(e)
    linked = counts.groupBy("h1", "h2").agg(F.sum("linked").alias("linked"))
    classes = components(edges)
    per_vector = distinct.select("h1", "h2", "rep", "copies").join(linked, ["h1", "h2"], "left").join(
        classes, F.col("rep") == F.col("node"), "left"
    ).select(
        "h1", "h2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    out = base.select("id", "h1", "h2").join(per_vector, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _dimensions(distinct: DataFrame) -> list:
    dims = distinct.groupBy("dim").agg(F.count("*").alias("n")).limit(MOST_DIMENSIONS + 1).collect()
    if len(dims) > MOST_DIMENSIONS:
        raise ValueError("too many different dimensions")
    return sorted(dims)


def _one_dimension(distinct: DataFrame, dim: int, n: int, cosine: float, miss: float) -> tuple[DataFrame, DataFrame]:
    """Per distinct vector the number of rows linked in each block; and edges that connect what links."""
    spark = distinct.sparkSession
    picked = distinct.filter(fraction_hash(F.col("h2"), F.lit("sample")) * n < SAMPLE).select("h1", "v").toArrow().to_pydict()
    at = np.argsort(np.array(picked["h1"], np.int64), kind="stable")
    if not len(at):
        picked = distinct.limit(1).select("h1", "v").toArrow().to_pydict()
        at = np.zeros(len(picked["h1"]), int)
    sample = _unit([picked["v"][i] for i in at])
    index = fit(sample, int(np.clip(n // LIST_ROWS, 1, MOST_LISTS)), cosine, miss)
    trials = sample[np.random.default_rng(1).permutation(len(sample))[:TRIALS]]
    rows = distinct.select("h1", "h2", "rep", "copies", "v").repartition(spark.sparkContext.defaultParallelism * 2 if n < 1 << 20 else max(1, n >> 14))
    index = widened(index, rows, trials, cosine, miss)
    shared = spark.sparkContext.broadcast(index)  # at most MOST_LISTS centres and CODES codes

    def enter(batches):
        ix = shared.value
        for b in batches:
            if not b["v"]:
                continue
            x = _unit(b["v"])
            d = ix.distances(x)
            home = d.argmin(1)
            codes, error = ix.code(x, home)
            probed = [np.flatnonzero(r <= r[k] + ix.margin).tolist() for r, k in zip(d, home)]
            yield {
                **{c: b[c] for c in ("h1", "h2", "rep", "copies")}, "home": home.tolist(), "near": d.min(1).tolist(), "probes": probed,
                "x": [r.tobytes() for r in x], "code": [c.tobytes() for c in codes], "error": error.tolist(),
            }

    entered = saved(map_rows(
        rows,
        "h1 bigint, h2 bigint, rep bigint, copies bigint, home int, near double, probes array<int>, x binary, code binary, error double", enter,
    ), "pq")
    probes = entered.select("h1", "h2", "rep", "copies", "home", "x", F.explode("probes").alias("list"))
    # One row per list, at most MOST_LISTS: long lists and much probed ones are cut into blocks.
    stored_n = {r["home"]: r["n"] for r in entered.groupBy("home").agg(F.count("*").alias("n")).collect()}
    asked_n = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(k, -(-asked_n[k] // BLOCK), -(-stored_n[k] // BLOCK)) for k in stored_n if k in asked_n],
        "list int, q_blocks int, x_blocks int",
    )

    def steps(column):
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    def block_of(column, salt):
        return F.pmod(F.xxhash64("h1", F.lit(salt)), F.col(column)).cast("int")

    asked = probes.join(F.broadcast(blocks), "list").select(
        "list", block_of("q_blocks", 1).alias("qb"), steps("x_blocks").alias("xb"), "h1", "h2", "rep", "copies", "home", "x",
    )
    stored = entered.withColumnRenamed("home", "list").join(F.broadcast(blocks), "list").select(
        "list", steps("q_blocks").alias("qb"), block_of("x_blocks", 2).alias("xb"),
        *[F.col(c).alias(c) for c in ("h1", "h2", "rep", "copies", "near", "x", "code", "error")],
    )

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series([], dtype="Int64") for c in ("h1", "h2", "linked", "u", "v")})
        if a.empty or b.empty:
            return empty
        ix = shared.value
        q = np.frombuffer(b"".join(a["x"]), np.float64).reshape(len(a), -1)
        x = np.frombuffer(b"".join(b["x"]), np.float64).reshape(len(b), -1)
        codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
        i, j = _links(ix, int(a["list"].iloc[0]), q, x, codes, b["error"].to_numpy(), cosine)
        other = (a["h1"].to_numpy()[i] != b["h1"].to_numpy()[j]) | (a["h2"].to_numpy()[i] != b["h2"].to_numpy()[j])
        i, j = i[other], j[other]
        if not len(i):
            return empty
        # The stored vector counts the link too where its own probes do not reach the query's list.
        back = x[j] - ix.centres[a["home"].to_numpy()[i]]
        unseen = (back * back).sum(1) > b["near"].to_numpy()[j] + ix.margin
        counted = [_counts(a, i, b["copies"].to_numpy()[j]), _counts(b, j[unseen], a["copies"].to_numpy()[i[unseen]])]
        u, v = _spanning(a["rep"].to_numpy(), b["rep"].to_numpy(), i, j)
        joined = pd.DataFrame({"u": u, "v": v}, dtype="Int64")  # nullable integers: hashes must not turn into floats
        return pd.concat([*counted, joined])[["h1", "h2", "linked", "u", "v"]]

    pair = ["list", "qb", "xb"]
    out = saved(asked.groupBy(pair).cogroup(stored.groupBy(pair)).applyInPandas(
        compare, "h1 bigint, h2 bigint, linked bigint, u bigint, v bigint"
    ), "pq")
    return out.filter("linked is not null").select("h1", "h2", "linked"), out.filter("u is not null").select("u", "v")


def _counts(rows: pd.DataFrame, at: np.ndarray, copies: np.ndarray) -> pd.DataFrame:
    linked = np.zeros(len(rows), np.int64)
    np.add.at(linked, at, copies)
    some = np.flatnonzero(linked)
    return pd.DataFrame({"h1": rows["h1"].to_numpy()[some], "h2": rows["h2"].to_numpy()[some], "linked": linked[some]}, dtype="Int64")


def _spanning(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked node to the smallest node it reaches within the block; as few as nodes."""
    nodes, where = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
    a, b = where[: len(i)], where[len(i):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]
