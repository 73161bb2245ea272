"""Exact top-k inner products by a three-phase uniform threshold.

The components are cut into slices; each slice of a block of candidates gives, for a query, a list of local scores whose
sum is the score. Phase one gathers the first entries of every list, with their whole scores: the k-th best of them
is a score the result cannot fall below. Phase two sends each query that cutoff, turned into one uniform threshold for
the lists: a vector below it in every list cannot reach the cutoff. Phase three resolves the remaining scores of the
entries above the threshold in any list exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import saved

SLICES = 4
#: Rows of a block; blocks of queries and candidates meet pairwise, each pair in one task.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
#: Bytes of list scores that a task holds at once: it goes through its queries in groups of so many.
SCORE_BYTES = 64 << 20


def usable(vector: Column) -> Column:
    """Not NULL, not empty, without NULL or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def _nothing(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point while every partial sum is exact in it, else by integers."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2**53:
        return a @ b.T
    if bound >= 2**63:
        raise OverflowError("a score may exceed 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _lists(q: np.ndarray, x: np.ndarray, slices: int) -> list[np.ndarray]:
    return [_exact(q[:, c], x[:, c]) for c in np.array_split(np.arange(q.shape[1]), min(slices, q.shape[1]))]


def _groups(n_queries: int, n_candidates: int, slices: int) -> list[slice]:
    """Queries whose lists of scores fit into ``SCORE_BYTES`` together."""
    step = max(1, SCORE_BYTES // (8 * max(n_candidates, 1) * slices))
    return [slice(i, i + step) for i in range(0, n_queries, step)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id; exact also where many tie at the k-th."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, slices: int = SLICES, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of each query by integer inner product, ties to smaller ids.

    Each component becomes floor(scale * x). All usable rows are candidates, except those with the query's own id;
    vectors of other dimensions are no candidates for it. Unusable vectors (see ``usable``) and NULL ids take no part. Rows that
    repeat an id are separate candidates; of queries that share an id, the first by vector is asked. Other columns are not read.
    """
    vec = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    good = saved(
        rows.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("bigint").alias("id"), vec.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
        ),
        "topk",
    )
    n_q, n = good.agg(F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0)), F.count("*")).first()
    q_blocks, x_blocks = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    queries = good.filter("q").groupBy("id").agg(F.min("v").alias("v")).select(
        "id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("qb")
    )
    # Every block of queries meets every block of candidates of its dimension.
    left = queries.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
    right = good.select(  # aliases keep the two sides of one table apart
        F.col("id").alias("id"), F.col("v").alias("v"), F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(x_blocks)).cast("int").alias("xb")
    ).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    pair = ["dim", "qb", "xb"]

    def first_lists(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _nothing("query_id", "id", "score", "floor")
        ids, own = b["id"].to_numpy(), a["id"].to_numpy()
        q, x = _matrix(a["v"]), _matrix(b["v"])
        out = []
        for part in _groups(len(own), len(ids), slices):
            lists = _lists(q[part], x, slices)
            for i, one in enumerate(own[part]):
                other = np.flatnonzero(ids != one)
                if not len(other):
                    continue
                # Only the first entries of the lists get their whole scores.
                seen = np.unique(np.concatenate([other[_best(p[i][other], ids[other], k)] for p in lists]))
                score = _exact(q[part][i:i + 1], x[seen])[0]
                best = _best(score, ids[seen], k)
                floors = [float(p[i].min()) for p in lists]
                out.append(pd.DataFrame({"query_id": one, "id": ids[seen[best]], "score": score[best].astype(np.int64), "floor": [floors] * len(best)}))
        return pd.concat(out) if out else _nothing("query_id", "id", "score", "floor")

    groups = left.groupBy(pair).cogroup(right.groupBy(pair))
    gathered = saved(groups.applyInPandas(first_lists, "query_id bigint, id bigint, score bigint, floor array<double>"), "topk")
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    cutoff = (
        gathered.withColumn("place", F.row_number().over(kth)).filter(F.col("place") <= k)
        .groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    )
    least = gathered.select("query_id", F.posexplode("floor")).groupBy("query_id", "pos").agg(F.min("col").alias("m"))
    floors = least.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("floors"))
    known = cutoff.join(floors, "query_id").withColumnRenamed("query_id", "id")

    def collect(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _nothing("query_id", "id", "score")
        ids, own = b["id"].to_numpy(), a["id"].to_numpy()
        q, x = _matrix(a["v"]), _matrix(b["v"])
        out = []
        for part in _groups(len(own), len(ids), slices):
            lists = _lists(q[part], x, slices)
            for i, (one, cut, low) in enumerate(zip(own[part], a["cutoff"].iloc[part], a["floors"].iloc[part])):
                enough = ids != one
                if not pd.isna(cut):
                    low = np.asarray(low, float)
                    share = (float(cut) - low.sum()) / len(low)  # what some list must give above its least score
                    above = np.zeros(len(ids), bool)
                    for p, m in zip(lists, low):
                        above |= p[i] >= m + share
                    enough &= above
                at = np.flatnonzero(enough)
                if not len(at):
                    continue
                score = _exact(q[part][i:i + 1], x[at])[0]
                best = _best(score, ids[at], k)
                out.append(pd.DataFrame({"query_id": one, "id": ids[at][best], "score": score[best].astype(np.int64)}))
        return pd.concat(out) if out else _nothing("query_id", "id", "score")

    asked = queries.join(known, "id").withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
    entries = asked.groupBy(pair).cogroup(right.groupBy(pair)).applyInPandas(collect, "query_id bigint, id bigint, score bigint")
    ranked = entries.withColumn("rank", F.row_number().over(kth)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
