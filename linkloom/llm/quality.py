"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document's score is a weighted sum of text features. A pair says that one document is better than another;
the weights minimise the logistic loss of the feature differences over the pairs. A quantile of the scores
then becomes the threshold.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import held_out, keep_rows, map_rows, saved, usable_labels
from linkloom.scale import rank_by

FEATURES = (
    "adjacent_repeats", "distinct_words", "upper_letters", "symbols", "junk_symbols", "symbol_ended_words",
    "digits", "word_length", "distinct_lines", "log_words",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_BLANK = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _BLANK)
_JUNK = np.isin(_BYTES, np.frombuffer(b"!#$%&*+<=>@^_`{|}~\\", np.uint8))
_PLAIN_END = np.isin(_BYTES, np.frombuffer(b".,;:?)'\"", np.uint8))


def features(text: str | None) -> list[float]:
    """Feature values of one whole text; NULL counts as empty, and an empty text has zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(raw, minlength=256)
    n, size = len(words), len(raw)
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    blank = _BLANK[raw]
    ends = np.flatnonzero(np.append(blank[1:], True) & ~blank)
    last = raw[ends]
    lines = text.split("\n")
    return [
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(words)) / n,
        upper / max(upper + lower, 1),
        int(counts[_SYMBOL].sum()) / size,
        int(counts[_JUNK].sum()) / n,
        int((_SYMBOL[last] & ~_PLAIN_END[last]).sum()) / n,
        int(counts[_DIGIT].sum()) / size,
        size / n,
        len(set(lines)) / len(lines),
        float(np.log1p(n)),
    ]


@dataclass(frozen=True)
class Ranker:
    """Weights of the standardised features, and the score at the chosen quantile."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights)


def _loss(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over pairs: their number, the logistic loss, its gradient and its second derivatives, in one row."""
    s = diff @ w
    lose = 1 / (1 + np.exp(np.clip(s, -500, 500)))
    hess = (diff * (lose * (1 - lose))[:, None]).T @ diff
    return np.concatenate([[len(diff), np.logaddexp(0, -s).sum()], -diff.T @ lose, hess.ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], k: int, l2: float, steps: int) -> np.ndarray:
    """Weights that minimise the mean loss + l2/2 |w|^2; ``sums`` gives the sums of ``_loss`` at any weights."""
    def at(w):
        n, loss, *rest = sums(w)
        return loss / n + l2 / 2 * w @ w, np.array(rest[:k]) / n + l2 * w, np.array(rest[k:]).reshape(k, k) / n + l2 * np.eye(k)

    w = np.zeros(k)
    loss, grad, hess = at(w)
    for _ in range(steps):
        step, size = np.linalg.solve(hess, grad), 1.0
        found = at(w - step)
        while found[0] > loss and size > 1e-4:
            size /= 2
            found = at(w - size * step)
        w, (loss, grad, hess) = w - size * step, found
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit_pairs(better: np.ndarray, worse: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w.(better - worse))) + l2/2 |w|^2, by Newton steps."""
    diff = better - worse
    return _newton(lambda w: _loss(diff, w), diff.shape[1], l2, steps)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _sums(df: DataFrame, column: str, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``work`` over all batches of an array column; a partition hands on one row, whatever its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [work(_matrix(b[column])) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_pydict({"s": [[math.fsum(v) for v in zip(*parts)]]}, schema=pa.schema([("s", pa.list_(pa.float64()))]))

    return np.array([math.fsum(v) for v in zip(*[r["s"] for r in df.select(column).mapInArrow(run, "s array<double>").collect()])])


def fit(rows: DataFrame, rounds: int = 4, l2: float = 1e-3, steps: int = 50) -> Ranker:
    """Fit on all labelled feature rows (``h``, ``y``, ``x``); the order of ``h`` decides who meets whom.

    Every row of the larger class meets ``rounds`` rows of the other. Without both classes nothing can be
    preferred: all weights are zero and every document ties. The threshold is the quantile of the scores at
    the share of label 0, midway between its two neighbours. Pairs are joined, summed and sorted on the cluster; the driver gets
    sums, a row per partition, and the two scores beside the threshold.
    """
    k = len(FEATURES)
    rows = rows.filter("y in (0, 1)")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_bad, n_good = sizes.get(0, 0), sizes.get(1, 0)
    n = n_bad + n_good
    if not n_bad or not n_good:
        return Ranker((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0)
    mean = _sums(rows, "x", lambda x: x.sum(0)) / n
    scale = np.sqrt(_sums(rows, "x", lambda x: ((x - mean) ** 2).sum(0)) / n) + 1e-9

    # Rows of label 0 come first, so places begin anew after them.
    placed = rank_by(rows, [F.col("y"), F.col("h")], "_at")
    bad = placed.filter("y = 0").select((F.col("_at") - 1).alias("place"), "x")
    good = placed.filter("y = 1").select((F.col("_at") - 1 - n_bad).alias("place"), "x")
    many, few, n_many, n_few = (good, bad, n_good, n_bad) if n_good >= n_bad else (bad, good, n_bad, n_good)
    shift = F.explode(F.array(*[F.lit(r * 7919) for r in range(rounds)])).alias("shift")
    # Pair i of a round is that of the good row i + shift and of the bad row i + 3 shift, each in a circle.
    own, other = (1, 3) if n_good >= n_bad else (3, 1)
    begin = F.pmod(F.col("place") - own * F.col("shift"), F.lit(n_many))
    met = many.select("place", "x", shift).select("x", F.pmod(begin + other * F.col("shift"), F.lit(n_few)).alias("place"))
    met = met.join(few.withColumnRenamed("x", "_x"), "place").select("x", "_x")
    sign = 1.0 if n_good >= n_bad else -1.0

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = sign * (_matrix(b["x"]) - _matrix(b["_x"])) / scale
            yield pa.RecordBatch.from_pydict({"d": list(d)}, schema=pa.schema([("d", pa.list_(pa.float64()))]))

    pairs = saved(met.mapInArrow(differ, "d array<double>"), "pairs")
    w = _newton(lambda v: _sums(pairs, "d", lambda d: _loss(d, v)), k, l2, steps)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"s": (_matrix(b["x"]) - mean) / scale @ w}, schema=pa.schema([("s", pa.float64())]))

    cut = min(max(n_bad, 1), n - 1)
    ordered = rank_by(rows.select("x").mapInArrow(strengths, "s double"), [F.col("s")], "_at")
    beside = [r["s"] for r in ordered.filter(F.col("_at").isin(cut, cut + 1)).collect()]
    return Ranker(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), sum(beside) / 2)


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on all labelled, not held-out documents; equal texts count once, as the larger label.

    Features are told where the texts lie and then meet the labels, so no text is moved, however many labels there are.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.xxhash64("text").alias("h"), "text")

    def work(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "h": b["h"], "x": [features(t) for t in b["text"]]}

    found = map_rows(rows, f"doc_id {kind}, h bigint, x array<double>", work).join(usable_labels(labels, "quality"), "doc_id")
    return fit(saved(found.groupBy("h").agg(F.max(F.struct("y", "x")).alias("_r")).select("h", "_r.*"), "features"))


def score(docs: DataFrame, model: Ranker, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score, predicted) per document; the score is ``cut`` at the model's threshold.

    NULL and empty texts get the score of a text without words. Repeated rows are scored each for itself; other columns
    are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    at_cut = float(np.log(cut / (1 - cut)))

    def work(batches):
        for b in batches:
            x = np.array([features(t) for t in b["text"]], dtype=float).reshape(-1, len(FEATURES))
            s = np.clip(model.strengths(x) - model.threshold + at_cut, -700, 700)
            p = 1 / (1 + np.exp(-s))
            yield {"id": b["id"], "score": p.tolist(), "predicted": (p >= cut).astype(int).tolist()}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, f"id {kind}, score double, predicted int", work).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``cut``, with all their columns; one pass over the texts.

    NULL and empty texts are judged as texts without words. Rows that repeat an id or a text are judged alike; an empty table stays
    empty. Without labels of both classes all documents stay.
    """
    model = train(docs, labels)
    at_cut = float(np.log(cut / (1 - cut)))

    def good(texts):
        x = np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return model.strengths(x) - model.threshold + at_cut >= at_cut

    return keep_rows(docs, "text", good)


def scored_with_split(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
