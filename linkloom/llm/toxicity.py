"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digits used as letters, and
turns everything else into single spaces. Lexicon entries are beginnings of words with a weight; exception
phrases cancel the matches they cover. The summed weight over the length of the text, put through a logistic
curve, is the score.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import held_out, keep_rows, labelled_sample, map_rows, saved

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOK_ALIKES = dict(zip(
    "авекмнорстухіјѕԁһӏԛԝαβεηικνορτυχγ",
    "abekmhopctyxijsdhiqwabenikvoptuxy",
))
SUBSTITUTES = dict(zip("013457@$", "oieastas"))


class _Folding(dict):
    """Character to folded text, worked out once per character."""

    def __missing__(self, code: int) -> str:
        out = []
        for ch in unicodedata.normalize("NFKD", chr(code)).lower():
            ch = LOOK_ALIKES.get(ch, ch)
            kind = unicodedata.category(ch)
            if kind[0] == "M" or kind == "Cf":
                continue
            out.append(ch if kind[0] in "LN" or ch in "@$" else " ")
        self[code] = "".join(out)
        return self[code]


_FOLD = _Folding()
_MIXED = re.compile(r"[^ ]*[0-9@$][^ ]*")
_TO_LETTERS = str.maketrans(SUBSTITUTES)


def _letters(m: re.Match) -> str:
    token = m.group().strip("@$")
    if not any(c.isalpha() for c in token):
        return " "
    as_i = token.translate(_TO_LETTERS)
    # A one is written for either letter; both readings stand in the folded text.
    return f"{as_i} {token.replace('1', 'l').translate(_TO_LETTERS)}" if "1" in token else as_i


def fold(text: str | None) -> str:
    """Folded words joined and surrounded by single spaces; NULL counts as empty."""
    flat = (text or "").translate(_FOLD)
    flat = _MIXED.sub(_letters, flat)
    return f" {' '.join(flat.split())} "


@dataclass(frozen=True)
class Lexicon:
    """Folded word beginnings with weights, folded exception phrases, and the logistic curve of the density."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 4.0
    bias: float = -4.0
    smoothing: float = 20.0
    _automaton: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": []}

    def automaton(self) -> ahocorasick.Automaton:
        if not self._automaton:
            a = ahocorasick.Automaton()
            exceptions = set(self.exceptions)
            for word in {*self.terms, *exceptions}:  # a term may be an exception where it is the whole word
                a.add_word(" " + word, (self.terms.get(word), word in exceptions, len(word)))
            a.make_automaton()
            self._automaton.append(a)
        return self._automaton[0]

    def density(self, text: str | None) -> float:
        """Weight of all matches outside exceptions, per hundred words."""
        flat = fold(text)
        if not self.terms:
            return 0.0
        found, starts, ends = [], [], []
        for end, (weight, exception, size) in self.automaton().iter(flat):
            if weight is not None:
                found.append((end - size + 1, end, weight))
            if exception and flat[end + 1] == " ":  # an exception ends with its word
                starts.append(end - size + 1)
                ends.append(end)
        longest = max(map(len, self.exceptions), default=0)

        def spared(first: int, last: int) -> bool:
            """Whether an exception covers the match; ends come in order, and none begins earlier than its length allows."""
            k = bisect.bisect_left(ends, last)
            while k < len(ends) and ends[k] < first + longest:
                if starts[k] <= first:
                    return True
                k += 1
            return False

        total = sum(w for first, last, w in found if not spared(first, last))
        return 100 * total / (flat.count(" ") - 1 + self.smoothing)

    def scores(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(density) + self.bias, -700, 700)))


def _prefixes(words: dict[str, int], shortest: int, longest: int) -> dict[str, int]:
    out: dict[str, int] = {}
    for w, n in words.items():
        out[w + " "] = n
        for k in range(shortest, min(len(w), longest) + 1):
            out[w[:k]] = out.get(w[:k], 0) + n
    return out


COUNTED = ("pos", "neg", "pos_n", "neg_n", "pos_sq", "neg_sq")


def term_counts(rows: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Of each word beginning, and each whole word (ended by a space), in toxic and in clean texts: the texts that hold it
    (``pos``, ``neg``), its occurrences (``_n``), and their squares by text (``_sq``)."""

    def work(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            columns = zip(*counts.values()) if counts else [()] * len(COUNTED)
            out = {"term": list(counts), **{c: list(v) for c, v in zip(COUNTED, columns)}}
            counts.clear()
            return out

        for b in batches:
            for text, y in zip(b["text"], b["y"]):
                at = 0 if y else 1
                for t, n in _prefixes(Counter(fold(text).split()), shortest, longest).items():
                    c = counts.setdefault(t, [0] * len(COUNTED))
                    c[at] += 1
                    c[at + 2] += n
                    c[at + 4] += n * n
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    return (
        map_rows(rows.select("text", "y"), "term string, " + ", ".join(f"{c} bigint" for c in COUNTED), work)
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in COUNTED])
    )


def strength(words_pos: int, words_neg: int, sure: float = 1.64) -> Column:
    """Log of how many times as frequent per word a term is in toxic texts at least.

    The rates are held against their confidence bounds (Byar's for counts, ``sure`` standard deviations each).
    Occurrences that come together in a text are not independent: their mean size, the sum of squares over the sum,
    is the unit that is counted.
    """

    def bound(n: Column, sign: int) -> Column:
        inner = 1 - 1 / (9 * n) + sign * sure / (3 * F.sqrt(n))
        return n * F.pow(F.greatest(inner, F.lit(0.0)), F.lit(3.0))

    together = [F.coalesce(F.try_divide(F.col(f"{c}_sq"), F.col(f"{c}_n")), F.lit(1.0)) for c in ("pos", "neg")]
    least = together[0] * bound(F.greatest(F.col("pos_n") / together[0], F.lit(1e-9)), -1)
    most = together[1] * bound(F.col("neg_n") / together[1] + 1, 1)
    return F.log(F.greatest(least, F.lit(1e-9)) / words_pos) - F.log(most / words_neg)


def choose_terms(candidates: list[tuple[str, float, float]], max_terms: int) -> dict[str, float]:
    """Of (term, strength, evidence) the terms with most evidence that neither begin nor continue one another.

    Of equal ones beginnings go before whole words, and longer before shorter.
    """
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for t, weight, _ in sorted(candidates, key=lambda c: (-c[2], c[0].endswith(" "), -len(c[0]), c[0])):
        starts = [t[:n] for n in range(1, len(t) + 1)]
        if t in begun or any(s in kept for s in starts):
            continue
        kept[t] = weight
        begun.update(starts)
        if len(kept) >= max_terms:
            break
    return kept


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 2_000, shortest: int = 4, longest: int = 10,
    exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learn terms, weights, exceptions and the curve from at most about ``max_rows`` labelled documents.

    Texts that are equal but for case count once. Word beginnings of ``shortest`` to ``longest`` letters and whole
    words are counted on the cluster; the driver sees those surely more frequent per word in toxic texts (at most 20 per
    kept term), and each weighs by its ``strength``. Words that begin with a term but occur mostly in clean texts become
    exceptions, beside those given. Without toxic or clean texts the lexicon is empty and every score low.
    """
    sample = labelled_sample(docs, labels, "toxic", max_rows)
    # Texts of the bounded sample move once and are written, as four passes read them.
    rows = saved(
        sample.groupBy(F.xxhash64(F.lower("text")).alias("h"))
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min_by("y", F.xxhash64("text")).alias("y"))
        .select("text", "y")
    )
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon({})
    counts = saved(term_counts(rows, shortest, longest))
    # Each word counts once as a whole word.
    of = counts.filter(F.col("term").endswith(" ")).agg(F.sum("pos_n").alias("pos"), F.sum("neg_n").alias("neg")).first()
    weighed = counts.filter(F.col("pos") >= 3).withColumn("strength", strength(max(of["pos"] or 0, 1), max(of["neg"] or 0, 1)))
    evidence = F.col("strength") * F.col("pos_n") * F.col("pos_n") / F.col("pos_sq")
    likely = weighed.filter("strength > 0").select("term", "strength", F.round(evidence, 9).alias("evidence"))
    best = likely.orderBy(F.desc("evidence"), "term").limit(20 * max_terms)
    terms = choose_terms([tuple(r) for r in best.collect()], max_terms)
    spared = set(fold(e).strip() for e in exceptions)
    if terms:
        spared |= set(_clean_words(rows, terms, n_pos, n_neg))
    plain = Lexicon(terms, tuple(sorted(spared)))
    x, y = _densities(rows, plain)
    slope, bias = _curve(np.log1p(x), y)
    return Lexicon(terms, plain.exceptions, slope, bias)


def _clean_words(rows: DataFrame, terms: dict[str, float], n_pos: int, n_neg: int) -> list[str]:
    """Whole words that begin with a term and are no more frequent in toxic than in clean texts (at most 10,000)."""
    starts = tuple(terms)

    def work(batches):
        for b in batches:
            words, ys = [], []
            for text, y in zip(b["text"], b["y"]):
                for w in set(fold(text).split()):
                    if w.startswith(starts):
                        words.append(w)
                        ys.append(y)
            yield {"word": words, "y": ys}

    found = map_rows(rows.select("text", "y"), "word string, y int", work)
    by_word = found.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    clean = by_word.filter((F.col("neg") >= 3) & (F.col("pos") / n_pos <= F.col("neg") / n_neg))
    return [r["word"] for r in clean.orderBy(F.desc("neg"), "word").limit(10_000).collect()]


def _densities(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def work(batches):
        for b in batches:
            yield {"x": [lexicon.density(t) for t in b["text"]], "y": b["y"]}

    got = map_rows(rows.select("text", "y"), "x double, y int", work).toArrow().to_pydict()
    return np.array(got["x"], dtype=float), np.array(got["y"], dtype=float)


def _curve(x: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by damped Newton steps; the slope is never negative."""
    a, b = 1.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([((p - y) * x).mean() + l2 * a, (p - y).mean()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).mean() + l2, (w * x).mean()], [(w * x).mean(), w.mean() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def score(docs: DataFrame, lexicon: Lexicon, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score, predicted) per document. NULL and empty texts have density 0, hence the lowest score.

    Repeated rows are scored each for itself; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for b in batches:
            p = lexicon.scores(np.array([lexicon.density(t) for t in b["text"]], dtype=float))
            yield {"id": b["id"], "score": p.tolist(), "predicted": (p >= cut).astype(int).tolist()}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, f"id {kind}, score double, predicted int", work).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, cut: float = 0.5) -> DataFrame:
    """The documents that score below ``cut``, with all their columns; one pass over the texts.

    NULL and empty texts have the lowest score. Rows that repeat an id or a text are judged alike; an empty table stays empty.
    Without toxic or without clean labels all documents stay.
    """
    lexicon = train(docs, labels, max_rows)

    def clean(texts):
        return lexicon.scores(np.array([lexicon.density(t) for t in texts], dtype=float)) < cut

    return keep_rows(docs, "text", clean)


def scored_with_split(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs, train(docs, labels, max_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
