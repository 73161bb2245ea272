"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes, in windows, go through one recurrent layer forwards and one backwards; at every position the two states give
probabilities of the languages, and a document's probabilities are the mean over all its positions. The network is trained in numpy
by backpropagation through time, on windows of a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import fraction_hash, map_texts

UNKNOWN = "und"
WINDOW = 128
STATES = 16
#: Windows that go through the network together.
TOGETHER = 2048
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Layer:
    """One direction: what a byte adds to the gates (reset, update, candidate), and what the state adds."""

    byte: np.ndarray  # 3 x 256 x states
    state: np.ndarray  # 3 x states x states


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    forward: Layer
    backward: Layer
    out: np.ndarray  # 2 states x languages
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.byte, self.forward.state, self.backward.byte, self.backward.state, self.out, self.bias]


def network(languages: tuple[str, ...], parameters: list[np.ndarray]) -> Network:
    return Network(languages, Layer(*parameters[:2]), Layer(*parameters[2:4]), *parameters[4:])


def fresh(languages: tuple[str, ...], states: int, rng: np.random.Generator) -> Network:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    k = len(languages)
    layers = [x for _ in range(2) for x in (normal(3, 256, states, scale=0.3), normal(3, states, states, scale=states**-0.5))]
    return network(languages, [*layers, normal(2 * states, k, scale=0.3), np.zeros(k, np.float32)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


# Training.

def _pass(layer: Layer, x: np.ndarray, live: np.ndarray, steps: range) -> tuple[np.ndarray, list]:
    """States (time, row, state) and what the way back needs; rows that are not live at a step have the state zero."""
    h = np.zeros((x.shape[1], layer.state.shape[1]), np.float32)
    out, kept = np.empty((x.shape[0], *h.shape), np.float32), []
    for t in steps:
        u = h @ layer.state
        r, z = _sigmoid(layer.byte[0, x[t]] + u[0]), _sigmoid(layer.byte[1, x[t]] + u[1])
        n = np.tanh(layer.byte[2, x[t]] + r * u[2])
        kept.append((t, h, r, z, n, u[2]))
        h = (n + z * (h - n)) * live[t]
        out[t] = h
    return out, kept


def _back(layer: Layer, x: np.ndarray, live: np.ndarray, kept: list, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a layer's two arrays, given those of its states."""
    d_byte, d_state = np.zeros_like(layer.byte), np.zeros_like(layer.state)
    every = np.empty((len(x), 3, *above.shape[1:]), np.float32)
    after = np.zeros(above.shape[1:], np.float32)
    for t, h, r, z, n, un in reversed(kept):
        dh = (above[t] + after) * live[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        gates = every[t]
        gates[0], gates[1], gates[2] = dr, dz, dn
        into = np.stack([dr, dz, dn * r])
        d_state += h.T @ into
        after = dh * z + (into @ layer.state.transpose(0, 2, 1)).sum(0)
    # Gradients of a byte: those of all its places, brought together by a sort.
    order = np.argsort(x, axis=None, kind="stable")
    values = x.ravel()[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    for g in range(3):
        d_byte[g, values[first]] = np.add.reduceat(every[:, g].reshape(-1, every.shape[-1])[order], first, axis=0)
    return d_byte, d_state


def loss_and_gradients(net: Network, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of the windows ``x`` (row, time), of which ``sizes`` count; and its gradients."""
    x = np.ascontiguousarray(x.T)
    live = (np.arange(len(x))[:, None] < sizes[None, :]).astype(np.float32)[:, :, None]
    hf, kept_f = _pass(net.forward, x, live, range(len(x)))
    hb, kept_b = _pass(net.backward, x, live, range(len(x) - 1, -1, -1))
    both = np.concatenate([hf, hb], 2)
    p = _softmax(both @ net.out + net.bias)
    total = float(live.sum())
    at = (np.arange(len(x))[:, None], np.arange(x.shape[1])[None, :], y[None, :])
    loss = float(-(np.log(p[at] + 1e-12) * live[:, :, 0]).sum() / total)
    p[at] -= 1
    d = p * live / np.float32(total)
    k, s = d.shape[-1], hf.shape[-1]
    d_out = both.reshape(-1, 2 * s).T @ d.reshape(-1, k)
    above = d @ net.out.T
    grads = [
        *_back(net.forward, x, live, kept_f, above[:, :, :s]), *_back(net.backward, x, live, kept_b, above[:, :, s:]),
        d_out, d.reshape(-1, k).sum(0),
    ]
    return loss, grads


def fit(
    windows: list[bytes], languages: list[str], states: int = STATES, steps: int = 150, batch: int = 128, rate: float = 0.015, seed: int = 0,
) -> Network:
    """Train on labelled windows by Adam; every language is drawn equally often. Without windows no language is learned."""
    names = tuple(sorted(set(languages)))
    rng = np.random.default_rng(seed)
    net = fresh(names, states, rng)
    if not names:
        return net
    sizes = np.array([len(w) for w in windows])
    x = np.zeros((len(windows), max(sizes.max(), 1)), np.uint8)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.array([names.index(n) for n in languages])
    rows = [np.flatnonzero(y == k) for k in range(len(names))]
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        which = rng.integers(0, len(names), batch)
        picked = np.array([rows[k][rng.integers(len(rows[k]))] for k in which])
        _, grads = loss_and_gradients(network(names, params), x[picked], sizes[picked], y[picked])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, 2 * (steps - step + 1) / steps)
        for p, g, m, v in zip(params, grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network(names, params)


# Scoring.

def _states(layer: Layer, x: np.ndarray, alive: np.ndarray, steps: range) -> np.ndarray:
    """States (time, row, state) of windows sorted from long to short; ``alive`` rows are within theirs at each step.

    The same values as in training, with as few and as narrow array operations as possible: gates are kept as tanh of half of
    their input, the halves being put into the arrays.
    """
    byte, state = layer.byte.copy(), layer.state.copy()
    byte[:2] *= 0.5
    state *= 0.5
    size = state.shape[1]
    out = np.zeros((x.shape[0], x.shape[1], size), np.float32)
    sums, add, diff = (np.empty((3, x.shape[1], size), np.float32) for _ in range(3))
    before = np.zeros((x.shape[1], size), np.float32)
    for t in steps:
        n = alive[t]
        h, into = before[:n], out[t, :n]
        a, u, d = sums[:, :n], add[:, :n], diff[0, :n]
        np.take(byte, x[t, :n], axis=1, out=a, mode="clip")
        np.matmul(h, state, out=u)
        a[:2] += u[:2]
        np.tanh(a[:2], out=a[:2])
        a[:2] += 1
        u[2] *= a[0]
        a[2] += u[2]
        np.tanh(a[2], out=a[2])
        np.subtract(h, a[2], out=d)
        d *= a[1]
        d *= 0.5
        np.add(a[2], d, out=into)
        before = out[t]
    return out


def _probabilities(net: Network, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities (time, window, language) of windows from long to short; their order; and how many reach each time."""
    sizes = np.array([len(w) for w in windows])
    order = np.argsort(-sizes, kind="stable")
    x = np.zeros((sizes.max(), len(windows)), np.uint8)
    for k, i in enumerate(order):
        x[: sizes[i], k] = np.frombuffer(windows[i], np.uint8)
    alive = (sizes[None, :] > np.arange(len(x))[:, None]).sum(1)
    hf = _states(net.forward, x, alive, range(len(x)))
    hb = _states(net.backward, x, alive, range(len(x) - 1, -1, -1))
    half = hf.shape[-1]
    p = hf @ net.out[:half]
    p += hb @ net.out[half:]
    p += net.bias
    np.exp(np.clip(p, -40, 40, out=p), out=p)
    p /= p @ np.ones((p.shape[-1], 1), np.float32)
    return p, order, alive


def positions(net: Network, windows: list[bytes]) -> list[np.ndarray]:
    """Probabilities of the languages at every byte of every window."""
    p, order, _ = _probabilities(net, windows)
    out: list = [None] * len(windows)
    for k, i in enumerate(order):
        out[i] = p[: len(windows[i]), k]
    return out


def _sums(net: Network, windows: list[bytes]) -> np.ndarray:
    """Per window the sum of its positions' probabilities."""
    out = np.zeros((len(windows), len(net.languages)))
    for i in range(0, len(windows), TOGETHER):
        p, order, alive = _probabilities(net, windows[i:i + TOGETHER])
        for t in np.flatnonzero(alive < len(order)):
            p[t, alive[t]:] = 0
        out[i + order] = p.sum(0)
    return out


def documents(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its probability of each whole text; ``und`` and 0 for NULL and for texts without a letter."""
    windows, counts, lengths = [], [], []
    for text in texts:
        raw = text.encode("utf-8", "replace") if text and net.languages and _LETTER.search(text) else b""
        windows += [raw[i:i + WINDOW] for i in range(0, len(raw), WINDOW)]
        counts.append(-(-len(raw) // WINDOW))
        lengths.append(len(raw))
    sums = np.vstack([np.zeros(len(net.languages)), np.cumsum(_sums(net, windows), 0)])
    ends = np.cumsum(counts)
    names, scores = [], []
    for end, count, length in zip(ends, counts, lengths):
        if not length:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        p = (sums[end] - sums[end - count]) / length
        k = int(p.argmax())
        names.append(net.languages[k])
        scores.append(float(np.clip(p[k], 0, 1)))
    return names, scores


def withheld(doc_id: Column) -> Column:
    """Rows that nothing is learned from: the crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Network:
    """Fit on two windows of each of at most about ``max_rows`` labelled, not withheld texts with letters, picked by a hash of
    the id: one from anywhere in the text, one from where that hash says. Only windows reach the driver (256 bytes a text);
    equal ones count once."""
    usable = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~withheld(F.col(id_col)) & F.col(text_col).rlike(r"\p{L}"))
    total = usable.count()
    share = min(1.0, max_rows / max(total, 1))
    picked = usable.filter(fraction_hash(F.col(id_col), F.lit("languages")) < share)

    def window(salt: int) -> Column:
        at = fraction_hash(F.col(id_col), F.lit(salt)) * F.greatest(F.char_length(text_col) - WINDOW // 2, F.lit(1))
        return F.substring(F.col(text_col), at.cast("int") + 1, F.lit(WINDOW))

    both = picked.select(F.col(lang_col).cast("string").alias("lang"), F.explode(F.array(window(1), window(2))).alias("window")).distinct()
    got = both.toArrow().to_pydict()
    rows = sorted((w.encode("utf-8", "replace")[:WINDOW], n) for w, n in zip(got["window"], got["lang"]) if w)
    return fit([w for w, _ in rows], [n for _, n in rows], **options)


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text.

    NULL, empty and letterless texts are ``und`` with score 0, and so is every text if no language was learned. Of equally
    probable languages the first by name is taken. Repeated rows are told each for itself; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 100 kB

    def work(batches):
        for b in batches:
            names, scores = documents(shared.value, b["text"])
            yield {"id": b["id"], "lang_pred": names, "score": scores}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, f"id {kind}, lang_pred string, score double", work).withColumnRenamed("id", id_col)


def identified_with_split(docs: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    out = identify(docs, train(docs, max_rows))
    return out.select("doc_id", withheld(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
