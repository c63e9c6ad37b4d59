"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of a hashed word vector and the mean of its hashed character n-gram vectors.  Windows of
``WINDOW`` words that overlap by a quarter are read in both directions; attention weighs the states, and a text's
score is that of its most toxic window.  All windows of all texts are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wattloom.llm.common import unused
from wattloom.llm.sampling import keyed, sample
from wattloom.llm.wordtext import WordTable, chunks, hashed_pieces, letter_words

WINDOW, STRIDE = 32, 24
VECTOR, HIDDEN, ATTEND = 16, 8, 8
WORD_BUCKETS, PIECE_BUCKETS = 1 << 14, 1 << 15
BATCH = 192
THRESHOLD = 0.7
FIT_DOCUMENTS = 1000  # most labelled rows of each class that the network is fitted on
FIT_CHARS = 8_000  # longer labelled texts are used where a class has too few shorter ones


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights of one model; two directions lie side by side where a name ends in ``2``."""

    words: np.ndarray
    pieces: np.ndarray
    enter2: np.ndarray  # (2, VECTOR, 3 * HIDDEN)
    recur2: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    bias2: np.ndarray  # (2, 3 * HIDDEN)
    attend: np.ndarray  # (2 * HIDDEN, ATTEND)
    query: np.ndarray
    out: np.ndarray
    shift: np.ndarray  # (1,)

    @staticmethod
    def fresh(seed: int = 0) -> "Network":
        r = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        return Network(
            draw(WORD_BUCKETS, VECTOR, scale=0.01),
            draw(PIECE_BUCKETS, VECTOR, scale=0.05),
            draw(2, VECTOR, 3 * HIDDEN, scale=0.3),
            draw(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            np.zeros((2, 3 * HIDDEN), np.float32),
            draw(2 * HIDDEN, ATTEND, scale=0.3),
            draw(ATTEND, scale=0.5),
            draw(2 * HIDDEN, scale=0.3),
            np.zeros(1, np.float32),
        )

    def vectors(self, words: list[str]) -> np.ndarray:
        ids = [zlib.crc32(w.encode()) % WORD_BUCKETS for w in words]
        flat, sizes = hashed_pieces(words, 3, 5, PIECE_BUCKETS)
        mean = np.add.reduceat(self.pieces[flat], np.cumsum(np.r_[0, sizes])[:-1], axis=0) / sizes[:, None]
        return (self.words[ids] + mean).astype(np.float32)

    def entries(self, words: list[str]) -> np.ndarray:
        """What a word adds to the gates of both directions."""
        out = np.empty((len(words), 6 * HIDDEN), np.float32)
        for i in range(0, len(words), 4096):
            x = self.vectors(words[i : i + 4096])
            for d in (0, 1):
                out[i : i + 4096, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)] = x @ self.enter2[d] + self.bias2[d]
        return out


def _forward(net: Network, entry: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows ``ids`` (rows of ``entry``, 0 as padding); ``keep`` collects what training needs."""
    n, steps = ids.shape
    h2 = np.zeros((2, steps, n, HIDDEN), np.float32)
    if keep is not None:
        keep["gates"] = [[None] * steps, [None] * steps]
    for d in (0, 1):
        h, mine = np.zeros((n, HIDDEN), np.float32), entry[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            at = ids[:, t]
            x, u = mine[at], h @ net.recur2[d]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            then = new + z * (h - new)
            if (at == 0).any():
                then = np.where((at == 0)[:, None], h, then)
            if keep is not None:
                keep["gates"][d][t] = (h, z, r, new, u[:, 2 * HIDDEN :])
            h2[d, t] = h = then
    states = np.concatenate([h2[0], h2[1]], axis=2)  # steps, n, 2 * HIDDEN
    inner = np.tanh(states @ net.attend)
    weight = np.where(ids.T == 0, -30.0, inner @ net.query)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    if keep is not None:
        keep.update(states=states, inner=inner, weight=weight, pooled=pooled)
    return pooled @ net.out + net.shift[0]


def _backward(net: Network, keep: dict, ids: np.ndarray, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights, and of the entries by window and step (steps, n, both directions)."""
    states, inner, weight, pooled = keep["states"], keep["inner"], keep["weight"], keep["pooled"]
    steps, n, _ = states.shape
    grad = {"out": pooled.T @ slope, "shift": slope.sum(keepdims=True)}
    d_pool = slope[:, None] * net.out
    d_states = weight[:, :, None] * d_pool
    d_weight = (states * d_pool).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_score[ids.T == 0] = 0
    grad["query"] = (inner * d_score[:, :, None]).sum(axis=(0, 1))
    d_inner = d_score[:, :, None] * net.query * (1 - inner**2)
    grad["attend"] = states.reshape(-1, 2 * HIDDEN).T @ d_inner.reshape(-1, ATTEND)
    d_states = d_states + d_inner @ net.attend.T
    d_entry = np.zeros((steps, n, 6 * HIDDEN), np.float32)
    grad["recur2"] = np.zeros_like(net.recur2)
    for d in (0, 1):
        back = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, z, r, new, u = keep["gates"][d][t]
            g = back + d_states[t, :, HIDDEN * d : HIDDEN * (d + 1)]
            pad = (ids[:, t] == 0)[:, None]
            live = np.where(pad, 0, g)
            d_new = live * (1 - z) * (1 - new**2)
            d_z = live * (h - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            d_entry[t, :, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            grad["recur2"][d] += h.T @ d_u
            back = np.where(pad, g, live * z + d_u @ net.recur2[d].T)
    return grad, d_entry


def window_rows(n: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words: every ``STRIDE`` words until the end is covered."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _windows(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of concatenated texts as rows of word ids, 0 as padding, and the text each belongs to."""
    offset = np.r_[0, np.cumsum(sizes)]
    starts, ends, owner = [], [], []
    for i, n in enumerate(sizes):
        if n:
            s = window_rows(int(n)) + offset[i]
            starts.append(s)
            ends.append(np.full(len(s), offset[i + 1]))
            owner.append(np.full(len(s), i))
    if not starts:
        return np.zeros((0, WINDOW), np.int32), np.zeros(0, int)
    at = np.concatenate(starts)[:, None] + np.arange(WINDOW)
    inside = at < np.concatenate(ends)[:, None]
    return np.where(inside, ids[np.minimum(at, len(ids) - 1)], 0), np.concatenate(owner)


def _first_windows(texts: list[np.ndarray], labels: np.ndarray, windows: np.ndarray, parts: list[np.ndarray]):
    """Where to begin: how typical of toxic texts the most typical piece of each window is."""
    seen = np.zeros((2, PIECE_BUCKETS))
    for ids, y in zip(texts, labels):
        if len(ids):
            seen[y, np.unique(np.concatenate([parts[i] for i in np.unique(ids)]))] += 1
    total = np.maximum(1, np.bincount(labels, minlength=2))
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    typical = np.array([0.0] + [odds[p].max() for p in parts[1:]])
    return typical[windows].max(axis=1)


def fit(texts: list[str], labels: list[int], seed: int = 0, rounds: int = 3, epochs: int = 3) -> Network:
    """Fit to whole-text labels.  In each round the best window of every toxic text stands for it; of other texts
    a few windows do, and from the second round on the one most taken for toxic."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, int)
    split = [letter_words(t) for t in texts]
    if not len(y) or y.min() == y.max() or not any(split):
        net.out[:] = 0
        net.shift[0] = 4.0 if len(y) and y.min() == 1 else -4.0
        return net
    words = list(dict.fromkeys(w for ws in split for w in ws))
    number = {w: i + 1 for i, w in enumerate(words)}
    ids = np.fromiter((number[w] for ws in split for w in ws), np.int32)
    windows, owner = _windows(ids, np.array([len(ws) for ws in split]))
    y_of = y[owner]
    flat, sizes = hashed_pieces(words, 3, 5, PIECE_BUCKETS)
    parts = [np.array([0]), *np.split(flat, np.cumsum(sizes)[:-1])]
    score = _first_windows(np.split(ids, np.cumsum([len(ws) for ws in split])[:-1]), y, windows, parts)
    word_ids = np.array([0] + [zlib.crc32(w.encode()) % WORD_BUCKETS for w in words])
    names = ["words", "pieces", "enter2", "recur2", "bias2", "attend", "query", "out", "shift"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0

    def top(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(len(values)), -values, owner))
        return order[np.r_[True, owner[order][1:] != owner[order][:-1]]]

    def learn(rows: np.ndarray) -> None:
        nonlocal step
        step += 1
        batch, local = np.unique(windows[rows], return_inverse=True)
        local = local.reshape(len(rows), WINDOW)
        if batch[0] != 0:
            batch, local = np.r_[0, batch], local + 1
        flat = np.concatenate([parts[b] for b in batch])
        sizes = np.array([len(parts[b]) for b in batch])
        ends = np.cumsum(np.r_[0, sizes])[:-1]
        x = net.words[word_ids[batch]] + np.add.reduceat(net.pieces[flat], ends, axis=0) / sizes[:, None]
        entry = np.concatenate([x @ net.enter2[d] + net.bias2[d] for d in (0, 1)], axis=1).astype(np.float32)
        keep: dict = {}
        p = _sigmoid(_forward(net, entry, local, keep))
        grad, d_entry = _backward(net, keep, local, ((p - y_of[rows]) / len(rows)).astype(np.float32))
        d_row = np.zeros((len(batch), 6 * HIDDEN), np.float32)
        np.add.at(d_row, local.T, d_entry)
        d_row[0] = 0
        half = 3 * HIDDEN
        grad["enter2"] = np.stack([x.T @ d_row[:, half * d : half * (d + 1)] for d in (0, 1)])
        grad["bias2"] = np.stack([d_row[:, half * d : half * (d + 1)].sum(axis=0) for d in (0, 1)])
        d_x = sum(d_row[:, half * d : half * (d + 1)] @ net.enter2[d].T for d in (0, 1))
        rate = 0.01
        for k in ("enter2", "recur2", "bias2", "attend", "query", "out", "shift"):
            first[k] += 0.1 * (grad[k] - first[k])
            second[k] += 0.01 * (grad[k] ** 2 - second[k])
            m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            setattr(net, k, (getattr(net, k) - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32))
        for k, where, g in (
            ("words", word_ids[batch], d_x),
            ("pieces", flat, np.repeat(d_x / sizes[:, None], sizes, axis=0)),
        ):
            at, back = np.unique(where, return_inverse=True)
            total = np.zeros((len(at), VECTOR), np.float32)
            np.add.at(total, back, g)
            second[k][at] += total**2
            getattr(net, k)[at] -= 0.05 * total / (np.sqrt(second[k][at]) + 1e-8)

    def all_scores() -> np.ndarray:
        entry = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), net.entries(words)])
        return np.concatenate([_forward(net, entry, windows[i : i + 2048]) for i in range(0, len(windows), 2048)])

    for turn in range(rounds):
        best = top(score)
        rows = best[y_of[best] == 1]
        others = np.flatnonzero(y_of == 0)
        rows = np.concatenate([rows, r.choice(others, min(len(others), 3 * FIT_DOCUMENTS), replace=False)])
        if turn:
            rows = np.concatenate([rows, best[y_of[best] == 0]])
        for _ in range(epochs):
            r.shuffle(rows)
            for i in range(0, len(rows), BATCH):
                learn(rows[i : i + BATCH])
        score = all_scores()
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, score)
    seen = np.isfinite(best)
    net.shift[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - _boundary(best[seen], y[seen])
    return net


def _boundary(best: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the fitted texts with the fewest mistakes; within a gap, a little nearer to the toxic ones."""
    order = np.argsort(best)
    b, t = best[order], y[order]
    wrong = np.r_[0, np.cumsum(t)] + np.r_[np.cumsum((1 - t)[::-1])[::-1], 0]
    at = np.flatnonzero(wrong == wrong.min())
    k = at[len(at) // 2]
    low, high = b[max(0, k - 1)], b[min(k, len(b) - 1)]
    return float(low + 0.6 * (high - low))


def score_texts(net: Network, table: WordTable, texts: list[str]) -> np.ndarray:
    """Scores in 0..1; a text without letters has no window and scores 0."""
    split = [letter_words(t) for t in texts]
    ids = table.ids([w for ws in split for w in ws])
    windows, owner = _windows(ids, np.array([len(ws) for ws in split]))
    best = np.full(len(texts), -np.inf)
    for i in range(0, len(windows), 2048):
        np.maximum.at(best, owner[i : i + 2048], _forward(net, table.rows, windows[i : i + 2048]))
    return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -60, 60))), 0.0)


def fit_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Texts and labels to fit on: at most ``FIT_DOCUMENTS`` of each class and ``FIT_CHARS`` times as many characters,
    by a hash of id and text, shorter texts first (see ``sampling.sample``).  Rows that repeat an id with other labels,
    or have a null label, are left out."""
    clean = labels.groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"))
    clean = clean.filter((F.col("y") == F.col("z")) & F.col("y").isin(0, 1)).select("k", "y")
    labelled = keyed(docs, id_col, text_col).join(clean, "k")
    return sample(docs, labelled, FIT_DOCUMENTS, FIT_CHARS, id_col, text_col)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in ``out``; null and empty texts score 0.

    Repeated rows are scored each; an empty table gives an empty result; a column called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(net)))  # a fixed size, about 3 MB
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    (text,) = unused(docs, "__text")
    plain = docs.select(*kept, F.col(text_col).cast("string").alias(text))
    schema = StructType([*[docs.schema[c] for c in kept], StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**shared.value)
        table = WordTable(6 * HIDDEN, net.entries)
        for batch in batches:
            for start, texts in chunks(batch, len(kept)):
                found = pa.array(score_texts(net, table, texts), pa.float64())
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], found], names=[*kept, out])

    return plain.mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network fitted on labelled rows that are not held out."""
    texts, ys = fit_rows(docs, labels.filter(~F.coalesce(is_held_out(id_col), F.lit(True))), id_col, text_col)
    return fit(texts, ys)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without texts that score ``THRESHOLD`` or more; all columns stay."""
    (mark,) = unused(docs, "__score")
    net = train(docs, labels, id_col, text_col)
    return score(docs, net, id_col, text_col, mark).filter(F.col(mark) < THRESHOLD).drop(mark)
