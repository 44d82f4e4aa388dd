"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram in the text. Its value is the ratio
r = log((p / |p|) / (q / |q|)) of its smoothed counts in texts labelled 1 and 0, and a logistic
regression with L2 regularisation weighs the values. Features are the n-grams whose counts
differ most between the labels, for their variance. They are known by 64-bit hashes: a bitmap tells
nearly all other n-grams of a text apart, and the rest are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm.labelled import held_out, training_sample
from codeloom.llm.shared import small_arrow_batches

SIZES = (3, 4, 5)
#: Labelled texts that the model is fitted on at most.
MOST_TEXTS = 3000
#: Features of each sign.
MOST_FEATURES = 6000
#: Characters that one numpy step works on.
STEP = 1 << 19
_BITS = 22
_K, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each size, a hash of the n-gram that begins at each character."""
    c = points.astype(np.uint64) * _K + np.uint64(0x632BE59BD9B4E019)
    h = c
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            return
        h = (h[: len(c) - n + 1] ^ (h[: len(c) - n + 1] >> np.uint64(29))) * _P + c[n - 1 :]
        if n in SIZES:
            yield h * _K + np.uint64(n)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class NbLinear:
    """``hashes`` (sorted), ``weights`` (with the ratio multiplied in) and ``bias`` make the model."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], steps: int = 150, l2: float = 1e-3) -> NbLinear:
        if not texts:
            return cls(np.zeros(0, np.uint64), np.zeros(0), 0.0)
        y = np.array(labels, np.float64)
        pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
        chosen, ratios = [], []
        for k in range(len(SIZES)):
            counts = []
            for want in (1, 0):
                sets = [np.unique(g[k]) for t, z in zip(texts, labels, strict=True) if z == want and len(g := list(_grams(_points(t)))) > k]
                counts.append(np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            (hp, cp), (hn, cn) = counts
            every = np.union1d(hp[cp >= 2], hn[cn >= max(5, neg // 200)])
            p, q = _lookup(every, hp, cp), _lookup(every, hn, cn)
            odds = np.log((p + 0.5) / (pos - p + 0.5)) - np.log((q + 0.5) / (neg - q + 0.5))
            z = odds / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
            order = np.argsort(z, kind="stable")
            top = np.unique(np.concatenate([order[: MOST_FEATURES // len(SIZES)], order[-MOST_FEATURES // len(SIZES) :]]))
            chosen.append(every[top])
            ratios.append(np.log((p[top] + 1) / (p + 1).sum()) - np.log((q[top] + 1) / (q + 1).sum()))
        hashes, first = np.unique(np.concatenate(chosen), return_index=True)
        r = np.concatenate(ratios)[first]
        model = cls(hashes, np.zeros(len(hashes)), 0.0)
        rows, cols = model.present(texts)
        x = r[cols]
        w, b = np.zeros(len(hashes)), float(np.log(pos / neg))
        m = np.zeros(len(w) + 1)
        v = np.zeros(len(w) + 1)
        for t in range(1, steps + 1):  # Adam over all texts at once: the loss is convex and the data are few
            e = _logistic(np.bincount(rows, x * w[cols], len(texts)) + b) - y
            g = np.append(np.bincount(cols, x * e[rows], len(w)) / len(texts) + l2 * w, e.mean())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        return cls(hashes, w * r, float(b))

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of each feature that is somewhere in a text, once."""
        found: list[np.ndarray] = []
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not held:
                return
            points, text = np.concatenate(held), np.concatenate(owner)
            for n, h in zip(SIZES, _grams(points), strict=False):
                spot = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                spot = spot[text[spot] == text[spot + n - 1]]
                at = np.minimum(np.searchsorted(self.hashes, h[spot]), len(self.hashes) - 1)
                same = self.hashes[at] == h[spot] if len(self.hashes) else np.zeros(len(spot), bool)
                found.append(np.unique((text[spot[same]] // 2).astype(np.int64) << 32 | at[same]))
            held.clear()
            owner.clear()
            size = 0

        for i, t in enumerate(texts):
            points = _points(t)
            # Parts of a long text overlap; the parity keeps n-grams from crossing into the next part.
            for part, a in enumerate(range(0, max(len(points), 1), STEP)):
                piece = points[a : a + STEP + max(SIZES) - 1]
                held.append(piece)
                owner.append(np.full(len(piece), 2 * i + part % 2, np.int64))
                size += len(piece)
                if size >= STEP:
                    flush()
        flush()
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return keys >> 32, keys & 0xFFFFFFFF

    def score(self, texts: list[str]) -> np.ndarray:
        rows, cols = self.present(texts)
        return _logistic(np.bincount(rows, self.weights[cols], len(texts)) + self.bias)


def _lookup(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0).astype(np.float64)


def score_texts(docs: DataFrame, model, threshold: float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row; null counts as an empty text, which has the score of the bias."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), held_out(id_col).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", threshold: float = 0.3, most: int = MOST_TEXTS) -> DataFrame:
    """Fit on a sample of ``labels`` of at most ``most`` rows and score every row of ``docs``: (id, held_out, score, predicted).

    Texts of any length are scored whole, in steps; null and empty ones, and all where there is no label to learn from, have
    the score of the bias, which then is one half. Rows that repeat have a row each, with equal scores; a null id is
    not held out. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    texts, y = training_sample(docs, labels, label, most)
    return score_texts(docs, NbLinear.fit(texts, y), threshold)
