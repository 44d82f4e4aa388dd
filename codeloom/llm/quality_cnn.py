"""Quality: a convolutional network over bytes, in numpy.

Every byte has a learned vector. Windows of 16 bytes, one every 8 bytes from the first byte to
the last, meet the filters; the largest answer of each filter in a chunk of 64 windows is kept (overlapping
chunks of 520 bytes), and a text is told by the largest and the mean of its chunks' answers, which a logistic
unit combines into one probability. Training is plain backpropagation with Adam from a fixed seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from codeloom.llm.labelled import training_sample
from codeloom.llm.toxicity import _logistic, score_texts

WIDTH, STRIDE, CHUNK = 16, 8, 64
DIM, FILTERS = 8, 24
#: Labelled texts that the network is fitted on at most.
MOST_TEXTS = 2000
#: Bytes that one numpy step works on, and chunks of a text that it takes at a time.
STEP = 1 << 20
SPAN = 1024


class ByteCnn:
    def __init__(self, seed: int = 7):
        g = np.random.Generator(np.random.PCG64(seed))
        kinds = np.zeros((256, DIM))
        low, up, digit, space = range(97, 123), range(65, 91), range(48, 58), (9, 10, 32)
        for k, held in enumerate((low, up, digit, space)):
            kinds[list(held), k] = 1
        kinds[128:, 4] = 1
        kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 5] = 1
        kinds[1:, :] += g.normal(0, 0.3, (255, DIM))
        kinds[0] = 0
        self.p = {
            "e": kinds.astype(np.float32),
            "w": g.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "u": g.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    @staticmethod
    def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts, each filled up with zeros to whole strides; first bytes of windows; first windows of chunks; first chunks of texts."""
        parts, windows, chunks, docs, at, n_windows, n_chunks = [], [], [], [], 0, 0, 0
        for t in texts:
            size = max(-(-len(t) // STRIDE), 2) * STRIDE
            parts.append(t.ljust(size, b"\0"))
            n = size // STRIDE - 1
            windows.append(at + np.arange(n, dtype=np.int64))
            starts = np.arange(0, n, CHUNK, dtype=np.int64)
            chunks.append(n_windows + starts)
            docs.append(n_chunks)
            at += size // STRIDE
            n_windows += n
            n_chunks += len(starts)
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(windows), np.concatenate(chunks), np.array(docs)

    def _windows(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = self.p["e"][raw].reshape(-1, STRIDE * DIM)
        return np.concatenate([x[first], x[first + 1]], axis=1)

    def _pooled(self, texts: list[bytes]):
        raw, first, chunks, docs = self.laid_out(texts)
        x = self._windows(raw, first)
        a = x @ self.p["w"] + self.p["b"]
        z = np.maximum(np.maximum.reduceat(a, chunks, axis=0), 0)
        count = np.diff(np.append(docs, len(chunks)))
        both = np.concatenate([np.maximum.reduceat(z, docs, axis=0), np.add.reduceat(z, docs, axis=0) / count[:, None]], axis=1)
        return raw, first, chunks, docs, x, a, z, count, both

    @staticmethod
    def _pieces(texts: list[bytes]):
        """Groups of (text, piece): whole chunks at a time, as what is pooled over chunks adds up. A group has up to STEP bytes or one piece."""
        span, group, size = STRIDE * CHUNK * SPAN, [], 0
        for i, t in enumerate(texts):
            for a in range(0, max(len(t) - STRIDE, 1), span):
                piece = t[a : a + span + STRIDE]
                if group and size + len(piece) > STEP:
                    yield group
                    group, size = [], 0
                group.append((i, piece))
                size += len(piece)
        if group:
            yield group

    def pooled(self, texts: list[bytes], kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The largest and the mean answers of each text, and the number of its chunks; ``kept`` gets what the first group was told by."""
        most, total, count = np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), FILTERS)), np.zeros(len(texts), np.int64)
        for group in self._pieces(texts):
            state = self._pooled([p for _, p in group])
            if kept is not None and not kept:
                kept.append(state)
            z, docs, here, owner = state[6], state[3], state[7], [i for i, _ in group]
            np.maximum.at(most, owner, np.maximum.reduceat(z, docs, axis=0))
            np.add.at(total, owner, np.add.reduceat(z.astype(np.float64), docs, axis=0))
            np.add.at(count, owner, here)
        return np.concatenate([most, (total / np.maximum(count, 1)[:, None]).astype(np.float32)], axis=1), count

    def score(self, texts: list[str]) -> np.ndarray:
        both, _ = self.pooled([t.encode("utf-8", "surrogatepass") for t in texts])
        return _logistic(both.astype(np.float64) @ self.p["u"].astype(np.float64) + self.p["c"])

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        kept: list = []
        both, count = self.pooled(texts, kept)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        e = ((_logistic(both @ self.p["u"] + self.p["c"]) - y) * weight / len(texts)).astype(np.float32)
        grad["u"] += both.T @ e
        grad["c"] += e.sum(keepdims=True)
        for group in self._pieces(texts):
            owner = np.array([i for i, _ in group])
            state = kept.pop() if kept else self._pooled([p for _, p in group])
            self._add(grad, state, both[owner], count[owner], e[owner])
        return grad

    def _add(self, grad: dict[str, np.ndarray], state: tuple, both: np.ndarray, count: np.ndarray, e: np.ndarray) -> None:
        """Add the gradients of the chunks of ``state``; ``both``, ``count`` and the error ``e`` are of the whole texts of its pieces."""
        raw, first, chunks, docs, x, a, z, here, _ = state
        d = e[:, None] * self.p["u"][None]
        of = np.repeat(np.arange(len(docs)), here)
        dz = (d[:, FILTERS:] / count[:, None])[of]
        top = both[of, :FILTERS] == z
        dz += np.where(top, d[of, :FILTERS], 0)
        dz[z <= 0] = 0
        window_chunk = np.repeat(np.arange(len(chunks)), np.diff(np.append(chunks, len(a))))
        dw, db, de = np.zeros_like(self.p["w"]), dz.sum(axis=0), np.zeros_like(self.p["e"])
        grid = raw.reshape(-1, STRIDE)
        for f in range(FILTERS):
            hit = np.flatnonzero((a[:, f] == z[window_chunk, f]) & (dz[window_chunk, f] != 0))
            hit = hit[np.unique(window_chunk[hit], return_index=True)[1]]
            g = dz[window_chunk[hit], f]
            dw[:, f] = x[hit].T @ g
            back = (g[:, None] * self.p["w"][:, f][None]).reshape(-1, WIDTH, DIM)
            seen = np.concatenate([grid[first[hit]], grid[first[hit] + 1]], axis=1)
            for k in range(DIM):
                de[:, k] += np.bincount(seen.reshape(-1), back[:, :, k].reshape(-1), 256)
        de[0] = 0
        for k, v in (("w", dw), ("b", db), ("e", de)):
            grad[k] += v

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], epochs: int = 8, batch: int = 32, least_steps: int = 500) -> ByteCnn:
        net = cls()
        if not texts:
            return net
        encoded, y = [t.encode("utf-8", "surrogatepass") for t in texts], np.array(labels, np.float64)
        share = min(max(y.mean(), 0.02), 0.98)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        m = {k: np.zeros_like(v) for k, v in net.p.items()}
        v = {k: np.zeros_like(x) for k, x in net.p.items()}
        g, t = np.random.Generator(np.random.PCG64(11)), 0
        epochs = max(epochs, -(-least_steps * batch // len(texts)))
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = g.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                t += 1
                rate = 0.01 * (1 - 0.9 * t / total)
                for k, d in net.gradients([encoded[j] for j in pick], y[pick], weight[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return net


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", threshold: float = 0.7, most: int = MOST_TEXTS) -> DataFrame:
    """Fit on a sample of ``labels`` of at most ``most`` rows and score every row of ``docs``: (id, held_out, score, predicted).

    Texts of any length are learned and scored whole, in pieces that add up. Null counts as an empty text, which is one window
    of zeros; without a label to learn from the network is as it was drawn, and scores are still from 0 to 1. Rows that repeat
    have a row each, with equal scores; a null id is not held out. An empty table gives an empty result; other columns
    of ``docs`` are not looked at.
    """
    texts, y = training_sample(docs, labels, label, most)
    return score_texts(docs, ByteCnn.fit(texts, y), threshold)
