"""Whole batches of texts as one byte buffer: words and their hashes by numpy, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that one numpy step works on; longer stretches are cut where no word is.
STEP = 1 << 20

_U = np.uint64


def _random_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64, endpoint=False)


BYTE_VALUES = _random_words(101, 256)
BASE = _U(0x9E3779B97F4A7C15)

#: ASCII upper case to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Which bytes are part of a word.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer with good avalanche (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and ends. Null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _cuts(raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> list[int]:
    """Places to cut the buffer at: the ends of texts, or blanks within long texts."""
    cuts, at, end = [0], 0, len(raw)
    while at < end:
        to = min(at + STEP, end)
        if to < end:
            k = int(np.searchsorted(bounds, to, "right")) - 1
            if bounds[k] > at:
                to = int(bounds[k])
            else:
                limit = int(bounds[k + 1])
                while to < limit and kind[raw[to]]:
                    to += 1
        cuts.append(to)
        at = to
    return cuts


def words_of(raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of the buffer, lower-cased, and where the words of each text begin and end."""
    starts, ends, hashes = [], [], []
    cuts = _cuts(raw, bounds, kind)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        piece = raw[a:b]
        inside = kind[piece]
        inner = bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b, "left")] - a
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[inner] = False
        s = np.flatnonzero(inside & ~before)
        if not len(s):
            continue
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[inner - 1] = False
        e = np.flatnonzero(inside & ~after) + 1
        size = e - s
        held = np.flatnonzero(inside)
        first = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=first[1:])
        place = np.arange(len(held), dtype=np.int64) - np.repeat(first, size)
        powers = np.empty(int(size.max()), np.uint64)
        powers[0] = 1
        powers[1:] = BASE
        np.multiply.accumulate(powers, out=powers)
        value = BYTE_VALUES[LOWER[piece[held]]] * powers[place]
        hashes.append(mix(np.add.reduceat(value, first) + size.astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(bounds), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, bounds, "left")


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; of all words where there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = words[: len(words) - n + 1]
    for k in range(1, n):
        h = mix(h * BASE + words[k : len(words) - n + 1 + k])
    return mix(h + _U(n))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
