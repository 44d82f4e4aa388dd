"""Benchmark decontamination: Wu-Manber multi-pattern search over the words of every text.

Patterns are runs of ``window`` words of a benchmark item, or the whole item where
it has fewer. The alphabet is words instead of characters, and a block is two
neighbouring words (one, for patterns of one word). For all patterns of one length m:

* the shift table gives, by the hash of the block that ends at the position
  looked at, how far the search may move: m - block + 1 where no pattern has such a
  block, else its distance from the end of the nearest pattern;
* a shift of 0 leads to the bucket of the patterns that end in that block (suffix
  hash), and those are compared with the text word by word, byte by byte.

The search runs over many stretches of the batch in step, each with its own position,
so that numpy does the shifting. A stretch is a part of one text, and
overlaps the next one by m - 1 words, so no occurrence is missed.

Items go to the tasks in portions of bounded size. One portion is one pass over the texts; a
benchmark of several has a pass for each, whose hits are put together by the hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textkit as K
from codeloom.llm.shared import small_arrow_batches, stash

#: Positions at which a stretch may end a pattern.
STRETCH = 512
#: UTF-8 bytes of the items of one pass; the tables of a task are about thirty times that.
PASS_BYTES = 8 << 20

NEW = ("n_words", "n_hit", "items", "contaminated")
Items = list[tuple[str, str]]


class Words:
    """The words of a column of texts: lower-cased bytes, starts and ends in them, hashes, and where each text's words begin."""

    def __init__(self, column: pa.Array):
        raw, bounds = K.buffer_of(column)
        self.start, self.end, self.hash, self.at = K.words_of(raw, bounds, K.ALNUM)
        self.low = K.LOWER[raw]

    def equal(self, first: np.ndarray, other: Words, first_other: np.ndarray, m: int) -> np.ndarray:
        """Whether the m words from ``first`` are those of ``other`` from ``first_other``, compared directly."""
        same = np.ones(len(first), bool)
        for k in range(m):
            i, j = first[same] + k, first_other[same] + k
            size = self.end[i] - self.start[i]
            fits = size == other.end[j] - other.start[j]
            i, j, size = i[fits], j[fits], size[fits]
            ahead = np.cumsum(size) - size
            inner = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(ahead, size)
            bytes_ = self.low[np.repeat(self.start[i], size) + inner] == other.low[np.repeat(other.start[j], size) + inner]
            if len(size):
                fits[fits] = np.logical_and.reduceat(bytes_, ahead)
            same[same] = fits
        return same


class WuManber:
    """The tables for the patterns of ``m`` words that begin at ``first`` in the words of the items; ``items`` are those that hold them."""

    def __init__(self, m: int, words: Words, first: np.ndarray, items: np.ndarray):
        self.m, self.block, self.words = m, min(2, m), words
        whole = K.shingle_hashes(words.hash, m) if len(words.hash) >= m else np.zeros(0, np.uint64)
        order = np.lexsort((first, whole[first]))
        first, items = first[order], items[order]
        # Equal patterns are one, with all their items: neighbours in this order that agree in every byte.
        fresh = np.ones(len(first), bool)
        fresh[1:] = whole[first[1:]] != whole[first[:-1]]
        again = np.flatnonzero(~fresh)
        fresh[again] = ~words.equal(first[again - 1], words, first[again], m)
        kind = np.cumsum(fresh) - 1
        first, self.held, self.item = first[fresh], np.searchsorted(kind, np.arange(kind[-1] + 2)), items
        blocks = self.blocks(words.hash)
        suffix = blocks[first + m - self.block]
        by_suffix = np.argsort(suffix, kind="stable")
        self.suffix, self.first, self.kind = suffix[by_suffix], first[by_suffix], by_suffix
        bits = min(max(int(4 * len(first) * (m - self.block + 1)).bit_length(), 10), 24)
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int32)
        for k in range(m - self.block + 1):  # from the farthest block to the last: nearer ones replace farther ones
            self.shift[(blocks[first + k] >> self.down).astype(np.int64)] = m - self.block - k

    def blocks(self, h: np.ndarray) -> np.ndarray:
        """For each word that begins a full block, the hash of the block."""
        return K.mix(h[:-1] * K.BASE + h[1:]) if self.block == 2 else h

    def ends(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words at which a pattern may end, by shift table and suffix hash, and the hashes of the blocks there."""
        first = at[:-1] + self.m - 1
        n = np.maximum(at[1:] - first, 0)
        parts = -(-n // STRETCH)
        text = np.repeat(np.arange(len(n)), parts)
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        pos = first[text] + k * STRETCH
        stop = np.minimum(pos + STRETCH, at[1:][text])
        blocks = self.blocks(h)
        spots = (blocks >> self.down).astype(np.int32)
        found = []
        while len(pos):
            step = self.shift[spots[pos - self.block + 1]]
            hit = pos[step == 0]
            if len(hit):
                b = blocks[hit - self.block + 1]
                found.append(hit[self.suffix[np.minimum(np.searchsorted(self.suffix, b), len(self.suffix) - 1)] == b])
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        ends = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return ends, blocks[ends - self.block + 1]

    def occurrences(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word in the text, pattern) of all occurrences."""
        ends, b = self.ends(text.hash, text.at)
        low, high = np.searchsorted(self.suffix, b, "left"), np.searchsorted(self.suffix, b, "right")
        count = high - low
        place = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(ends, count) - self.m + 1
        near = text.hash[first] == self.words.hash[self.first[place]]
        first, place = first[near], place[near]
        same = text.equal(first, self.words, self.first[place], self.m)
        return first[same], self.kind[place[same]]

    def items_of(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``kinds``, item) of all items that hold the patterns."""
        count = self.held[kinds + 1] - self.held[kinds]
        of = np.repeat(np.arange(len(kinds)), count)
        return of, self.item[np.repeat(self.held[kinds], count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)]


def build(texts: list[str | None], window: int) -> list[WuManber]:
    """A searcher for each length of pattern; items are known by their numbers."""
    words = Words(pa.array(texts, pa.large_string()))
    size = np.diff(words.at)
    m = np.minimum(size, window)
    out = []
    for length in np.unique(m[m > 0]):
        chosen = np.flatnonzero(m == length)
        count = size[chosen] - length + 1
        item = np.repeat(chosen, count)
        first = words.at[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        out.append(WuManber(int(length), words, first, item))
    return out


def search(column: pa.Array, searchers: list[WuManber]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of each text begin; which words are hit; the (text, item) pairs, each once."""
    text = Words(column)
    change = np.zeros(len(text.hash) + 1, np.int64)
    pairs = [np.zeros((2, 0), np.int64)]
    for s in searchers:
        first, kinds = s.occurrences(text)
        np.add.at(change, first, 1)
        np.add.at(change, first + s.m, -1)
        of = np.searchsorted(text.at, first, "right") - 1
        once = np.unique(np.stack([of, kinds]), axis=1)
        index, items = s.items_of(once[1])
        pairs.append(np.stack([once[0][index], items]))
    return text.at, np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(pairs, axis=1), axis=1)


def _counts(at: np.ndarray, hit: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[at[1:]] - total[at[:-1]]


def _portions(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[Items]:
    """The items (id, text) in order, in portions of at most ``most`` bytes or one item."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator()
    portion: Items = []
    size = 0
    for row in rows:
        n = len(row["t"].encode("utf-8", "surrogatepass"))
        if portion and size + n > most:
            yield portion
            portion, size = [], 0
        portion.append((row["i"], row["t"]))
        size += n
    yield portion


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Add n_words, n_hit, items (sorted as strings) and contaminated to each row of ``docs``.

    A word is hit inside any occurrence of a pattern; a text is contaminated when
    ``share * n_hit >= n_words`` and n_hit > 0. Null texts have no words, null or empty items
    no patterns; items that repeat count once, items of one id together. Texts are searched whole, whatever their length;
    rows that repeat have equal results. An empty table gives an empty result. Columns of ``docs`` named like a new one
    give way to it. Items are read and sent in portions of ``pass_bytes``, each a pass over ``docs``.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    kept = [c for c in docs.columns if c not in NEW]
    rows = docs.select(*[f"`{c}`" for c in kept])
    portions = _portions(benchmark, item_col, item_text_col, pass_bytes)
    portion, after = next(portions), next(portions, None)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "n_words long, n_hit long, items array<string>, contaminated boolean"])

    def result(batch: pa.RecordBatch, columns: list[pa.Array], n_words: np.ndarray, n_hit: np.ndarray, listed: list[list[str]]) -> pa.RecordBatch:
        bad = (n_hit > 0) & (share * n_hit >= n_words)
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(bad, pa.bool_())], names=[*kept, *NEW])

    if after is None:
        sent, spot = spark.sparkContext.broadcast(portion), kept.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [i for i, _ in sent.value]
            searchers = build([t for _, t in sent.value], window)
            for batch in batches:
                at, hit, pairs = search(batch.column(spot), searchers)
                found: list[set[str]] = [set() for _ in range(batch.num_rows)]
                for text, item in pairs.T.tolist():
                    found[text].add(names[item])
                yield result(batch, batch.columns, np.diff(at), _counts(at, hit), [sorted(x) for x in found])

        return rows.mapInArrow(run, schema)

    texts = rows.select(F.md5(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    hits = None
    while portion:
        one = stash(texts.mapInArrow(_found_in(spark.sparkContext.broadcast(portion), window), "key string, spans array<long>, items array<string>").dropDuplicates(["key"]), "hits", small=True)
        hits = one if hits is None else hits.unionByName(one)
        portion, after = after, next(portions, None) if after else None
    together = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    met = rows.withColumn("_key", F.md5(F.col(text_col))).join(together.withColumnRenamed("key", "_key"), "_key", "left").select(*[f"`{c}`" for c in kept], F.col(text_col).alias("_text"), "_spans", "_items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans, items = batch.columns[-3:]
            at = Words(text).at
            change = np.zeros(int(at[-1]) + 1, np.int64)
            for start, found in zip(at[:-1].tolist(), spans.to_pylist(), strict=True):
                for a, b in zip((found or [])[::2], (found or [])[1::2], strict=True):
                    change[start + a] += 1
                    change[start + b] -= 1
            yield result(batch, batch.columns[:-3], np.diff(at), _counts(at, np.cumsum(change[:-1]) > 0), [x or [] for x in items.to_pylist()])

    return met.mapInArrow(finish, schema)


def _found_in(sent, window: int):
    """Rows (key, spans, items) of texts with an occurrence: words hit, as starts and ends in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [i for i, _ in sent.value]
        searchers = build([t for _, t in sent.value], window)
        for batch in batches:
            at, hit, pairs = search(batch.column(1), searchers)
            found: dict[int, set[str]] = {}
            for text, item in pairs.T.tolist():
                found.setdefault(text, set()).add(names[item])
            spans = [np.flatnonzero(np.diff(np.concatenate([[0], hit[at[t] : at[t + 1]].astype(np.int8), [0]]))).tolist() for t in found]
            keys = batch.column(0).take(pa.array(list(found), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in found.values()], pa.list_(pa.string()))], names=["key", "spans", "items"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows, with its own columns, whatever their names."""
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    out = benchmark_hits(plain, benchmark, text_col=f"_c{docs.columns.index(text_col)}", **options)
    return out.where("not contaminated").select(*plain.columns).toDF(*docs.columns)
