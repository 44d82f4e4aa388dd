"""Similarity self-join of texts by the Jaccard coefficient of their word n-grams.

The method is a size-aware heavy-light join. Both halves rest on one fact: if the
tokens of all sets are put in one order, two sets with an overlap of at least ``o``
share ``k`` tokens among the first ``|set| - o + k`` of each.

* Small sets enumerate the 2-subsets of that prefix (k = 2) as signatures: a
  match needs two tokens in common, so frequent tokens seldom meet by chance.
* Large sets post each prefix token (k = 1) to its inverted list, where small sets
  that are still large enough to match a large one are posted too.
* The boundary is the size at which the estimated cost (postings written plus
  expected list entries) over both halves is least, from exact per-size totals.

The order goes by an upper bound of the number of texts that hold a token: its own
counter or that of its rarest word, whichever is less. Both are counted over all
texts in a sketch whose size follows the texts up to a bound; it and a filter of bounded size are all that is broadcast.

Long lists are never expanded into all pairs. Each list has a pivot, its member with
the fewest rarer tokens, and lists with one pivot merge. Members are first verified
against the pivot only; components of those links leave few members apart, and only
these meet the rest of their list, which is split by further tokens if it is long. Pairs are dropped before their sets are fetched if
the parity bitmaps of the two sets differ in more bits than a match allows, which
no match can. Every link that could join two components is therefore verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import textkit as K
from codeloom.llm.components import connected_components
from codeloom.llm.shared import second_key, small_arrow_batches, stash

#: Longs of the parity bitmap.
BITMAP = 8
#: The sketch goes through shuffles in so many pieces.
PIECES = 64
#: Word counters are about one for so many bytes of text, from 2**20 to 2**22, with four times as many for tokens: 21 to 84 MB are broadcast.
SKETCH_BYTES = 4096
LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 20, 22
#: The filter of wanted texts has at least 8 bits for each, up to 2**28 bits: 32 MB are broadcast.
MOST_FILTER_BITS = 28
#: Sizes above this are large without asking for the cost: their subsets would be too many.
MOST_SMALL = 64


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    raw, bounds = K.buffer_of(column)
    _, _, words, at = K.words_of(raw, bounds, K.NOT_BLANK)
    for a, b in zip(at, at[1:], strict=False):
        yield words[a:b]


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for words in _words(column):
        yield np.unique(K.shingle_hashes(words, n))


def _rarest(loads: np.ndarray, n: int) -> np.ndarray:
    """For each run of ``n`` words the least of their loads, which bounds how many texts hold the run."""
    n = min(n, len(loads))
    out = loads[: len(loads) - n + 1]
    for k in range(1, n):
        out = np.minimum(out, loads[k : len(loads) - n + 1 + k])
    return out


def _fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of the set; with the size, what tells classes of equal sets apart."""
    one = K.mix(tokens).sum(dtype=np.uint64)
    two = K.mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _class_key(tokens: np.ndarray) -> str:
    h1, h2 = _fingerprint(tokens)
    return f"{h1},{h2},{len(tokens)}"


def _counters(bits: int) -> int:
    return (1 << bits) + (4 << bits)


def _word_slot(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def _token_slot(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(62 - bits)).astype(np.int64) + (1 << bits)


def _packed(counts: np.ndarray) -> bytes:
    """Counters of a piece: a byte each where that is enough, as it is in most tasks."""
    return (counts.astype(np.uint8) if counts.max(initial=0) < 256 else counts).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == size else np.uint32)


def _count(ngram: int, bits: int):
    """Rows (id, n, h1, h2), and at the end of a task the pieces of its word counters (piece, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_counters(bits), np.uint32)
        seen: set[tuple[int, int, int]] = set()
        ids = None
        for batch in batches:
            ids = batch.column(0)
            rows = []
            for words in _words(batch.column(1)):
                tokens = np.unique(K.shingle_hashes(words, ngram))
                key = (len(tokens), *_fingerprint(tokens))
                rows.append(key)
                if key not in seen and len(tokens):
                    seen.add(key)
                    np.add.at(counts, _word_slot(np.unique(words), bits), 1)
                    np.add.at(counts, _token_slot(tokens, bits), 1)
            n, h1, h2 = zip(*rows, strict=True) if rows else ((), (), ())
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())],
                names=["id", "n", "h1", "h2", "piece", "counts"],
            )
        if ids is not None and counts.any():
            pieces = counts.reshape(PIECES, -1)
            none = pa.nulls(PIECES)
            yield pa.RecordBatch.from_arrays(
                [none.cast(ids.type), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(range(PIECES), pa.int32()), pa.array([_packed(p) for p in pieces], pa.binary())],
                names=["id", "n", "h1", "h2", "piece", "counts"],
            )

    return run


def _sum_pieces(bits: int):
    size = _counters(bits) // PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = _unpacked(counts.as_py(), size).astype(np.float64)
                total[piece] = total[piece] + part if piece in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["piece", "counts"])

    return run


def _prefixes(ngram: int, percent: int, bits: int, sketch):
    """Rows (id, n, h1, h2, bitmap, prefix, load) of the sets that can match a different one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = sketch.value
        usual = float(loads[1 << bits :].mean())
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            rows = []
            for i, words in enumerate(_words(batch.column(1))):
                tokens, first = np.unique(K.shingle_hashes(words, ngram), return_index=True)
                n = len(tokens)
                if n * (100 - percent) < percent:
                    continue
                key = (n, *_fingerprint(tokens))
                if key in seen:
                    continue
                seen.add(key)
                own = loads[_token_slot(tokens, bits)]
                load = np.minimum(_rarest(loads[_word_slot(words, bits)], ngram)[first], own)
                order = np.lexsort((tokens, load))[: n - (percent * n + 99) // 100 + 2]
                parity = np.packbits(np.bincount((tokens & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1).view(np.int64)
                rows.append((i, *key, parity, K.signed(tokens[order]), float(np.maximum(np.minimum(load, own - usual)[order] - 1, 0).sum())))
            if rows:
                i, n, h1, h2, parity, prefix, load = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i, pa.int64())), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64())), pa.array(load, pa.float64())],
                    names=["id", "n", "h1", "h2", "bitmap", "prefix", "load"],
                )

    return run


def _texts_of(ngram: int, wanted):
    """Rows (h, packed) of the texts whose id may be wanted; packed texts are about a third of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[str] = set()
        for batch in batches:
            spot = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
            if not len(keep):
                continue
            texts = batch.column(1).take(pa.array(keep))
            raw, bounds = K.buffer_of(texts)
            h, packed = [], []
            for tokens, a, b in zip(_sets(texts, ngram), bounds, bounds[1:], strict=False):
                key = _class_key(tokens)
                if key in seen:
                    continue
                seen.add(key)
                h.append(key)
                packed.append(int(b - a).to_bytes(8, "little") + pa.compress(raw[a:b].tobytes(), codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(packed, pa.binary())], names=["h", "packed"])

    return run


def _overlaps(ngram: int):
    """Rows (a, b, i, u) of pairs of packed texts: sizes of the intersection and the union of their whole sets.

    A text that several pairs of a batch share is unpacked once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *sides = batch.columns
            ha, ta, hb, tb = (c.to_pylist() if k % 2 == 0 else c for k, c in enumerate(sides))
            place: dict[str, int] = {}
            parts = []
            for keys, column in ((ha, ta), (hb, tb)):
                for key, value in zip(keys, column, strict=True):
                    if key not in place:
                        place[key] = len(parts)
                        data = value.as_buffer()
                        parts.append(pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), codec="zstd"))
            raw = np.concatenate([np.frombuffer(x, np.uint8) for x in parts]) if parts else np.zeros(0, np.uint8)
            _, _, words, at = K.words_of(raw, np.cumsum([0, *(x.size for x in parts)]), K.NOT_BLANK)
            sets = [np.unique(K.shingle_hashes(words[x:y], ngram)) for x, y in zip(at, at[1:], strict=False)]
            pairs = [(sets[place[x]], sets[place[y]]) for x, y in zip(ha, hb, strict=True)]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs]
            union = [len(x) + len(y) - i for (x, y), i in zip(pairs, common, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "i", "u"])

    return run


def _spots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            spot = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            np.bitwise_or.at(found, spot >> 3, np.uint8(1) << (spot & 7).astype(np.uint8))
        pieces = found.reshape(PIECES, -1)
        some = [k for k in range(PIECES) if pieces[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pieces[k].tobytes() for k in some], pa.binary())], names=["piece", "counts"])

    return run


def _or_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(found.as_buffer(), np.uint8)
            total[piece] = total[piece] | part if piece in total else part.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "counts"])


PIECE_SCHEMA = "piece int, counts binary"


def _gathered(df: DataFrame, add, kind: type, size: int) -> np.ndarray:
    """The sum of all tasks' pieces: a table of fixed size, whatever the corpus."""
    summed = df.repartition(PIECES, "piece").mapInArrow(add, PIECE_SCHEMA)
    out = np.zeros((PIECES, size // PIECES), kind)
    for row in summed.collect():
        out[row["piece"]] = np.frombuffer(row["counts"], kind)
    return out.reshape(-1)


def cheapest_boundary(rows: list[tuple[int, int, float]], percent: int) -> int:
    """The largest size to enumerate subsets for, given (size, sets, expected list entries) for each size.

    A subset signature costs one posting, an inverted list one posting and its
    expected other entries. Small sets within reach of the boundary pay for both.
    """

    def prefix(n: int) -> int:
        return n - (percent * n + 99) // 100 + 1

    def cost(x: int) -> float:
        total = 0.0
        for n, sets, load in rows:
            q = prefix(n)
            if n <= x:
                total += sets * (q + 1) * q / 2
            if 100 * n >= percent * (x + 1):
                total += sets * q + load
        return total

    return min([0, *(n for n, _, _ in rows if n <= MOST_SMALL)], key=lambda x: (cost(x), x))


class JaccardJoin:
    """The join over ``docs``; ``components`` and ``pairs`` are its results.

    ``percent``: two sets link when 100 * intersection >= percent * union. Texts
    without words, null ones included, have empty sets and link with nothing; texts of any length are taken whole. Rows that
    repeat, and rows with a null id, count as documents of their own with that id. An empty table gives empty results; other
    columns are not looked at. ``refine_above``: lists are split by further tokens beyond so many pairs to look at.
    """

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80, sketch_bits: int | None = None, refine_above: int = 1 << 16):
        if not 50 <= percent <= 99 or ngram < 1:
            raise ValueError("percent must be in 50..99 and ngram positive")
        self.spark = docs.sparkSession
        small_arrow_batches(self.spark)
        self.percent, self.ngram, self.refine_above = percent, ngram, refine_above
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.id_type = self.docs.schema["id"].dataType
        kind = self.id_type.simpleString()
        if sketch_bits is None:
            size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            sketch_bits = min(max((size // SKETCH_BYTES).bit_length(), LEAST_SKETCH_BITS), MOST_SKETCH_BITS)

        counted = stash(self.docs.mapInArrow(_count(ngram, sketch_bits), f"id {kind}, n int, h1 long, h2 long, {PIECE_SCHEMA}"), "shingles")
        self.rows = counted.where("piece is null").select("id", "n", "h1", "h2")
        loads = _gathered(counted.where("piece is not null").select("piece", "counts"), _sum_pieces(sketch_bits), np.float32, _counters(sketch_bits))
        sketch = self.spark.sparkContext.broadcast(loads)
        self.sets = stash(
            self.docs.mapInArrow(_prefixes(ngram, percent, sketch_bits, sketch), f"id {kind}, n int, h1 long, h2 long, bitmap array<long>, prefix array<long>, load double").withColumn("uid", F.monotonically_increasing_id()),
            "prefixes",
        )
        sketch.unpersist()  # the workers need not keep it
        # Copies in different tasks give a set more than one uid; the smallest stands for the class.
        self.classes = stash(self.sets.groupBy("h1", "h2", "n").agg(F.min("uid").alias("uid"), F.min_by("id", "uid").alias("id"), F.min_by("bitmap", "uid").alias("bitmap")), "classes")
        self.groups = stash(self._groups(), "lists")

    def _signatures(self) -> DataFrame:
        """(sig, uid, pos): subsets of small sets, prefix tokens of large ones and of those near the boundary."""
        p = self.percent
        sizes = self.sets.where(f"n <= {2 * MOST_SMALL}").groupBy("n").agg(F.count("*").alias("sets"), F.sum("load").alias("load")).collect()
        self.boundary = x = cheapest_boundary([tuple(r) for r in sizes], p)
        ordered = self.sets.select("uid", "n", "prefix")
        single = F.expr("slice(prefix, 1, size(prefix) - 1)")
        lists = ordered.where(f"n > {x} or 100 * n >= {p * (x + 1)}").select("uid", F.posexplode(single).alias("pos", "sig"))
        if not x:
            return lists
        pairs = F.expr("flatten(transform(slice(prefix, 1, size(prefix) - 1), (t, i) -> transform(slice(prefix, i + 2, size(prefix)), u -> xxhash64(t, u))))")
        subsets = ordered.where(f"n <= {x}").select("uid", F.posexplode(pairs).alias("pos", "sig"))
        return lists.unionByName(subsets)

    def _groups(self) -> DataFrame:
        """(g, x): each pivot with the members of its lists, as classes; the pivot is a member too."""
        posted = self._signatures()
        # One long for the smallest (pos, uid): row numbers stay under 2**53 up to a million tasks, and a late position is as good as another.
        rank = F.shiftleft(F.least("pos", F.lit(1023)).cast("long"), 53).bitwiseOR(F.col("uid"))
        side = F.col("sig") < 0
        stats = posted.groupBy("sig").agg(F.count("*").alias("members"), F.min(rank).alias("first"))
        stats = stats.where("members > 1").select("sig", F.col("first").bitwiseAND(F.lit((1 << 53) - 1)).alias("g"), side.alias("k"))
        met = posted.withColumn("k", side).join(stats, ["sig", "k"]).select("g", F.col("uid").alias("x")).distinct()
        same = self.sets.groupBy("h1", "h2", "n").agg(F.count("*").alias("c"), F.min("uid").alias("first"), F.collect_set("uid").alias("uids"))
        # A class is collected only over the tasks that saw it, not over its copies.
        same = same.where("c > 1").select(F.explode("uids").alias("uid"), "first").where("uid <> first")
        for side in ("g", "x"):
            other = same.select(F.col("uid").alias("_u"), F.col("first").alias("_f"))
            met = met.join(other, met[side] == other["_u"], "left").withColumn(side, F.coalesce("_f", side)).drop("_u", "_f")
        return met.distinct()

    def _may_link(self, a: str, b: str) -> Column:
        """No pair within the threshold fails this: sizes, and bits of the bitmaps that differ."""
        p = self.percent
        na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
        bits = sum((F.bit_count(F.col(f"{a}.bitmap")[k].bitwiseXOR(F.col(f"{b}.bitmap")[k])) for k in range(BITMAP)), F.lit(0))
        near = (F.lit(100) * F.least(na, nb) >= F.lit(p) * F.greatest(na, nb)) & (bits * F.lit(100 + p) <= F.lit(100 - p) * (na + nb))
        return near

    def _seen(self) -> DataFrame:
        key = F.concat_ws(",", "h1", "h2", "n")
        return self.classes.select("uid", F.struct("n", "bitmap", "id", key.alias("h")).alias("s"))

    def _with(self, pairs: DataFrame, column: str, name: str) -> DataFrame:
        info = self._seen().select(F.col("uid").alias(f"_{name}"), F.col("s").alias(name))
        return pairs.join(info, pairs[column] == info[f"_{name}"]).drop(f"_{name}")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of classes, with what is known of them (p, q), that link by their whole sets."""
        pairs = pairs.where("a <> b").select("a", "b", F.col("p.h").alias("ha"), F.col("q.h").alias("hb"), F.col("p.id").alias("ia"), F.col("q.id").alias("ib"))
        pairs = stash(pairs.dropDuplicates(["a", "b"]), "candidates", small=True)
        width = min(max((16 * pairs.count()).bit_length(), 16), MOST_FILTER_BITS)
        spot = F.pmod(F.xxhash64("id"), F.lit(1 << width))
        ids = pairs.select(F.col("ia").alias("id")).union(pairs.select("ib"))
        marked = ids.select(spot.alias("spot")).mapInArrow(_spots(1 << width), PIECE_SCHEMA)
        bits = self.spark.sparkContext.broadcast(_gathered(marked, _or_pieces, np.uint8, 1 << (width - 3)))
        # The filter only spares work: texts that pass it by chance drop out in the join.
        texts = stash(self.docs.select(spot.alias("spot"), "text").mapInArrow(_texts_of(self.ngram, bits), "h string, packed binary"), "texts")
        bits.unpersist()
        first = texts.select(F.col("h").alias("hb"), F.col("packed").alias("tb"))
        other = texts.select(F.col("h").alias("ha"), F.col("packed").alias("ta"))
        both = pairs.select("a", "b", "ha", "hb").join(first, "hb").join(other, "ha").select("a", "b", "ha", "ta", "hb", "tb")
        counted = both.mapInArrow(_overlaps(self.ngram), "a long, b long, i long, u long")
        return counted.where(f"100 * i >= {self.percent} * u").distinct()

    def _once(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, p, q) that may link, with the smaller side first."""
        swap = F.col("a") > F.col("b")
        named = {k: F.when(swap, F.col(v)).otherwise(F.col(k)).alias(k) for k, v in (("a", "b"), ("b", "a"), ("p", "q"), ("q", "p"))}
        return pairs.where(self._may_link("p", "q")).select(*named.values())

    def _roots(self, links: DataFrame, groups: DataFrame) -> DataFrame:
        """groups with the component of the member (cx) and of the pivot (cg), without groups that are in one."""
        roots = connected_components(links)
        for side in ("x", "g"):
            step = roots.select(F.col("v").alias("_v"), F.col("r").alias("_r"))
            groups = groups.join(step, groups[side] == step["_v"], "left").withColumn(f"c{side}", F.coalesce("_r", side)).drop("_v", "_r")
        return stash(groups, "colored", small=True)

    def _link_rounds(self) -> DataFrame:
        """Links that make the components; not all links within them."""
        star = self._with(self._with(self.groups.where("g <> x").select(F.col("g").alias("a"), F.col("x").alias("b")), "a", "p"), "b", "q")
        links = stash(self._verified(self._once(star)).select("a", "b"), "links", small=True)
        colored = self._roots(links, self.groups)
        apart = colored.where("cx <> cg")
        # A second pivot: the member outside the first one's component whose bitmap has most company there is not known, so the one of least id stands in.
        second = apart.groupBy("g").agg(F.min("x").alias("y"), F.count("*").alias("members")).where("members > 8").select("g", "y", second_key(F.col("g")).alias("k"))
        again = colored.withColumn("k", second_key(F.col("g"))).join(second, ["g", "k"]).where("x <> y").select(F.col("y").alias("a"), F.col("x").alias("b"))
        again = self._with(self._with(again.distinct(), "a", "p"), "b", "q")
        links = stash(links.unionByName(self._verified(self._once(again)).select("a", "b")), "links", small=True)
        colored = self._roots(links, self.groups)
        return stash(links.unionByName(self._verified(self._once(self._rest(colored))).select("a", "b")), "links", small=True)

    def _rest(self, colored: DataFrame) -> DataFrame:
        """Pairs (a, p, b, q) of members outside their pivot's component with other members of the list, of another component.

        In a long list of texts that do not link, that would be all pairs. Sets that link share at least two of
        the tokens kept of them, so such a list is split by these tokens, but for the one that most of its members
        have: they still meet in one of the others, which far fewer share.
        """
        counts = colored.groupBy("g").agg(F.count_if(F.col("cx") != F.col("cg")).alias("apart"), F.count("*").alias("members")).where("apart > 0")
        mixed = stash(counts.select("g", (F.col("apart") * F.col("members") > self.refine_above).alias("long")), "mixed", small=True)
        short = colored.join(mixed.where("not long").select("g"), "g", "left_semi").withColumn("t", F.lit(0).cast("long"))
        tokens = colored.join(mixed.where("long").select("g"), "g", "left_semi").join(self.sets.select(F.col("uid").alias("x"), "prefix"), "x")
        tokens = stash(tokens.select("g", "x", "cx", "cg", F.explode("prefix").alias("t")), "tokens", small=True)
        held = tokens.groupBy("g", "t").agg(F.count("*").alias("members"), F.count_if(F.col("cx") != F.col("cg")).alias("apart"))
        usual = held.groupBy("g").agg(F.max(F.struct("members", "t"))["t"].alias("t"))
        lists = held.where("members > 1 and apart > 0").join(usual, ["g", "t"], "left_anti").select("g", "t")
        members = short.unionByName(tokens.join(lists, ["g", "t"], "left_semi").select(*short.columns))
        key = second_key(F.col("g")).alias("k")
        left = self._with(members.where("cx <> cg"), "x", "p").select("g", "t", F.col("x").alias("a"), F.col("cx").alias("ca"), "p", key)
        right = self._with(members, "x", "q").select("g", "t", F.col("x").alias("b"), F.col("cx").alias("cb"), (F.col("cx") == F.col("cg")).alias("main"), "q", key)
        same = (F.col("l.g") == F.col("r.g")) & (F.col("l.t") == F.col("r.t")) & (F.col("l.k") == F.col("r.k"))
        return left.alias("l").join(right.alias("r"), same & (F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("a") < F.col("b"))) & self._may_link("p", "q"))

    def pairs(self) -> DataFrame:
        """(a, b, i, u): all links between classes of equal sets, with sizes of intersection and union.

        ``membership`` tells which documents are in a class. The number of rows is that of
        the links, which within a large group of near copies is the square of its size.
        """
        members = self._with(self.groups, "x", "p")
        left, right = members.select("g", F.col("x").alias("a"), "p"), members.select("g", F.col("x").alias("b"), F.col("p").alias("q"))
        return self._verified(left.join(right, "g").where((F.col("a") < F.col("b")) & self._may_link("p", "q")))

    def membership(self) -> DataFrame:
        """(id, n, class_id): class_id is null for sets that equal copies only could match."""
        to = self.classes.select("h1", "h2", "n", F.col("uid").alias("class_id"), second_key(F.col("h1")).alias("k"))
        return self.rows.withColumn("k", second_key(F.col("h1"))).join(to, ["h1", "h2", "n", "k"], "left").select("id", "n", "class_id")

    def components(self) -> DataFrame:
        """(id, n, component): the smallest id reachable by links; its own id for an empty set."""
        roots = connected_components(self._link_rounds())
        least = self.rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("least"))
        linked = self.classes.select("h1", "h2", "n", "uid").join(roots, F.col("uid") == F.col("v"), "left").select("h1", "h2", "n", F.coalesce("r", "uid").alias("root"))
        classes = stash(least.join(linked, ["h1", "h2", "n"], "left"), "least")
        tops = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("c")).where("c > 1").select("root", "top", second_key(F.col("root")).alias("k"))
        classes = classes.withColumn("k", second_key(F.col("root"))).join(tops, ["root", "k"], "left").select("h1", "h2", "n", F.coalesce("top", "least").alias("component"), second_key(F.col("h1")).alias("k"))
        rows = self.rows.withColumn("k", second_key(F.col("h1"))).join(classes, ["h1", "h2", "n", "k"], "left")
        return rows.select("id", "n", F.coalesce("component", "id").alias("component"))
