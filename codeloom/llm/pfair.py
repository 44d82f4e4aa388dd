"""Mixing sources to target weights by Pfair scheduling.

Sources are cut into blocks of rows, the quanta. A source of weight c out of C is due its i-th
block (from 0) no earlier than slot floor(i C / c) and before slot ceil((i + 1) C / c).
Earliest deadline first among released blocks meets all deadlines when the weights
add up to C, so after any number of slots each source is within one block of its share.
The schedule repeats after C slots, so one period is computed, from the weights
alone; every block finds its slot by its number. The slots of a source that has run out
stay empty and are closed up: the others go on in the same pattern, each within one block of its share of the
slots. No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.shared import content_order, give_back, plan_table, running_totals

#: Slots of a period; weights must not add up to more, divided by what they have in common.
MOST_SLOTS = 1 << 22
#: Slots that share a row of the table of rows ahead, at least; in general the square root of the number of blocks.
LEAST_RANGE = 64


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of one period for each source: Pfair windows, earliest deadline first."""
    total = sum(weights.values())
    waiting: list[tuple[int, int, str, int]] = []  # by release
    for s, c in weights.items():
        heapq.heappush(waiting, (0, math.ceil(total / c), s, 0))
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        due, s, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline is missed")
        slots[s].append(t)
        c = weights[s]
        if i + 1 < c:
            heapq.heappush(waiting, ((i + 1) * total // c, -(-(i + 2) * total // c), s, i + 1))
    return slots


def tempered(counts: dict[str, int], scale: int = 64) -> dict[str, int]:
    """Integer weights in proportion to the square roots of the sizes: large sources count less than their rows.

    The largest has ``scale``, or less where so many sources would make the period too long.
    """
    most, scale = max(counts.values(), default=1), max(1, min(scale, (MOST_SLOTS >> 2) // max(len(counts), 1)))
    return {s: max(1, math.floor(scale * math.sqrt(n / most) + 0.5)) for s, n in counts.items()}


def schedule(rows: DataFrame, weights: dict[str, int] | None = None, *, block_rows: int = 16, bits: int = 10) -> DataFrame:
    """``rows`` (source, _order, ...) with mix_block, mix_slot and mix_position; nothing here needs the texts.

    The driver holds the sources with their weights, and the slots of a period: at most MOST_SLOTS numbers.
    """
    own = rows.columns
    # Null and text sources get distinct names.
    name = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    rows = rows.withColumn("_source", name)
    counts = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count("*").alias("n")).toLocalIterator()}
    given = {("-" if s is None else f"+{s}"): w for s, w in (weights or {}).items()}
    chosen = tempered(counts) | {s: w for s, w in given.items() if s in counts}
    common = math.gcd(*chosen.values()) or 1
    chosen = {s: c // common for s, c in sorted(chosen.items())}
    total = sum(chosen.values())
    if total > MOST_SLOTS or min(chosen.values(), default=1) < 1:
        raise ValueError(f"weights must be positive and add up to at most {MOST_SLOTS}")
    slots = period(chosen)
    table, small = plan_table(rows.sparkSession, [{"s": s, "c": c, "slots": slots[s]} for s, c in chosen.items()], "s:string,c:int,slots:array<int>")
    placed = running_totals(rows, ["_source"], "_order", {"row": F.lit(1)}, bits).withColumn("mix_block", F.expr(f"row_before div {block_rows}"))
    met = placed.join(F.broadcast(table) if small else table, placed["_source"] == table["s"])
    slot = F.expr(f"(mix_block div c) * {total}L + slots[cast(mix_block % c as int)]")
    met = met.withColumn("mix_slot", slot).select(*own, "row_before", "mix_block", "mix_slot")
    # Rows ahead: those of earlier slots, by a table with a row for each range of slots, and those of the block.
    wide = max(LEAST_RANGE, math.isqrt(sum(-(-n // block_rows) for n in counts.values())))
    ranged = met.groupBy("mix_slot").agg(F.count("*").alias("n")).withColumn("_range", F.expr(f"mix_slot div {wide}"))
    sums = ranged.groupBy("_range").agg(F.sum("n").alias("here"))
    ahead = sums.select("_range", (F.sum("here").over(Window.orderBy("_range")) - F.col("here")).alias("far"))
    near = F.sum("n").over(Window.partitionBy("_range").orderBy("mix_slot")) - F.col("n")
    starts = ranged.withColumn("near", near).join(ahead, "_range").select(F.col("mix_slot").alias("_slot"), (F.col("far") + F.col("near")).alias("start"))
    out = met.join(starts, F.col("mix_slot") == F.col("_slot"))
    return out.select(*own, "mix_block", "mix_slot", (F.col("start") + F.col("row_before") % block_rows).cast("long").alias("mix_position"))


def interleave(docs: DataFrame, weights: dict[str, int] | None = None, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block_rows: int = 16, bits: int = 10) -> DataFrame:
    """``docs`` with mix_block (number of the block in its source), mix_slot and mix_position (gapless from 0).

    ``weights``: positive integers of the sources, which add up to at most MOST_SLOTS over what they have in common;
    those not named, or all without the argument, follow the square root of their sizes. Null is a source of its own. Which
    rows share a block follows from a hash of id and text, null counting as empty; rows that repeat may swap places. Texts
    of any length are only read for the hash. The order of the mix is that of mix_position. An empty table gives an empty
    result. Columns of ``docs`` named like a new one give way to it.
    """
    order = content_order(id_col, text_col)
    rows = docs.select(F.col(source_col).alias("source"), order.alias("_order"))
    return give_back(docs, order, schedule(rows, weights, block_rows=block_rows, bits=bits), ["mix_block", "mix_slot", "mix_position"])
