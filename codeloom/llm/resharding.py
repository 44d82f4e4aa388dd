"""Resharding with the fewest bytes moved: a min-cost flow decides, rows follow.

The rows of each old shard lie on a line of bytes, in the order of a hash. The flow
between old shards and new capacities cuts every line into stretches, the first of
which stays where it is. Blocks, ranges of the hash, that lie within one stretch
move as they are; only blocks on a cut are split. Which block a row is in and how many
bytes lie ahead of it come from per-block totals and a window within the block.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.flow import even, transfers
from codeloom.llm.shared import content_order, give_back, plan_table, running_totals, stash

#: Old shards that one flow is solved for; they are listed on the driver.
MOST_SHARDS = 100_000
#: Blocks whose table is broadcast (20 bytes each); more are joined by a shuffle.
MOST_BLOCKS = 1 << 20


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text and 8 for the key."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def place(rows: DataFrame, shards: int, bits: int = 10) -> DataFrame:
    """``rows`` (size, old_shard, _order, ...) with shard, slot and moved; nothing here needs the texts."""
    sizes = {r["old_shard"]: r["b"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("b")).limit(MOST_SHARDS + 1).collect()}
    if len(sizes) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} old shards")
    old = sorted(sizes)
    moves = transfers([sizes[i] for i in old], even(sum(sizes.values()), shards), lambda i, j: int(old[i] != j))
    cuts, at = [], dict.fromkeys(range(len(old)), 0)
    for i, j in sorted(moves, key=lambda k: (k[0], old[k[0]] != k[1], k[1])):
        cuts.append({"i": old[i], "lo": at[i], "hi": at[i] + moves[i, j], "j": j})
        at[i] += moves[i, j]
    # One row for each arc with flow: fewer than old and new shards together, for a basic solution.
    plan, small = plan_table(rows.sparkSession, cuts, "i:int,lo:bigint,hi:bigint,j:int")
    plan = plan.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "j"))).alias("cuts"))
    placed = running_totals(rows, ["old_shard"], "_order", {"bytes": F.col("size")}, bits)
    middle = F.col("bytes_before") + F.expr("size div 2")
    found = placed.join(F.broadcast(plan) if small else plan, placed["old_shard"] == plan["i"], "left").withColumn("_middle", middle)
    found = found.withColumn("shard", F.expr("filter(cuts, c -> c.lo <= _middle and _middle < c.hi)[0].j")).drop("i", "cuts", "_middle", "bytes_before")
    slots = running_totals(found, ["shard"], "_order", {"slot": F.lit(1)}, bits)
    return slots.withColumnRenamed("slot_before", "slot").withColumn("moved", F.col("old_shard") != F.col("shard"))


def old_number(old: Column) -> Column:
    return F.coalesce(old.cast("long"), F.lit(0)).cast("int")


def reshard(docs: DataFrame, old: Column, shards: int, *, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None, bits: int = 10) -> DataFrame:
    """``docs`` with size, old_shard, shard (0 to shards - 1), slot (gapless from 0) and moved.

    ``old`` is the shard a row is in now, an integer from 0; null counts as 0. New
    shards 0 .. keep what they can of the old shards of the same number. Each shard's bytes
    are within a few rows of an equal share. Rows that repeat are rows of their own. ``bits``:
    each old shard is cut into 2**bits blocks. ``order``: 64-bit numbers spread over their range, in whose order rows lie
    and get slots; without it a hash of id and text, null counting as empty. Old shards are listed on the driver, at most
    MOST_SHARDS: more are an error. Rows of any size stay whole, so a shard may be over its share by half of its last
    row. An empty table gives an empty result. Columns of ``docs`` named like a new one give way to it.
    """
    new = ["size", "old_shard", "shard", "slot", "moved"]
    order = content_order(id_col, text_col) if order is None else order
    rows = docs.select(byte_size(F.col(text_col)).alias("size"), old_number(old).alias("old_shard"), order.alias("_order"))
    return give_back(docs, order, place(rows, shards, bits), new)


def with_places(docs: DataFrame, old: Column, order: Column, placed: DataFrame, *, bits: int = 10, file_rows: int = 100_000) -> DataFrame:
    """``docs`` with old_shard, shard, slot and moved of ``placed``, as ``place`` gives them; texts are dealt out once, by their new shard.

    A block that lies within one stretch moves as it is, so its number tells where its rows go; only the
    rows of blocks on a cut are joined one by one. Slots follow from the order within a shard, in files of about ``file_rows`` rows.
    """
    new = ["old_shard", "shard", "slot", "moved"]
    own = [c for c in docs.columns if c not in new]
    block = F.shiftrightunsigned(F.col("_order"), 64 - bits)
    blocks = placed.groupBy("old_shard", block.alias("_block")).agg(F.min("shard").alias("_to"), F.max("shard").alias("_last"))
    blocks = stash(blocks.withColumn("_cut", F.col("_to") != F.col("_last")).drop("_last"), "blocks", small=True)
    rows = docs.select(F.struct(*[f"`{c}`" for c in own]).alias("_row"), old_number(old).alias("old_shard"), order.alias("_order")).withColumn("_block", block)
    known = blocks.count()
    met = rows.join(F.broadcast(blocks) if known <= MOST_BLOCKS else blocks, ["old_shard", "_block"])
    whole = met.where("not _cut").select("_row", "_order", "old_shard", F.col("_to").alias("shard"))
    cut = placed.withColumn("_block", block).join(blocks.where("_cut").select("old_shard", "_block"), ["old_shard", "_block"], "left_semi").select("_order", "old_shard", "shard")
    single = give_back(met.where("_cut").select("_row", F.col("_order").alias("_mine")), F.col("_mine"), cut, ["old_shard", "shard"])
    every = whole.unionByName(single.select("_row", F.col("_mine").alias("_order"), "old_shard", "shard"))
    held, shards = placed.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    parts = max(1, -(-(held or 0) // file_rows))
    part = F.expr(f"_order div {-(-((1 << 63) - 1) // parts)}L").alias("_part")
    starts = placed.groupBy("shard", part).agg(F.count("*").alias("n"))
    starts = starts.withColumn("_start", F.sum("n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("n")).select("shard", "_part", "_start")
    near = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_order")) - 1
    dealt = every.select("*", part).withColumn("_near", near).join(F.broadcast(starts) if parts * shards <= MOST_BLOCKS else starts, ["shard", "_part"])
    return dealt.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], "old_shard", "shard", (F.col("_start") + F.col("_near")).alias("slot"), (F.col("old_shard") != F.col("shard")).alias("moved"))


def write_affected(resharded: DataFrame, path: str, *, dealt: bool = False) -> list[int]:
    """Rewrite the folders ``path``/shard=N of shards that gain or lose rows, and return their numbers.

    Folders of shards that keep all their rows are left alone. The new folders are whole before the
    first old one goes, so ``resharded`` may be read from ``path``; it cannot be read again afterwards. Shards
    without rows lose their folder. ``dealt``: the rows lie by shard and slot already, as ``with_places`` leaves them.
    """
    # No more than old and new shards together.
    changed = sorted(r["s"] for r in resharded.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect())
    return rewrite(resharded, path, changed, dealt=dealt)


def rewrite(resharded: DataFrame, path: str, changed: list[int], *, dealt: bool = False) -> list[int]:
    """``write_affected`` where it is known which shards gain or lose rows."""
    if not changed:
        return changed
    spark = resharded.sparkSession
    fresh = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"
    rows = resharded.where(F.col("shard").isin(changed)).drop("old_shard", "moved")
    if not dealt:
        rows = rows.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(fresh)
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.Path(fresh).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in changed:
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={s}") for folder in (fresh, path.rstrip("/")))
        if files.exists(old) and not files.delete(old, True):
            raise OSError(f"shard {s} of {path} cannot be removed; the new one is in {fresh}")
        if files.exists(new) and not files.rename(new, old):
            raise OSError(f"shard {s} of {path} cannot be replaced; the new one is in {fresh}")
    files.delete(jvm.org.apache.hadoop.fs.Path(fresh), True)
    return changed
