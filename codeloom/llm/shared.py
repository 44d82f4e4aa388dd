"""What the operators share: tables, intermediate storage and distributed ranks."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one Arrow batch. Texts can be long, so a batch must hold few of them.
ARROW_ROWS = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: texts are far larger than the rows Spark's default is meant for."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session in one process (tests, a bench) gets a temporary folder; on a cluster that is an
    error, as executors do not see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that this process has written to the shared folder.
_written: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the tables that were written between passes, once the results that read them are written; how many there were."""
    n = len(_written)
    while _written:
        target = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return n


def stash(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the files nothing, and later
    passes read only the columns they use. Files stay until ``clear`` is called, because
    the frame that a query returns is read after the query function ends.
    ``small``: few rows against the input; an eighth of the usual tasks write it, which
    spares thousands of tiny files where partitions are not coalesced.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if small:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def second_key(key: Column) -> Column:
    """A column that follows from ``key``.

    Joined on beside the key, it makes Spark deal out both sides anew instead of
    reusing the layout of an aggregation by the key alone. Only such sides can be
    split by adaptive execution when one key holds a large share of the rows.
    """
    return F.pmod(F.xxhash64(key), F.lit(1024)).cast("int")


def rank_offsets(df: DataFrame, groups: list[str], bucket: str, weights: dict[str, Column]) -> DataFrame:
    """One row for each (group, bucket) with what all earlier buckets of the group hold."""
    sums = df.groupBy(*groups, bucket).agg(*[F.sum(w).alias(f"{k}_here") for k, w in weights.items()])
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *groups, bucket, *[F.coalesce(F.sum(f"{k}_here").over(before), F.lit(0)).cast("long").alias(f"{k}_before") for k in weights]
    )


def running_totals(df: DataFrame, groups: list[str], order: str, weights: dict[str, Column], bits: int) -> DataFrame:
    """Add, for each weight, the total of the rows ahead within the group, by ``order`` (a uniform 64-bit hash).

    A group is cut into 2**bits ranges of the hash. Rows meet only within a range, and
    a small table with one row for each range carries the totals across. So a group
    that holds a large share of all rows is still spread over many tasks.
    """
    if bits:
        df = df.withColumn("_range", F.shiftrightunsigned(F.col(order), 64 - bits))
    else:
        df = df.withColumn("_range", F.lit(0).cast("long"))
    ahead = rank_offsets(df, groups, "_range", weights)
    keys = [*groups, "_range"]
    inner = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(w).over(inner), F.lit(0)).cast("long").alias(f"_{k}_local") for k, w in weights.items()])
    condition = [local[k].eqNullSafe(ahead[k]) for k in keys]
    joined = local.join(ahead.select(*[F.col(k) for k in keys], *[F.col(f"{k}_before") for k in weights]), condition, "left")
    kept = [local[c] for c in df.columns if c != "_range"]
    return joined.select(*kept, *[(F.col(f"_{k}_local") + F.col(f"{k}_before")).alias(f"{k}_before") for k in weights])


def give_back(docs: DataFrame, order: Column, placed: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``columns`` of ``placed``, which has a row (_order, ...) for each of its rows.

    Work on places needs no texts, so they are dealt out once, here. Rows of one order are copies and take the places in
    turn, in one task for each such order. Columns of ``docs`` named like a new one give way to it.
    """
    places = placed.groupBy("_order").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_places"))
    turn = F.row_number().over(Window.partitionBy("_order").orderBy(F.lit(1)))
    own = [c for c in docs.columns if c not in columns]
    rows = docs.select(F.struct(*[f"`{c}`" for c in own]).alias("_row"), order.alias("_order")).withColumn("_turn", turn)
    joined = rows.join(places, "_order").withColumn("_place", F.get("_places", F.col("_turn") - 1))
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], *[F.col(f"_place.{c}").alias(c) for c in columns])


def content_order(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A positive long that follows from id and text, evenly spread; it is 8 times the first 15 hexadecimal digits of an MD5, which SQL has too."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") * F.lit(8)


#: Characters of JSON in one literal, and of a plan that is broadcast; larger plans are joined by a shuffle.
LITERAL_CHARS = 1 << 20


def plan_table(spark: SparkSession, rows: list[dict], kind: str) -> tuple[DataFrame, bool]:
    """``rows`` made on the driver as a table of ``kind`` (fields of a struct), and whether it is small enough to broadcast."""
    parts, part, size, total = [], [], 0, 0
    for row in rows:
        text = json.dumps(row)
        if part and size + len(text) > LITERAL_CHARS:
            parts, part, size = [*parts, part], [], 0
        part.append(text)
        size, total = size + len(text), total + len(text)
    frames = [spark.range(1).select(F.explode(F.from_json(F.lit("[" + ",".join(p) + "]"), f"array<struct<{kind}>>")).alias("p")).select("p.*") for p in [*parts, part]]
    if not parts:
        return frames[0], True
    path = new_path(spark, "plan")
    for frame in frames:
        frame.write.mode("append").parquet(path)
    return spark.read.schema(frames[0].schema).parquet(path), False
