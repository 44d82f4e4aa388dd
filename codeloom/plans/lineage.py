"""Cutting the lineage of iterative plans, by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session in one process without it gets a temporary one, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables that this process has written to cut plans.
_written: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _cut_path(spark: SparkSession, label: str) -> str:
    _written.append(new_path(spark, label))
    return _written[-1]


def clear(spark: SparkSession) -> int:
    """Delete the tables that cut plans, once the results that read them are written; how many there were."""
    n = len(_written)
    while _written:
        delete_path(spark, _written.pop())
    return n


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    The files outlive executors. Unlike a checkpointed plan, the new one has no constraints of the old one, which over
    many iterations make the optimizer infer ever more of them; and its size is known, so that small sides are broadcast.
    """
    path = _cut_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Levels:
    """The tables that the rounds of an iteration leave, read together as one scan instead of a union that grows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.schema = spark, [], None

    def add(self, df: DataFrame) -> DataFrame:
        path = _cut_path(self.spark, "level")
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``, gapless from 0 in the order of unique columns, without one task that sees all rows.

    Rows are dealt by ranges; only the counts of the ranges go through one task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    starts = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_start"))
    near = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_near", near).join(F.broadcast(starts), "_part").withColumn("number", F.col("_start") + F.col("_near")).drop("_part", "_start", "_near")
