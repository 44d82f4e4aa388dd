"""The change stream: sessions by silence, hash deduplication, and the state that changes leave.

changes: (event_id, path, ts, kind, content_hash); kind is create, modify or remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.plans.lineage import new_path


def sessions(changes: DataFrame, gap: str = "150 milliseconds", late: str | None = None) -> DataFrame:
    """(path, started, n_events, kinds, removed): events of a path until it is silent for ``gap``. Works on streams with ``late`` set."""
    rows = changes.withWatermark("ts", late) if late else changes
    grouped = rows.groupBy("path", F.session_window("ts", gap).alias("w"))
    out = grouped.agg(F.count("*").alias("n_events"), F.collect_set("kind").alias("kinds"), F.max(F.col("kind") == "remove").alias("removed"))
    return out.select("path", F.col("w.start").alias("started"), "n_events", "kinds", "removed")


def dedup(changes: DataFrame) -> DataFrame:
    """Changes whose content differs from the one before of the path."""
    before = F.lag("content_hash").over(Window.partitionBy("path").orderBy("ts", "event_id"))
    return changes.withColumn("_before", before).where("_before is null or _before <> content_hash").drop("_before")


def dedup_against(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """A stream or batch without changes that the stored (path, content_hash) already has."""
    known = stored.select("path", F.col("content_hash").alias("_known"))
    return changes.join(known, "path", "left").where("_known is null or _known <> content_hash").drop("_known")


def keep_known(changes: DataFrame, indexed: DataFrame) -> DataFrame:
    """All changes but removals of paths that are not indexed."""
    known = indexed.select("path").distinct()
    return changes.where("kind <> 'remove'").unionByName(changes.where("kind = 'remove'").join(known, "path", "left_semi").select(*changes.columns))


def current(changes: DataFrame) -> DataFrame:
    """The state after all changes: the last content of each path that was not removed last."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("kind", "content_hash", "ts"), F.struct("ts", "event_id")).alias("l"))
    return last.where("l.kind <> 'remove'").select("path", "l.content_hash", "l.ts")


def stream_counts(changes: DataFrame) -> DataFrame:
    """Run the changes as a stream to its present end and return the counts by path that it leaves."""
    spark = changes.sparkSession
    base = new_path(spark, "stream")
    changes.write.parquet(f"{base}/in")
    source = spark.readStream.schema(changes.schema).parquet(f"{base}/in")
    counted = source.groupBy("path").agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "remove").alias("n_removed"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
