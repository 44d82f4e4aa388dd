"""Lookups, references, statistics and mutations of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import top_folder


def find_references(edges: DataFrame, nodes: DataFrame, target: int) -> DataFrame:
    """Every edge to a node, with the calling symbol and its file where they are known."""
    source = nodes.select(F.col("node_id").alias("source_id"), F.col("qualified_name").alias("_q"), F.col("path").alias("_p"))
    joined = edges.where(F.col("target_id") == target).join(source, "source_id", "left")
    name = F.coalesce("_q", F.concat(F.lit("node#"), F.col("source_id").cast("string")))
    return joined.select("source_id", name.alias("caller"), F.coalesce("_p", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), "confidence")


def find_definition(edges: DataFrame, nodes: DataFrame, caller: int, line: int | None = None) -> DataFrame:
    """Targets of a symbol's calls, of those on one line if it is given; a null target is named unresolved."""
    own = edges.where((F.col("source_id") == caller) & (F.col("edge_type") == "calls"))
    if line is not None:
        own = own.where(F.col("line") == line)
    target = nodes.select(F.col("node_id").alias("target_id"), F.col("qualified_name").alias("_q"))
    return own.join(target, "target_id", "left").select("line", "target_id", F.coalesce("_q", F.lit("unresolved")).alias("definition"), "confidence")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Call sites into and out of each symbol; edges that repeat count each."""
    known = edges.where(F.col("target_id").isNotNull())
    into = known.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("_in"))
    out = known.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("_out"))
    zero = F.lit(0).cast("long")
    return nodes.join(into, "node_id", "left").join(out, "node_id", "left").select("node_id", "qualified_name", F.coalesce("_in", zero).alias("callers"), F.coalesce("_out", zero).alias("callees"))


def hubs(edges: DataFrame, n: int = 10) -> DataFrame:
    known = edges.where(F.col("target_id").isNotNull())
    return known.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "node_id").limit(n)


def all_entry_points(nodes: DataFrame) -> DataFrame:
    exported = F.col("is_exported") & (F.col("kind") == "function") & ~F.col("name").startswith("test_") & ~F.col("name").startswith("bench_")
    return nodes.where((F.col("name") == "main") | exported)


def entry_points(nodes: DataFrame, n: int = 20) -> DataFrame:
    return all_entry_points(nodes).orderBy("path", "line_start", "node_id").limit(n)


def module_structure(nodes: DataFrame, root: str) -> DataFrame:
    """Files with symbols by their folder under the root."""
    return nodes.select("path").distinct().groupBy(top_folder(F.col("path"), root).alias("folder")).agg(F.count("*").alias("files"))


def index_status(files: DataFrame, nodes: DataFrame, edges: DataFrame, import_edges: DataFrame) -> DataFrame:
    """(metric, value): counts of the stored tables."""
    parts = [d.agg(F.count("*").alias("value")).select(F.lit(k).alias("metric"), "value") for k, d in (("files", files), ("nodes", nodes), ("edges", edges), ("import_edges", import_edges))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def upsert(old: DataFrame, new: DataFrame, key: str, keep: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key, whose ``keep`` column (an id) stays."""
    ids = old.select(key, F.col(keep).alias("_keep"))
    fresh = new.join(ids, key, "left").withColumn(keep, F.coalesce("_keep", keep)).select(*old.columns)
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(fresh)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One of equal (source, target, type, file, line), the surest, with its other columns; rows without a target never count as equal."""
    keys = ["source_id", "target_id", "edge_type", "path", "line"]
    rest = ["confidence", *[c for c in edges.columns if c not in (*keys, "confidence")]]
    known = edges.where(F.col("target_id").isNotNull())
    best = known.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])
    return best.unionByName(edges.where(F.col("target_id").isNull()).select(*keys, *rest))


def delete_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of files whose path is not in ``gone``."""
    return files.join(gone.select("path"), "path", "left_anti").select(*files.columns)


def append(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and the rows whose key it lacks; keys that repeat among the rows come once."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def delete_cascade(nodes: DataFrame, edges: DataFrame, import_edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the files (file_id, path): their nodes, edges and import edges go, targets in them become null."""
    paths = files.select("path").distinct()
    kept = nodes.join(paths, "path", "left_anti")
    gone = nodes.join(paths, "path", "left_semi").select("node_id")
    own = edges.join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
    dangling = gone.select(F.col("node_id").alias("target_id"), F.lit(True).alias("_gone"))
    nulled = own.join(dangling, "target_id", "left").withColumn("target_id", F.when(F.col("_gone"), None).otherwise(F.col("target_id"))).select(*edges.columns)
    ids = files.select("file_id").distinct()
    imports = import_edges.join(ids.withColumnRenamed("file_id", "importer_file_id"), "importer_file_id", "left_anti").join(ids.withColumnRenamed("file_id", "imported_file_id"), "imported_file_id", "left_anti")
    return kept, nulled, imports.select(*import_edges.columns)
