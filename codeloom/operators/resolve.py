"""Calls to definitions: import map, same file, unique name, each a join, the first that succeeds wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import split_callee

#: Confidence of each strategy.
IMPORT_MAP, SAME_FILE, GLOBAL_UNIQUE, CLASS_FACTOR = 0.95, 0.85, 0.90, 0.9


def unique_names(nodes: DataFrame) -> DataFrame:
    """(name, qualified_name) of names that one symbol has."""
    return nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("qualified_name").alias("qualified_name")).where("n = 1").select("name", "qualified_name")


def latest(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """One row for each qualified name: the last registered."""
    return nodes.groupBy("qualified_name").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def called_name(callee: Column) -> Column:
    """The last part of a callee: the name that a definition of it must have."""
    return split_callee(callee)["suffix"]


def resolve_calls(calls: DataFrame, imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls (call_id, path, callee, ...) with target_qualified, confidence and strategy.

    imports: (path, local_name, module_path); nodes need name, qualified_name, path. Method lookups by class, which a
    linear scan would do by prefix and suffix, are joins on (file, name): a symbol's qualified name begins with its path.
    """
    known = latest(nodes.select("node_id", "name", "qualified_name", "path"))
    parts = split_callee(F.col("callee"))
    c = calls.withColumn("_s", parts).select(*calls.columns, F.col("_s.prefix").alias("_prefix"), F.col("_s.suffix").alias("_suffix"), F.col("_s.rust").alias("_rust"))
    c = c.withColumn("_head", F.substring_index("_prefix", ".", 1)).withColumn("_rest", F.when(F.col("_prefix").contains("."), F.expr("substring(_prefix, length(_head) + 2)")))
    maps = imports.groupBy("path", "local_name").agg(F.min("module_path").alias("_module"))
    for key, column in (("full", F.coalesce("_prefix", "callee")), ("head", F.col("_head"))):
        side = maps.select(F.col("path").alias(f"_{key}_p"), F.col("local_name").alias(f"_{key}_l"), F.col("_module").alias(f"_{key}_m"))
        c = c.withColumn(f"_{key}_k", column)
        c = c.join(side, (c["path"] == side[f"_{key}_p"]) & (c[f"_{key}_k"] == side[f"_{key}_l"]), "left").drop(f"_{key}_p", f"_{key}_l", f"_{key}_k")
    tries = {
        "_q1": F.concat_ws(".", "_full_m", "_suffix"),
        "_q2": F.concat_ws(".", "_head_m", "_suffix"),
        "_q3": F.concat_ws(".", "_head_m", "_rest", "_suffix"),
    }
    needs = {"_q1": "_full_m", "_q2": "_head_m", "_q3": "_head_m"}
    exact = known.select(F.col("qualified_name").alias("_known"))
    for q, value in tries.items():
        c = c.withColumn(q, F.when(F.col(needs[q]).isNotNull(), value))
        c = c.join(exact, c[q] == exact["_known"], "left").withColumn(f"{q}_hit", F.col("_known")).drop("_known")
    in_file = known.groupBy("path", "name").agg(F.count("*").alias("n"), F.min_by("qualified_name", "node_id").alias("first"))
    for q, module in (("_c1", "_full_m"), ("_c2", "_head_m")):
        side = in_file.where("n = 1").select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("first").alias(f"{q}_hit"))
        c = c.join(side, (c[module] == side["_p"]) & (c["_suffix"] == side["_n"]) & c["_prefix"].isNotNull(), "left").drop("_p", "_n")
    same = in_file.select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("first").alias("_same"))
    c = c.join(same, (c["path"] == same["_p"]) & (c["_suffix"] == same["_n"]), "left").drop("_p", "_n")
    only = unique_names(known).select(F.col("name").alias("_n"), F.col("qualified_name").alias("_only"))
    c = c.join(only, (c["_suffix"] == only["_n"]) & (c["_prefix"].isNull() | c["_rust"]), "left").drop("_n")
    mapped, by_class = F.coalesce("_q1_hit", "_q2_hit", "_q3_hit"), F.coalesce("_c1_hit", "_c2_hit")
    first_class = F.col("_q1_hit").isNull() & F.col("_c1_hit").isNotNull()
    target = F.when(first_class, F.col("_c1_hit")).otherwise(F.coalesce(mapped, by_class, "_same", "_only"))
    strategy = F.when(mapped.isNotNull() | by_class.isNotNull(), "ImportMap").when(F.col("_same").isNotNull(), "SameFile").when(F.col("_only").isNotNull(), "GlobalUnique").otherwise("Unresolved")
    sure = F.when(first_class | (mapped.isNull() & by_class.isNotNull()), IMPORT_MAP * CLASS_FACTOR).when(mapped.isNotNull(), IMPORT_MAP).when(F.col("_same").isNotNull(), SAME_FILE).when(F.col("_only").isNotNull(), GLOBAL_UNIQUE).otherwise(0.0)
    return c.select(*calls.columns, target.alias("target_qualified"), sure.alias("confidence"), strategy.alias("strategy"))


def call_edges(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of resolved calls that have a caller; unresolved ones make none."""
    ids = latest(nodes).select("qualified_name", "node_id")
    source = ids.select(F.col("qualified_name").alias("caller_qualified"), F.col("node_id").alias("source_id"))
    target = ids.select(F.col("qualified_name").alias("target_qualified"), F.col("node_id").alias("target_id"))
    kept = resolved.where("target_qualified is not null and caller_qualified is not null")
    joined = kept.join(source, "caller_qualified").join(target, "target_qualified", "left")
    return joined.select("source_id", "target_id", F.lit("calls").alias("edge_type"), "confidence", "path", "line", F.col("strategy").alias("metadata"))
