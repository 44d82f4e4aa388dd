"""Traversals of the call graph, level by level, and what is built on them.

edges: (source_id, target_id, confidence). Each level is one join of the frontier with the adjacency, an
aggregation that keeps the best confidence, and an anti join with what was seen; it is written, so
plans do not grow with the depth. The adjacency is made once, by ``adjacency``; a table that has it already is marked by ``ready``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import is_constructor, risk_level
from codeloom.plans.lineage import Levels, cut


def adjacency(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, confidence): each pair once, with its best confidence; unresolved edges are left out."""
    return edges.where(F.col("target_id").isNotNull()).groupBy("source_id", "target_id").agg(F.max("confidence").alias("confidence"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, *, reverse: bool = False, ready: bool = False) -> DataFrame:
    """(seed, node_id, depth, confidence) of nodes within ``depth`` of each seed (column node_id), without the seeds.

    The depth is the least one; the confidence is the largest product along such a shortest path.
    """
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    steps = (edges if ready else cut(adjacency(edges))).select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.col("confidence").alias("_c"))
    levels = Levels(edges.sparkSession)
    front = levels.add(seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence")).distinct())
    for k in range(1, depth + 1):
        found = front.join(steps, front["node_id"] == steps["_from"]).groupBy("seed", F.col("_to").alias("node_id")).agg(F.max(F.col("confidence") * F.col("_c")).alias("confidence"))
        front = levels.add(found.join(levels.all().select("seed", "node_id"), ["seed", "node_id"], "left_anti").select("seed", "node_id", F.lit(k).alias("depth"), "confidence"))
        if front.isEmpty():
            break
    return levels.all().where("depth > 0")


def impact_radius(edges: DataFrame, seeds: DataFrame, depth: int = 10, *, ready: bool = False) -> DataFrame:
    """Transitive callers with risk = confidence / depth."""
    return reach(edges, seeds, depth or 10, reverse=True, ready=ready).withColumn("risk", F.try_divide("confidence", "depth"))


def impact_by_depth(impact: DataFrame) -> DataFrame:
    return impact.groupBy("depth").agg(F.count("*").alias("n_nodes"), F.max("risk").alias("max_risk"))


def call_path(edges: DataFrame, source: int, target: int, depth: int = 20, *, ready: bool = False) -> DataFrame:
    """(hop, node_id, confidence) of one shortest path; of several, the one whose nodes are least, from the end backwards."""
    spark = edges.sparkSession
    hops = lambda rows: spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(h).alias("hop"), F.lit(n).cast("long").alias("node_id"), F.lit(float(c)).alias("confidence")) for h, n, c in rows])).alias("r")).select("r.*")
    if source == target:
        return hops([(0, source, 1.0)])
    steps = edges if ready else cut(adjacency(edges))
    levels = Levels(spark)
    front = levels.add(spark.range(1).select(F.lit(source).cast("long").alias("node_id"), F.lit(None).cast("long").alias("source_id"), F.lit(1.0).alias("confidence"), F.lit(0).alias("hop")))
    for k in range(1, depth + 1):
        found = front.select("node_id").join(steps, front["node_id"] == steps["source_id"]).groupBy(F.col("target_id").alias("node_id")).agg(F.min(F.struct("source_id", steps["confidence"])).alias("via"))
        front = levels.add(found.join(levels.all().select("node_id"), "node_id", "left_anti").select("node_id", "via.source_id", "via.confidence", F.lit(k).alias("hop")))
        if front.isEmpty() or not front.where(F.col("node_id") == target).isEmpty():
            break
    parents, at, rows = levels.all(), target, []
    while at != source:  # one row for each hop: bounded by the depth
        via = parents.where(F.col("node_id") == at).first()
        if via is None:
            return hops([(0, source, 1.0)]).where("false")
        rows.append((via["hop"], at, via["confidence"]))
        at = via["source_id"]
    return hops([(0, source, 1.0), *rows[::-1]])


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that nothing calls, are not exported, and are not called by convention."""
    called = edges.where(F.col("target_id").isNotNull()).select(F.col("target_id").alias("node_id")).distinct()
    name = F.col("name")
    # Names and affixes of code that frameworks and languages call.
    usual = name.isin("main", "initialize", "default", "from", "into", "try_into")
    for prefix in ("test_", "Test", "__", "default_", "bench_"):
        usual = usual | name.startswith(prefix)
    usual = usual | name.endswith("_test")
    left = nodes.where(F.col("kind").isin("function", "method") & ~F.col("is_exported") & ~usual & ~is_constructor(F.col("qualified_name")))
    return left.join(called, "node_id", "left_anti")


def change_impact(nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame, depth: int = 5, *, ready: bool = False) -> DataFrame:
    """For each symbol of the changed files: how many symbols call it within ``depth``, and the risk level."""
    seeds = nodes.join(changed_paths.select("path").distinct(), "path", "left_semi")
    counts = reach(edges, seeds, depth, reverse=True, ready=ready).groupBy("seed").agg(F.count("*").alias("n"))
    total = F.coalesce("n", F.lit(0))
    return seeds.join(counts, seeds["node_id"] == counts["seed"], "left").select("node_id", "qualified_name", "path", "line_start", total.cast("long").alias("impacted"), risk_level(total).alias("risk"))


def risk_histogram(impact: DataFrame) -> DataFrame:
    """(risk, symbols) for each of the three levels, also those without a symbol."""
    levels = impact.sparkSession.range(1).select(F.explode(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW"))).alias("risk"))
    counts = impact.groupBy("risk").agg(F.count("*").alias("n"))
    return levels.join(counts, "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("symbols"))


def topo_levels(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, level): 0 without dependencies, else one more than the largest level of them; null in or behind a cycle.

    deps: (file_id, needs). Producers come first when files are ordered by level, cycles last. Files are peeled by the number
    of dependencies they still wait for: a level reads the files that are left and the edges of its front.
    """
    deps = cut(deps.where("file_id <> needs").distinct())
    ids = cut(files.select("file_id").distinct())
    waits = deps.groupBy("file_id").agg(F.count("*").alias("waits"))
    left = cut(ids.join(waits, "file_id", "left").select("file_id", F.coalesce("waits", F.lit(0)).alias("waits")))
    # Files that are only depended on are not placed, but free those that wait for them.
    outside = deps.select(F.col("needs").alias("file_id")).distinct().join(ids, "file_id", "left_anti").join(deps, "file_id", "left_anti")
    levels, k = Levels(ids.sparkSession), 0
    free = levels.add(left.where("waits = 0").select("file_id", F.lit(0).alias("level")))
    front = cut(free.select("file_id").unionByName(outside))
    left = left.where("waits > 0")
    while not front.isEmpty():
        k += 1
        fewer = deps.join(front.select(F.col("file_id").alias("needs")), "needs").groupBy("file_id").agg(F.count("*").alias("less"))
        left = cut(left.join(fewer, "file_id", "left").select("file_id", (F.col("waits") - F.coalesce("less", F.lit(0))).alias("waits")))
        front = levels.add(left.where("waits = 0").select("file_id", F.lit(k).alias("level"))).select("file_id")
        left = left.where("waits > 0")
    return ids.join(levels.all(), "file_id", "left")


def closure(import_edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files and all that import them, over any number of steps."""
    levels = Levels(changed.sparkSession)
    front = levels.add(changed.select("file_id").distinct())
    while not front.isEmpty():
        found = front.join(import_edges, front["file_id"] == import_edges["imported_file_id"]).select(F.col("importer_file_id").alias("file_id")).distinct()
        front = levels.add(found.join(levels.all(), "file_id", "left_anti"))
    return levels.all()
