"""Connected components of an edge table, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import stash


def _follow(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """Replace ``column`` by its root where it has one."""
    step = roots.select(F.col("v").alias("_v"), F.col("r").alias("_r"))
    return df.join(step, df[column] == step["_v"], "left").withColumn(column, F.coalesce("_r", column)).drop("_v", "_r")


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, r): for each endpoint of ``edges`` (a, b) that isn't a smallest one, the smallest of its component.

    Each round hangs every vertex under its smallest neighbour, follows those
    pointers to their ends, and contracts the edges to the roots. Vertices under one
    root leave the edge table, so it shrinks by at least half a round; stars end in
    one. An empty edge table gives an empty result.
    """
    def simple(e: DataFrame) -> DataFrame:
        return stash(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", small=True)

    edges, found = simple(edges), None
    while not edges.isEmpty():
        parents = stash(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("r")), "parents", small=True)
        while not parents.select("r").join(parents.select(F.col("v").alias("r")), "r").isEmpty():
            parents = stash(_follow(parents, "r", parents), "parents", small=True)
        found = parents if found is None else stash(_follow(found, "r", parents).unionByName(parents), "roots", small=True)
        edges = simple(_follow(_follow(edges, "a", parents), "b", parents))
    return found if found is not None else edges.select(F.col("b").alias("v"), F.col("a").alias("r"))
