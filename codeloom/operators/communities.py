"""Communities of the call graph: symmetrised weights, modularity, Louvain moves and contraction."""

from __future__ import annotations

import warnings
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.plans.lineage import cut, numbered

#: Entries of an adjacency that one task takes (in arrays, 0.5 GB with their copies); larger graphs settle in several.
LOCAL_EDGES = 8_000_000
#: Nodes whose neighbours a task has as lists at a time.
SLICE = 10_000


def symmetrised(edges: DataFrame) -> DataFrame:
    """(a, b, weight) in both directions: one edge for each pair, the largest weight of either direction, not below 0."""
    known = edges.where(F.col("target_id").isNotNull() & (F.col("source_id") != F.col("target_id")))
    weight = F.greatest(F.col("confidence"), F.lit(0.0)).alias("weight")
    # Exploded, not a union: the edges are read and joined once.
    ways = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))])
    both = known.select(F.explode(ways).alias("way"), weight).select("way.a", "way.b", "weight")
    return both.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def labelled(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """Adjacency with the communities of both ends (ca, cb). labels: (node_id, community)."""
    one = labels.select(F.col("node_id").alias("a"), F.col("community").alias("ca"))
    two = labels.select(F.col("node_id").alias("b"), F.col("community").alias("cb"))
    return adjacency.join(one, "a").join(two, "b")


def contract(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, weight) between communities; the weight within one is on (c, c), both directions counted."""
    return labelled(adjacency, labels).groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight"))


def modularity(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sum over communities of internal / 2m - (total / 2m) squared."""
    return contracted_modularity(labelled(adjacency, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "weight"))


def contracted_modularity(graph: DataFrame) -> DataFrame:
    """``modularity`` of a graph between communities, which contraction leaves as it is."""
    per = graph.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    sums = per.agg(F.sum("total").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    return sums.select((F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def summary(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """For each community: size, its member of most weight (ties: least id), weight inside (each edge once) and to others."""
    ends = labelled(adjacency, labels)
    degree = ends.groupBy("a").agg(F.sum("weight").alias("degree"))
    members = labels.join(degree, labels["node_id"] == degree["a"], "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    sizes = members.groupBy("community").agg(F.count("*").alias("n_members"), F.max(F.struct(F.round("degree", 6), -F.col("node_id")))["col2"].alias("_least"))
    weights = ends.groupBy(F.col("ca").alias("community")).agg(
        (F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)) / 2).alias("internal"), F.sum(F.when(F.col("ca") != F.col("cb"), F.col("weight")).otherwise(0.0)).alias("external")
    )
    joined = sizes.join(weights, "community", "left")
    return joined.select("community", "n_members", (-F.col("_least")).alias("representative"), F.coalesce("internal", F.lit(0.0)).alias("internal"), F.coalesce("external", F.lit(0.0)).alias("external"))


def _wanted(adjacency: DataFrame, labels: DataFrame, m2: float) -> DataFrame:
    """(node_id, community, to): nodes that gain by moving alone, and to which community most; ties to the least."""
    degree = adjacency.groupBy("a").agg(F.sum("weight").alias("k"))
    known = labels.join(degree, labels["node_id"] == degree["a"], "left").select("node_id", "community", F.coalesce("k", F.lit(0.0)).alias("k"))
    total = known.groupBy("community").agg(F.sum("k").alias("total"))
    to = labelled(adjacency.where("a <> b"), labels).groupBy(F.col("a").alias("node_id"), F.col("cb").alias("to")).agg(F.sum("weight").alias("w"))
    own = known.select("node_id", F.col("community").alias("to"), F.lit(0.0).alias("w"))
    options = to.unionByName(own).groupBy("node_id", "to").agg(F.sum("w").alias("w")).join(known, "node_id").join(total.withColumnRenamed("community", "to"), "to")
    held = F.col("total") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - held * F.col("k") / F.lit(m2), 9)
    # The greatest struct: most gain, then staying, then the least community.
    rank = F.struct(gain.alias("gain"), (F.col("to") == F.col("community")).alias("stays"), (-F.col("to")).alias("least"))
    best = options.groupBy("node_id").agg(F.max(rank).alias("best"), F.first("community").alias("community"))
    return best.where("not best.stays").select("node_id", "community", (-F.col("best.least")).alias("to"))


def _settled(m2: float):
    """One task over (a, b, weight, community of a), sorted by a and b, with all members of each community that it sees.

    Nodes in order move to the community of most gain, if that is positive, until none gains; ties to the least. No other
    task touches these communities, so each move gains what it counts. Weights to other nodes count for degrees only.
    Arrays hold about 50 bytes for an entry at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [tuple(batch[c].to_numpy() for c in ("a", "b", "weight", "community")) for batch in batches if len(batch)]
        if not parts:
            return
        a, b, weight, old = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts
        nodes, start = np.unique(a, return_index=True)
        degree = np.add.reduceat(weight, start)
        names, own = np.unique(old[start], return_inverse=True)
        label, total = array("q", own.tobytes()), array("d", np.bincount(own, weights=degree).tobytes())
        at = np.minimum(np.searchsorted(nodes, b), len(nodes) - 1).astype(np.int32)
        inside = (nodes[at] == b) & (a != b)
        ends = np.concatenate(([0], np.cumsum(inside)))[np.append(start, len(a))]
        near, weight = at[inside], weight[inside]
        del a, b, old, at, inside
        # When a community last changed, and when a node was last weighed: without a change between them it would stay again.
        changed, weighed, clock, moved = array("q", bytes(8 * len(names))), array("q", [-1]) * len(nodes), 0, True
        while moved:
            moved = False
            for low in range(0, len(nodes), SLICE):
                cut_at = ends[low : low + SLICE + 1]
                us, ws, ks = near[cut_at[0] : cut_at[-1]].tolist(), weight[cut_at[0] : cut_at[-1]].tolist(), degree[low : low + SLICE].tolist()
                cut_at = (cut_at - cut_at[0]).tolist()
                for i, k in enumerate(ks):
                    v, s, e = low + i, cut_at[i], cut_at[i + 1]
                    own, seen, around = label[v], weighed[v], [label[u] for u in us[s:e]]
                    if changed[own] <= seen and max([changed[c] for c in around], default=0) <= seen:
                        continue
                    to: dict[int, float] = {}
                    for c, w in zip(around, ws[s:e], strict=True):
                        to[c] = to.get(c, 0.0) + w
                    best, gain = own, round(to.pop(own, 0.0) - (total[own] - k) * k / m2, 9)
                    for c in sorted(to):
                        if (value := round(to[c] - total[c] * k / m2, 9)) > gain:
                            best, gain = c, value
                    if best != own:
                        total[own] -= k
                        total[best] += k
                        clock += 1
                        label[v], changed[own], changed[best], moved = best, clock, clock, True
                    weighed[v] = clock
        yield pd.DataFrame({"node_id": nodes, "community": names[np.frombuffer(label, dtype=np.int64)]})

    return run


def _in_tasks(rows: DataFrame, m2: float) -> DataFrame:
    return rows.sortWithinPartitions("a", "b").mapInPandas(_settled(m2), "node_id long, community long")


def _dealt(movers: DataFrame, salt: int) -> DataFrame:
    """(community, leader): communities that nodes would leave or enter, about half of which follow one that they exchange most nodes with."""
    both = movers.select(F.explode(F.array(F.struct(F.col("community"), F.col("to").alias("other")), F.struct(F.col("to").alias("community"), F.col("community").alias("other")))).alias("p")).select("p.*")
    leads = lambda c: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(2)) == 1
    pairs = both.groupBy("community", "other").agg(F.count("*").alias("n"))
    follow = F.max(F.when(leads("other"), F.struct("n", (-F.col("other")).alias("least"))))["least"]
    return pairs.groupBy("community").agg(follow.alias("_least")).select("community", F.when(leads("community"), F.col("community")).otherwise(F.coalesce(-F.col("_least"), "community")).alias("leader"))


def settle(graph: DataFrame, m2: float, most: int = 1000, local: int = LOCAL_EDGES) -> DataFrame:
    """Labels of the nodes of ``graph`` from which no node gains by moving alone.

    A graph of up to ``local`` entries settles in one task. In a larger one, communities that nodes would leave or enter
    are dealt to tasks, drawn anew each time so that such pairs meet, and each task settles its own; once their entries are no more than
    ``local``, one task takes all of them. After ``most`` rounds a warning says that labels still move.
    """
    if graph.count() <= local:
        return cut(_in_tasks(graph.select("a", "b", "weight", F.col("a").alias("community")).coalesce(1), m2))
    # Grouping instead of a copied column: equal columns make the optimizer infer ever more constraints.
    labels = cut(graph.groupBy(F.col("a").alias("node_id")).agg(F.max("a").alias("community")))
    for k in range(most):
        movers = cut(_wanted(graph, labels, m2))
        if movers.isEmpty():
            return labels
        owned = labels.join(_dealt(movers, k), "community").select(F.col("node_id").alias("a"), "community", "leader")
        rows = cut(graph.join(owned, "a"))
        n = rows.count()
        tasks = 1 if n <= local else min(1 + 4 * n // max(local, 1), int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        moved = _in_tasks(rows.repartition(tasks, "leader").select("a", "b", "weight", "community"), m2).withColumnRenamed("community", "moved")
        labels = cut(labels.join(moved, "node_id", "left").select("node_id", F.coalesce("moved", "community").alias("community")))
    warnings.warn(f"communities still move after {most} rounds", stacklevel=2)
    return labels


def detect(nodes: DataFrame, edges: DataFrame, levels: int = 10, least_gain: float = 1e-6, local: int = LOCAL_EDGES) -> DataFrame:
    """``detect_in`` the symmetrised edges."""
    return detect_in(nodes, cut(symmetrised(edges)), levels, least_gain, local)


def detect_in(nodes: DataFrame, adjacency: DataFrame, levels: int = 10, least_gain: float = 1e-6, local: int = LOCAL_EDGES) -> DataFrame:
    """(node_id, community) by Louvain over a written symmetrised adjacency: nodes move until none gains, communities contract and move in their turn.

    After the first pass up to ``levels`` more follow, until no community moves or modularity changes by less than
    ``least_gain``. Nodes without edges stay alone. The labels are those of a smallest member.
    """
    labels = cut(nodes.groupBy("node_id").agg(F.max("node_id").alias("community")))
    m2 = adjacency.agg(F.sum("weight")).first()[0]
    if not m2:
        return labels
    graph, mapping, quality = adjacency, labels, None
    for _ in range(1 + levels):
        inner = settle(graph, m2, local=local)
        if inner.where("node_id <> community").isEmpty():
            break
        step = inner.select(F.col("node_id").alias("community"), F.col("community").alias("_to"))
        mapping = cut(mapping.join(step, "community", "left").select("node_id", F.coalesce("_to", "community").alias("community")))
        graph = cut(contract(graph, inner))
        before, quality = quality, contracted_modularity(graph).first()[0]
        if before is not None and abs(quality - before) < least_gain:
            break
    least = mapping.groupBy("community").agg(F.min("node_id").alias("least"))
    return mapping.join(least, "community").select("node_id", F.col("least").alias("community"))


def largest(found: DataFrame, n: int = 50) -> DataFrame:
    """Of a summary the communities with more than one member, largest first."""
    return found.where("n_members > 1").orderBy(F.desc("n_members"), "community").limit(n)


def ranked(top: DataFrame) -> DataFrame:
    """The rows of ``largest`` with their ordinal from 1 and weights to one decimal place."""
    order = Window.orderBy(F.desc("n_members"), "community")  # over the few rows that are listed
    return top.select(F.row_number().over(order).alias("ordinal"), "community", "n_members", "representative", F.round("internal", 1).alias("internal"), F.round("external", 1).alias("external"))


def sizes(found: DataFrame) -> DataFrame:
    """(item, value): communities, those of more than one member, those of one, and the members of the largest."""
    many = F.col("n_members") > 1
    one = found.agg(F.count("*").alias("communities"), F.count_if(many).alias("communities_of_many"), F.count_if(~many).alias("singletons"), F.coalesce(F.max("n_members"), F.lit(0)).alias("largest_community"))
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c).cast("long"))])).alias("item", "value"))


def compact(labels: DataFrame) -> DataFrame:
    """labels with communities numbered from 0 without gaps, in the order of the old numbers."""
    known = numbered(labels.select("community").distinct(), "community")
    return labels.join(known, "community").select("node_id", F.col("number").alias("community"))
