"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalign.runtime import stage

# At most this many remaining edges are finished by one task.
SINGLE_TASK_EDGES = 500_000


def spanning_forest(left, right):
    """Union-find over edge arrays; returns the edges that joined two trees."""
    parent: dict = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    used = []
    for u, v in zip(left, right):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            used.append((u, v))
    return used, root, parent


def _finish(batch):
    """Label the nodes of a small graph with the smallest node of their tree."""
    import pandas as pd

    _, root, parent = spanning_forest(batch["src"].tolist(), batch["dst"].tolist())
    nodes = list(parent)
    return pd.DataFrame({"node": nodes, "rep": [root(n) for n in nodes]})


def connected_components(
    nodes: DataFrame, edges: DataFrame, single_task_edges: int = SINGLE_TASK_EDGES
) -> DataFrame:
    """``(id, component)`` where component is the smallest id reachable.

    ``nodes(id)`` are longs or strings, ``edges(src, dst)`` may hold repeats, loops and
    both directions. Each round maps every node to the neighbour with the lowest
    round-specific hash and contracts the graph, so the node count falls by a
    constant factor per round whatever the graph looks like (long paths and
    hubs included); minima are pre-aggregated before they are shuffled. Once
    few edges are left they are finished in one task of bounded size.
    """
    id_type = nodes.schema["id"].dataType.simpleString()
    labels = nodes.select("id", F.col("id").alias("at"))
    left = stage(_tidy(edges), "edges")
    round_no = 0
    while True:
        remaining = left.count()
        if remaining == 0:
            break
        if remaining <= single_task_edges:
            tree = left.groupBy(F.lit("all")).applyInPandas(_finish, f"node {id_type}, rep {id_type}")
            left = None
        else:
            both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            rank = lambda c: F.struct(
                F.xxhash64(F.col(c), F.lit(round_no)).alias("priority"), F.col(c).alias("node")  # noqa: B023
            )
            tree = (
                both.groupBy("src")
                .agg(F.min(rank("dst")).alias("best"))
                .select(
                    F.col("src").alias("node"),
                    F.least(F.col("best"), rank("src"))["node"].alias("rep"),
                )
            )
        tree = stage(tree, "tree")
        labels = stage(
            labels.join(tree.withColumnRenamed("node", "at"), "at", "left").select(
                "id", F.coalesce("rep", "at").alias("at")
            ),
            "labels",
        )
        if left is None:
            break
        moved = left
        for end in ("src", "dst"):
            moved = moved.join(tree.withColumnRenamed("node", end), end, "left").withColumn(
                end, F.coalesce("rep", end)
            ).drop("rep")
        left = stage(_tidy(moved), "edges")
        round_no += 1
    smallest = labels.groupBy("at").agg(F.min("id").alias("component"))
    return labels.join(smallest, "at").select("id", "component")


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct()
