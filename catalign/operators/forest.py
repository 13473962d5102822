"""Clusters for every distance at once: a minimum spanning forest of the vectors, and its cuts.

Two vectors are in one cluster of width eps (single linkage, every vector a core) if a path of steps of at most eps joins
them, and the minimum spanning forest has such a path if there is one. So distances are computed in one pass: each
block pair reports its own spanning forest, as an edge that is not in the forest of a part is not in that of the
whole. Boruvka rounds over the reported edges give the forest; any eps is a cut through it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalign.operators.components import SINGLE_TASK_EDGES, connected_components, spanning_forest
from catalign.operators.hierarchy import NOISE
from catalign.operators.vectors import BLOCK_VECTORS, Trees, block_sides, compared_blocks, distinct_vectors, staged_vectors
from catalign.runtime import SINGLE_TASK_ROWS, global_rank, spread, stage


def local_forest(distance: np.ndarray, alone: bool, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the minimum spanning forest of a matrix of distances, steps over ``limit`` left out.

    Rows and columns are different vectors, or the same ones if ``alone``. Boruvka rounds: the nearest vector of
    another tree, for every vector at once; the shortest step of each tree joins two.
    """
    n, m = distance.shape
    steps = np.where(distance <= limit, distance, np.inf)
    left = np.arange(n)
    right = left if alone else n + np.arange(m)
    label = np.arange(n if alone else n + m)
    rows, columns = [], []
    while True:
        open_steps = np.where(label[left][:, None] == label[right][None, :], np.inf, steps)
        best = open_steps.argmin(1)
        i, j = [left], [best]
        if not alone:
            i, j = [left, open_steps.argmin(0)], [best, np.arange(m)]
        i, j = np.concatenate(i), np.concatenate(j)
        own = np.concatenate([label[left], label[right]]) if not alone else label[left]
        length = open_steps[i, j]
        order = np.argsort(length, kind="stable")
        order = order[np.isfinite(length[order])]
        if not len(order):
            return np.array(rows, int), np.array(columns, int)
        _, first = np.unique(own[order], return_index=True)
        chosen = order[np.sort(first)]
        used, root, _ = spanning_forest(label[left[i[chosen]]].tolist(), label[right[j[chosen]]].tolist())
        kept = set(used)
        for r, c in zip(i[chosen].tolist(), j[chosen].tolist()):
            if (ends := (int(label[left[r]]), int(label[right[c]]))) in kept:
                kept.discard(ends)
                rows.append(r)
                columns.append(c)
        label = np.array([root(x) for x in label.tolist()])


def spanning_edges(
    vectors: DataFrame, max_eps: float, block_vectors: int = BLOCK_VECTORS, widths: list[float] | None = None
) -> DataFrame:
    """``(src, dst, weight)``: fewer edges than vectors from each block pair, a superset of the forest.

    If only cuts at certain ``widths`` are wanted, any forest with the same trees at each of them will do, and
    most parts of a block pair are seen to add nothing without a search for shortest steps.
    """
    id_type = vectors.schema["id"].dataType.simpleString()

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, alone, parts = block_sides(pdf)
        trees = [Trees(len(left), len(right), alone) for _ in widths or []]
        none = np.zeros(0, int)
        rows, columns, weights = [none], [none], [np.zeros(0)]
        for at, to, same, distance in parts:
            if widths is None:
                i, j = local_forest(distance, same, max_eps)
                found = [(i + at.start, j + to.start)]
            else:
                found = []
                for nth, eps in enumerate(sorted(widths)):
                    for i, j in found:
                        trees[nth].merge(i, j)
                    found.append(trees[nth].add(at, to, distance <= eps))
            for i, j in found:
                rows.append(i)
                columns.append(j)
                weights.append(distance[i - at.start, j - to.start])
        i, j, weight = np.concatenate(rows), np.concatenate(columns), np.concatenate(weights)
        # Of what the parts report the lightest that join two trees are left.
        order = np.argsort(weight, kind="stable")
        i, j, weight = i[order], j[order], weight[order]
        new = Trees(len(left), len(right), alone).merge(i, j)
        return pd.DataFrame({"src": left["id"].to_numpy()[i[new]], "dst": right["id"].to_numpy()[j[new]], "weight": weight[new]})

    blocks = spread(compared_blocks(vectors, max_eps, block_vectors), "by", "lo", "hi")
    return blocks.groupBy("by", "lo", "hi").applyInPandas(forest, f"src {id_type}, dst {id_type}, weight double")


def minimum_forest(edges: DataFrame, single_task_edges: int = SINGLE_TASK_EDGES) -> DataFrame:
    """The minimum spanning forest of ``edges(src, dst, weight)``; equal weights go by the smaller ends.

    Each round every tree takes its lightest edge; trees that are joined become one and parallel edges
    between two trees shrink to the lightest. A bounded rest is finished by one task.
    """
    id_type = edges.schema["src"].dataType.simpleString()
    ends = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    edge = F.struct("weight", "src", "dst")
    left = stage(ends.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min(edge).alias("e")), "edges")
    found: list[DataFrame] = []

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "src", "dst"])
        used, _, _ = spanning_forest(pdf["a"].tolist(), pdf["b"].tolist())
        # Of parallel edges there is one only, so two trees tell the edge.
        keys = set(used)
        hit = [(a, b) in keys for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist())]
        return pdf[hit][["src", "dst", "weight"]]

    while remaining := left.count():
        if remaining <= single_task_edges:
            flat = left.select("a", "b", "e.*").withColumn("all", F.lit(0))
            found.append(stage(flat.groupBy("all").applyInPandas(finish, f"src {id_type}, dst {id_type}, weight double"), "forest"))
            break
        both = left.select("a", "b", "e").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        picked = both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("p")).select("a", F.col("p.b").alias("b"), F.col("p.e").alias("e"))
        picked = stage(picked, "picked")
        found.append(stage(picked.select("e.*").distinct().select("src", "dst", "weight"), "forest"))
        trees = picked.select(F.col("a").alias("id")).unionByName(picked.select(F.col("b").alias("id"))).distinct()
        joined = stage(connected_components(trees, picked.select(F.col("a").alias("src"), F.col("b").alias("dst")), single_task_edges), "trees")
        moved = left
        for end in ("a", "b"):
            moved = moved.join(joined.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("component", end)
        moved = moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e")
        left = stage(moved.groupBy("a", "b").agg(F.min("e").alias("e")), "edges")
    if not found:
        return edges.select("src", "dst", "weight").limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cut_forest(ids: DataFrame, forest: DataFrame, eps: float) -> DataFrame:
    """``(id, component)`` at one distance: the smallest id that steps of at most ``eps`` reach."""
    return connected_components(ids.select("id"), forest.filter(F.col("weight") <= eps).select("src", "dst"))


def eps_sweep(
    vectors: DataFrame, eps_values: list[float], block_vectors: int = BLOCK_VECTORS, single_task_edges: int = SINGLE_TASK_EDGES
) -> DataFrame:
    """``(eps, id, cluster)``: the clusters of :func:`vectors.dbscan` with ``min_samples=1`` for each ``eps``.

    Distances are computed once, however many values there are. Clusters of one ``eps`` are numbered from 0 by their smallest
    id; copies of a vector share its cluster, null vectors are noise (-1).
    """
    every, whole = staged_vectors(vectors)
    distinct, copies = distinct_vectors(whole, True)
    forest = stage(minimum_forest(spanning_edges(distinct, max(eps_values), block_vectors, eps_values), single_task_edges), "forest")
    tables = []
    for eps in eps_values:
        parts = stage(cut_forest(distinct, forest, eps), "parts")
        if copies is not None:
            parts = parts.unionByName(copies.join(parts.withColumnRenamed("id", "stands_for"), "stands_for").select("id", "component"))
        tables.append(parts.withColumn("eps", F.lit(float(eps))))
    labels = tables[0]
    for more in tables[1:]:
        labels = labels.unionByName(more)
    labels = stage(labels, "labels")
    heads = labels.select("eps", "component").distinct()
    numbers = stage(global_rank(heads, [F.col("eps"), F.col("component")], "n", single_task_rows=SINGLE_TASK_ROWS), "numbers")
    first = numbers.groupBy("eps").agg(F.min("n").alias("first"))
    numbered = numbers.join(F.broadcast(first), "eps").select("eps", "component", (F.col("n") - F.col("first")).cast("int").alias("cluster"))
    known = labels.join(numbered, ["eps", "component"]).select("eps", "id", "cluster")
    grid = every.select("id").withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in eps_values])))
    return grid.join(known, ["eps", "id"], "left").select("eps", "id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
