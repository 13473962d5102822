"""Density clusters kept up to date as vectors are added: only pairs with a new member are compared.

The state holds each distinct vector with its copies, how many vectors are near it, whether it is a core, and the
component of its core links. A vector that is no core has fewer than ``min_samples`` vectors near it, so its
whole neighbourhood is kept as pairs; when new vectors make it a core, its old links are known without a look at old vectors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalign.operators.components import connected_components
from catalign.operators.hierarchy import NOISE
from catalign.operators.vectors import BLOCK_VECTORS, Trees, block_sides, compared_blocks, staged_vectors, unit_vector
from catalign.runtime import SINGLE_TASK_ROWS, global_rank, spread, stage


class ClusterState(NamedTuple):
    """What a round leaves for the next one; all three are staged tables.

    ``members(id, raw, vec, copies, n, core, component)``, one row a distinct vector; ``near(src, dst)``, all
    neighbours of vectors that are no core; ``ids(id, stands_for)`` of every vector added, null if it has no distance.
    """

    members: DataFrame
    near: DataFrame
    ids: DataFrame


def empty_state(spark: SparkSession, id_type: str = "bigint") -> ClusterState:
    members = f"id {id_type}, raw array<double>, vec array<double>, copies bigint, n bigint, core boolean, component {id_type}"
    make = lambda schema: stage(spark.createDataFrame([], schema), "state")
    return ClusterState(make(members), make(f"src {id_type}, dst {id_type}"), make(f"id {id_type}, stands_for {id_type}"))


def _fresh_hits(pdf: pd.DataFrame, eps: float):
    """Both sides of a block pair, if they are the same one, and its parts: two slices and which pairs with a fresh member are near, each once."""
    left, right, alone, parts = block_sides(pdf)
    one, two = left["fresh"].to_numpy(bool), right["fresh"].to_numpy(bool)

    def hits():
        for at, to, same, distance in parts:
            hit = (distance <= eps) & (one[at][:, None] | two[to][None, :])
            yield at, to, np.triu(hit, 1) if same else hit

    return left, right, alone, hits()


def add_vectors(
    state: ClusterState, vectors: DataFrame, eps: float, min_samples: int, block_vectors: int = BLOCK_VECTORS
) -> ClusterState:
    """The state after ``vectors(id, embedding)`` are added; ids must be new, eps and min_samples the same in every round.

    Copies of known vectors and of each other are counted, not compared one by one. Null vectors belong to no cluster.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    every, whole = staged_vectors(vectors)
    # Zero vectors have no direction and stay apart, as in a run over all vectors.
    flat = ~F.exists("raw", lambda x: x != 0)
    rows = whole.select("id", "raw", F.when(flat, F.col("id")).alias("apart"))
    groups = stage(rows.groupBy("raw", "apart").agg(F.min("id").alias("first"), F.count("*").alias("delta")), "added")
    known = state.members.filter(F.exists("raw", lambda x: x != 0)).select("raw", F.col("id").alias("known"))
    groups = stage(groups.join(known, "raw", "left").select("raw", "apart", "delta", F.coalesce("known", "first").alias("rep"), F.col("known").isNull().alias("is_new")), "groups")
    stands = rows.join(groups.select("raw", "apart", "rep"), rows["raw"].eqNullSafe(groups["raw"]) & rows["apart"].eqNullSafe(groups["apart"]))
    stands = every.select("id").join(stands.select(rows["id"], F.col("rep").alias("stands_for")), "id", "left")
    ids = stage(state.ids.unionByName(stands), "ids")

    grown = groups.filter("not is_new").select(F.col("rep").alias("id"), "delta")
    old = state.members.join(grown, "id", "left").select(
        "id", "raw", "vec", (F.col("copies") + F.coalesce("delta", F.lit(0))).alias("copies"), "n", "core", "component",
        F.coalesce("delta", F.lit(0)).alias("delta"), F.lit(False).alias("is_new"),
    )
    new = groups.filter("is_new").select(
        F.col("rep").alias("id"), "raw", unit_vector(F.col("raw")).alias("vec"), F.col("delta").alias("copies"), F.lit(0).cast("bigint").alias("n"),
        F.lit(False).alias("core"), F.lit(None).cast(id_type).alias("component"), "delta", F.lit(True).alias("is_new"),
    )
    now = stage(old.unionByName(new), "members")

    def tally(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, alone, hits = _fresh_hits(pdf, eps)
        # A new vector counts all copies near it, a known one those that were added.
        is_new, copies, delta = ([side[c].to_numpy() for side in (left, right)] for c in ("is_new", "copies", "delta"))
        gain = [np.zeros(len(left)), np.zeros(len(right))]
        gain = [gain[0], gain[0]] if alone else gain
        for at, to, hit in hits:
            i, j = np.nonzero(hit)
            i, j = i + at.start, j + to.start
            gain[0] += np.bincount(i, np.where(is_new[0][i], copies[1][j], delta[1][j]), len(left))
            gain[1] += np.bincount(j, np.where(is_new[1][j], copies[0][i], delta[0][i]), len(right))
        sides = [(left, gain[0])] if alone else [(left, gain[0]), (right, gain[1])]
        out = pd.concat([pd.DataFrame({"id": side["id"], "gain": found.astype(np.int64)}) for side, found in sides])
        return out[out["gain"] > 0]

    def blocks(frame: DataFrame, fresh: str) -> DataFrame:
        small = frame.select("id", "vec", "copies", "delta", "is_new", "core", F.lit(0).alias("by"), F.expr(fresh).alias("fresh"))
        return spread(compared_blocks(small, eps, block_vectors), "by", "lo", "hi").groupBy("by", "lo", "hi")

    gains = blocks(now, "delta > 0").applyInPandas(tally, f"id {id_type}, gain bigint").groupBy("id").agg(F.sum("gain").alias("gain"))
    own = F.when(F.col("is_new"), F.col("copies")).otherwise(F.col("delta"))
    counted = now.join(gains, "id", "left").withColumn("n", F.col("n") + own + F.coalesce("gain", F.lit(0))).drop("gain")
    counted = stage(counted.withColumn("was_core", F.col("core")).withColumn("core", F.col("n") >= min_samples), "counted")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, alone, hits = _fresh_hits(pdf, eps)
        ids = [side["id"].to_numpy() for side in (left, right)]
        core = [side["core"].to_numpy(bool) for side in (left, right)]
        trees = Trees(len(left), len(right), alone)
        src, dst = [ids[0][:0]], [ids[0][:0]]
        for at, to, hit in hits:
            ca, cb = core[0][at][:, None], core[1][to][None, :]
            trees.add(at, to, hit & ca & cb)
            i, j = np.nonzero(hit & ~ca)
            src.append(ids[0][at][i])
            dst.append(ids[1][to][j])
            i, j = np.nonzero(hit & ~cb)
            src.append(ids[1][to][j])
            dst.append(ids[0][at][i])
        rows, columns = np.array(trees.rows, int), np.array(trees.columns, int)
        both = pd.DataFrame({"src": ids[0][rows], "dst": ids[1][columns], "both_core": True})
        return pd.concat([both, pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "both_core": False})])

    found = stage(blocks(counted, "is_new").applyInPandas(links, f"src {id_type}, dst {id_type}, both_core boolean"), "links")
    cores = stage(counted.filter("core").select("id", F.coalesce("component", "id").alias("component")), "cores")
    status = counted.select("id", "core", "was_core")
    # Known pairs of a vector that has just become a core, if the other end is one too.
    risen = state.near.join(status.filter("core and not was_core").select(F.col("id").alias("src")), "src")
    risen = risen.join(status.filter("core").select(F.col("id").alias("dst")), "dst").select("src", "dst")
    edges = found.filter("both_core").select("src", "dst").unionByName(risen)
    at = cores.withColumnRenamed("component", "at")
    for end in ("src", "dst"):
        edges = edges.join(at.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("at", end)
    heads = cores.select(F.col("component").alias("id")).distinct()
    merged = stage(connected_components(heads, stage(edges, "edges")), "merged").withColumnRenamed("component", "to").withColumnRenamed("id", "component")
    label = cores.join(merged, "component").select("id", F.col("to").alias("component"))
    members = counted.drop("component", "delta", "is_new", "was_core").join(label, "id", "left")
    loose = counted.filter("not core").select(F.col("id").alias("src"))
    near = state.near.unionByName(found.filter("not both_core").select("src", "dst")).join(loose, "src", "left_semi")
    return ClusterState(stage(members.select(*state.members.columns), "members"), stage(near, "near"), ids)


def cluster_labels(state: ClusterState, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """``(id, cluster)`` of every vector added, the same as :func:`vectors.dbscan` over all of them gives."""
    cores = state.members.filter("core").select(F.col("id").alias("stands_for"), "component")
    # A copy that was added later may have the smaller id.
    least = state.ids.join(cores, "stands_for").groupBy("component").agg(F.min("id").alias("least"))
    numbers = global_rank(least, [F.col("least")], "cluster", single_task_rows=single_task_rows)
    labelled = stage(cores.join(numbers, "component").select("stands_for", F.col("cluster").cast("int").alias("cluster")), "labels")
    border = state.near.join(labelled.withColumnRenamed("stands_for", "dst"), "dst").groupBy(F.col("src").alias("stands_for")).agg(F.min("cluster").alias("cluster"))
    known = labelled.unionByName(border)
    return state.ids.join(known, "stands_for", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
