"""Columns in attributes, at most one reading of a row each: a constrained assignment in place of chains.

Connected similar names chain: a is like b, b like c, and all become one attribute although a and c contradict each
other in the same rows. Here the partition is sought that keeps the most similarity inside attributes while
no attribute holds two columns that clash. Parts of the graph of similar names are independent and are solved in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalign.operators.components import connected_components
from catalign.runtime import stage

# Parts of up to so many columns are solved exactly, over all their partitions; larger ones step by step.
EXACT_COLUMNS = 11


def best_partition(n: int, gain: dict[tuple[int, int], float], clash: set[tuple[int, int]]) -> list[int]:
    """A label for each of ``n`` columns: the partition of the highest gain without a clash inside a part.

    Of equal gains the one with more parts wins, then the one that puts earlier columns together.
    """
    size = 1 << n
    worth, allowed = [0.0] * size, [True] * size
    for mask in range(1, size):
        low = (mask & -mask).bit_length() - 1
        rest = mask & (mask - 1)
        others = [i for i in range(low + 1, n) if rest >> i & 1]
        worth[mask] = worth[rest] + sum(gain.get((low, i), 0.0) for i in others)
        allowed[mask] = allowed[rest] and not any((low, i) in clash for i in others)
    best: list[tuple] = [(0.0, 0, 0)] + [()] * (size - 1)
    early = lambda mask: tuple(mask >> i & 1 for i in range(n))
    for mask in range(1, size):
        low, sub, found = mask & -mask, mask, None
        while sub:
            if sub & low and allowed[sub]:
                value, parts, _ = best[mask ^ sub]
                option = (worth[sub] + value, parts + 1)
                if found is None or option > found[:2] or (option == found[:2] and early(sub) > early(found[2])):
                    found = (*option, sub)
            sub = (sub - 1) & mask
        best[mask] = found
    labels, mask, label = [0] * n, size - 1, 0
    while mask:
        part = best[mask][2]
        for i in range(n):
            if part >> i & 1:
                labels[i] = label
        mask, label = mask ^ part, label + 1
    return labels


def grown_partition(n: int, gain: dict[tuple[int, int], float], clash: set[tuple[int, int]]) -> list[int]:
    """The same for many columns: the two parts that gain most are joined, then single columns move while that helps."""
    pair = lambda i, j: (min(i, j), max(i, j))
    near = [{} for _ in range(n)]
    for (i, j), g in gain.items():
        near[i][j] = near[j][i] = g
    against = [{j for i, j in clash if i == k} | {i for i, j in clash if j == k} for k in range(n)]
    parts = {i: {i} for i in range(n)}
    while True:
        at = {i: p for p, own in parts.items() for i in own}
        joint: dict[tuple[int, int], float] = {}
        for (i, j), g in gain.items():
            if at[i] != at[j]:
                joint[pair(at[i], at[j])] = joint.get(pair(at[i], at[j]), 0.0) + g
        fits = [(g, -p, -q) for (p, q), g in joint.items() if g > 0 and not any(against[i] & parts[q] for i in parts[p])]
        if not fits:
            break
        _, p, q = max(fits)
        parts[-p] |= parts.pop(-q)
    at = {i: p for p, own in parts.items() for i in own}
    moved = True
    while moved:
        moved = False
        for i in range(n):
            pull = lambda p: sum(g for j, g in near[i].items() if j != i and at[j] == p)  # noqa: B023, E731
            options = {at[j] for j in near[i]} - {at[i]}
            options = [(pull(p), -p) for p in options if not any(at[j] == p for j in against[i])]
            if options and max(options)[0] > pull(at[i]):
                at[i], moved = -max(options)[1], True
    numbers: dict[int, int] = {}
    return [numbers.setdefault(at[i], len(numbers)) for i in range(n)]


def assign_attributes(spark: SparkSession, columns: list[str], scores: DataFrame, facts: DataFrame, exact_columns: int = EXACT_COLUMNS) -> DataFrame:
    """``(column_name, attribute, position)``: each column under the first column of its attribute.

    ``scores(text1, text2, score)`` are similar names, ``facts(col1, col2, non_conflicting)`` tells of each pair of columns
    whether over a tenth of the rows that fill both differ (:func:`params.compatibility`). Columns without similar names
    stay alone. A part of up to ``exact_columns`` names is solved exactly; larger ones by joining and moving, which keeps the
    constraint but may miss the highest sum.
    """
    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "id bigint, column_name string")
    side = lambda n, c: names.select(F.col("column_name").alias(c), F.col("id").alias(n))
    ends = scores.join(side("i", "text1"), "text1").join(side("j", "text2"), "text2")
    gains = stage(ends.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "score").groupBy("i", "j").agg(F.max("score").alias("score")), "gains")
    bad = facts.filter("not non_conflicting").join(side("i", "col1"), "col1").join(side("j", "col2"), "col2")
    bad = bad.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(None).cast("double").alias("score"))
    parts = stage(connected_components(names.select("id"), gains.select(F.col("i").alias("src"), F.col("j").alias("dst"))), "parts")
    of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"p_{c}"))
    edges = gains.withColumn("score", F.col("score").cast("double")).unionByName(bad).join(of("i"), "i").join(of("j"), "j").filter("p_i = p_j")
    nodes = parts.select(F.col("component").alias("part"), F.col("id").alias("i"), F.lit(None).cast("bigint").alias("j"), F.lit(None).cast("double").alias("score"))
    work = nodes.unionByName(edges.select(F.col("p_i").alias("part"), "i", "j", "score"))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(pdf[pdf["j"].isna()]["i"].astype(int))
        place = {c: n for n, c in enumerate(own)}
        pairs = pdf[pdf["j"].notna()]
        keys = [(place[int(i)], place[int(j)]) for i, j in zip(pairs["i"], pairs["j"])]
        clash = {k for k, s in zip(keys, pairs["score"]) if pd.isna(s)}
        gain = {k: float(s) for k, s in zip(keys, pairs["score"]) if not pd.isna(s)}
        labels = (best_partition if len(own) <= exact_columns else grown_partition)(len(own), gain, clash)
        first: dict[int, int] = {}
        for c, label in zip(own, labels):
            first.setdefault(label, c)
        return pd.DataFrame({"id": own, "head": [first[label] for label in labels]})

    found = work.groupBy("part").applyInPandas(solved, "id bigint, head bigint")
    heads = names.select(F.col("id").alias("head"), F.col("column_name").alias("attribute"))
    return found.join(names, "id").join(heads, "head").select("column_name", "attribute", F.col("id").cast("int").alias("position"))
