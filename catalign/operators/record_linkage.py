"""Probabilistic record linkage: weights of agreement learned by EM over counted comparison patterns.

Candidate pairs come from a similarity join. Each pair becomes a pattern, one level of agreement a field, and patterns
are counted, so EM runs over as many rows as there are patterns, however many pairs there are. A pair's weight is the sum of its
fields' log2(m / u) (Fellegi and Sunter).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalign.functions.measures import let

# A share below this counts as this, so that no weight is infinite.
LEAST = 1e-6


class Weights(NamedTuple):
    """Share of matches among the pairs, and for each field the share of each level among matches and others."""

    prior: float
    match: list[list[float]]
    other: list[list[float]]


def equal_level(a: Column, b: Column) -> Column:
    """1 if equal, 0 if not, null if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("int"))


def banded_level(value: Column, limits: list[float]) -> Column:
    """How many of the ascending limits a value reaches."""
    level = F.lit(0)
    for limit in limits:
        level = level + F.when(value >= limit, 1).otherwise(0)
    return F.when(value.isNotNull(), level)


def compare_records(pairs: DataFrame, records: DataFrame, key: str, levels: dict[str, Column]) -> DataFrame:
    """``pairs(text1, text2, …)`` plus a level for each field, -1 where a value is missing.

    ``records`` has one row for each value of ``key``; in the expressions of ``levels`` its columns are called
    ``a_…`` and ``b_…`` for the two sides, next to the columns of ``pairs``.
    """
    side = lambda s, end: records.select(*[F.col(f"`{c}`").alias(end if c == key else f"{s}_{c}") for c in records.columns])
    both = pairs.join(side("a", "text1"), "text1").join(side("b", "text2"), "text2")
    found = [F.coalesce(level.cast("int"), F.lit(-1)).alias(name) for name, level in levels.items()]
    return both.select(*pairs.columns, *found)


def pattern_counts(compared: DataFrame, fields: list[str]) -> DataFrame:
    """How many pairs have each combination of levels; as many rows as there are combinations at most."""
    return compared.groupBy(*fields).agg(F.count("*").alias("n_pairs"))


def fit_weights(patterns: list[tuple], n_levels: list[int], rounds: int = 200, tolerance: float = 1e-10) -> Weights:
    """EM for two classes with independent fields over ``(levels…, count)`` rows.

    Levels run from 0, the highest agreeing best; -1 says nothing about a pair. The classes start with
    agreement falling off for matches and the shares of all pairs for the others. Without any pairs nothing is learned.
    """
    levels = np.array([p[:-1] for p in patterns], int).reshape(len(patterns), len(n_levels))
    counts = np.array([p[-1] for p in patterns], float)
    start = [np.arange(1, n + 1) ** 2.0 for n in n_levels]
    match = [s / s.sum() for s in start]
    total = counts.sum()

    def shares(weight: np.ndarray) -> list[np.ndarray]:
        out = []
        for f, n in enumerate(n_levels):
            known = levels[:, f] >= 0
            mass = np.bincount(levels[known, f], weights=weight[known], minlength=n)[:n]
            out.append(np.maximum(mass / mass.sum() if mass.sum() > 0 else np.full(n, 1 / n), LEAST))
        return out

    other, prior = shares(counts), 0.1
    for _ in range(rounds if total else 0):
        chance = [np.full(len(patterns), p) for p in (prior, 1 - prior)]
        for f in range(len(n_levels)):
            known = levels[:, f] >= 0
            for side, table in zip(chance, (match, other)):
                side[known] *= table[f][levels[known, f]]
        posterior = chance[0] / (chance[0] + chance[1])
        new = float((counts * posterior).sum() / total)
        match, other = shares(counts * posterior), shares(counts * (1 - posterior))
        done, prior = abs(new - prior) < tolerance, min(max(new, LEAST), 1 - LEAST)
        if done:
            break
    return Weights(prior, [m.tolist() for m in match], [u.tolist() for u in other])


def weight_table(spark: SparkSession, fields: list[str], weights: Weights) -> DataFrame:
    """``(field, level, m, u, weight)`` to read."""
    rows = [
        (field, level, m, u, float(np.log2(m / u)))
        for field, ms, us in zip(fields, weights.match, weights.other)
        for level, (m, u) in enumerate(zip(ms, us))
    ]
    return spark.createDataFrame(rows, "field string, level int, m double, u double, weight double")


def score_pairs(compared: DataFrame, fields: list[str], weights: Weights) -> DataFrame:
    """Each pair with its ``weight`` and the ``probability`` that it is a match, row by row."""
    total = F.lit(float(np.log2(weights.prior / (1 - weights.prior))))
    for field, ms, us in zip(fields, weights.match, weights.other):
        steps = F.array(*[F.lit(float(np.log2(m / u))) for m, u in zip(ms, us)])
        total = total + F.when(F.col(field) >= 0, F.get(steps, F.col(field))).otherwise(0.0)
    probability = let(F.pow(F.lit(2.0), F.least(F.col("weight"), F.lit(500.0))), lambda odds: odds / (1 + odds))
    return compared.withColumn("weight", total).withColumn("probability", probability)


def match_records(compared: DataFrame, fields: list[str], n_levels: list[int], least: float = 0.9) -> tuple[DataFrame, Weights]:
    """The pairs that are matches with probability ``least`` or more, and the weights learned from all pairs."""
    patterns = [tuple(r) for r in pattern_counts(compared, fields).orderBy(*fields).collect()]  # one row a pattern
    weights = fit_weights(patterns, n_levels)
    return score_pairs(compared, fields, weights).filter(F.col("probability") >= least), weights
