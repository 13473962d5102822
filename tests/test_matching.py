"""Attribute assignment against all partitions, and linkage weights against EM over single pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalign.operators import assignment as B
from catalign.operators import record_linkage as R


def partitions(n):
    def grow(labels):
        if len(labels) == n:
            yield labels
            return
        for label in range(max(labels, default=-1) + 2):
            yield from grow([*labels, label])

    return grow([])


def value(labels, gain):
    return sum(g for (i, j), g in gain.items() if labels[i] == labels[j])


def instance(seed, n):
    rng = random.Random(seed)
    pairs = list(itertools.combinations(range(n), 2))
    return {p: float(rng.randrange(50, 60)) for p in pairs if rng.random() < 0.5}, {p for p in pairs if rng.random() < 0.3}


@pytest.mark.parametrize("seed", range(8))
def test_best_partition_of_seven_columns(seed):
    gain, clash = instance(seed, 7)
    allowed = [p for p in partitions(7) if not any(p[i] == p[j] for i, j in clash)]
    want = max(allowed, key=lambda p: (value(p, gain), max(p), [-x for x in p]))
    assert B.best_partition(7, gain, clash) == want


@pytest.mark.parametrize("seed", range(8))
def test_grown_partitions_keep_the_constraint_and_most_of_the_gain(seed):
    gain, clash = instance(seed, 9)
    best, grown = B.best_partition(9, gain, clash), B.grown_partition(9, gain, clash)
    assert not any(grown[i] == grown[j] for i, j in clash) and value(grown, gain) >= 0.8 * value(best, gain)
    assert grown[0] == 0 and all(x <= max(grown[:i], default=-1) + 1 for i, x in enumerate(grown))


@pytest.mark.parametrize("exact", [11, 2])
def test_chains_are_cut_where_columns_clash(spark, exact):
    columns = ["a1", "a2", "a3", "b", "lone", "c1", "c2"]
    scores = spark.createDataFrame([("a1", "a2", 90.0), ("a2", "a3", 80.0), ("a3", "a2", 70.0), ("c2", "c1", 60.0), ("gone", "a1", 99.0)], "text1 string, text2 string, score double")
    facts = spark.createDataFrame([("a1", "a3", False), ("a1", "a2", True), ("a1", "b", False), ("c1", "c2", True)], "col1 string, col2 string, non_conflicting boolean")
    got = {r.column_name: (r.attribute, r.position) for r in B.assign_attributes(spark, columns, scores, facts, exact).collect()}
    assert got == {"a1": ("a1", 0), "a2": ("a1", 1), "a3": ("a3", 2), "b": ("b", 3), "lone": ("lone", 4), "c1": ("c1", 5), "c2": ("c1", 6)}
    assert B.assign_attributes(spark, ["x"], scores, facts).collect()[0].attribute == "x"


def brute_em(pairs, n_levels, rounds):
    """The same model, pair by pair and in plain Python."""
    match = [[(i + 1) ** 2 / sum((k + 1) ** 2 for k in range(n)) for i in range(n)] for n in n_levels]

    def shares(weights):
        out = []
        for f, n in enumerate(n_levels):
            mass = [sum(w for p, w in zip(pairs, weights) if p[f] == k) for k in range(n)]
            out.append([max(m / sum(mass), R.LEAST) for m in mass])
        return out

    other, prior = shares([1.0] * len(pairs)), 0.1
    for _ in range(rounds):
        post = []
        for p in pairs:
            m = math.prod([prior] + [match[f][x] for f, x in enumerate(p) if x >= 0])
            u = math.prod([1 - prior] + [other[f][x] for f, x in enumerate(p) if x >= 0])
            post.append(m / (m + u))
        match, other, prior = shares(post), shares([1 - w for w in post]), sum(post) / len(post)
    return prior, match, other


def pair_levels(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        same = rng.random() < 0.2
        level = lambda hi: -1 if rng.random() < 0.05 else (hi if rng.random() < (0.9 if same else 0.15) else rng.randrange(hi))  # noqa: B023, E731
        rows.append((level(2), level(1), level(1)))
    return rows


def test_weights_over_patterns_equal_em_over_pairs(spark):
    pairs = pair_levels(1)
    df = spark.createDataFrame(pairs, "t int, u int, v int")
    patterns = [tuple(r) for r in R.pattern_counts(df, ["t", "u", "v"]).collect()]
    assert len(patterns) < 50 and sum(p[-1] for p in patterns) == 600
    got = R.fit_weights(patterns, [3, 2, 2], rounds=30, tolerance=0)
    prior, match, other = brute_em(pairs, [3, 2, 2], 30)
    assert abs(got.prior - prior) < 1e-9 and np.allclose([*got.match[0], *got.match[1]], [*match[0], *match[1]]) and np.allclose(got.other[2], other[2])
    assert abs(R.fit_weights(patterns, [3, 2, 2]).prior - 0.2) < 0.06


def test_matches_have_the_posterior_of_their_pattern(spark):
    fields, sizes = ["t", "u", "v"], [3, 2, 2]
    df = spark.createDataFrame([(str(i), *p) for i, p in enumerate(pair_levels(2))], "text1 string, t int, u int, v int")
    found, weights = R.match_records(df, fields, sizes, 0.8)
    rows = {r.text1: r for r in found.collect()}
    for i, p in enumerate(pair_levels(2)):
        m = math.prod([weights.prior] + [weights.match[f][x] for f, x in enumerate(p) if x >= 0])
        u = math.prod([1 - weights.prior] + [weights.other[f][x] for f, x in enumerate(p) if x >= 0])
        assert (str(i) in rows) == (m / (m + u) >= 0.8)
        if str(i) in rows:
            assert abs(rows[str(i)].probability - m / (m + u)) < 1e-9 and abs(rows[str(i)].weight - math.log2(m / u)) < 1e-9
    table = R.weight_table(spark, fields, weights)
    assert table.count() == 7 and table.filter("level = 2 and field = 't'").first()["weight"] > 1


def test_levels_of_records_and_missing_values(spark):
    records = spark.createDataFrame([("x", "red", 1.0), ("y", None, 2.0), ("z", "red", None)], "name string, color string, size double")
    pairs = spark.createDataFrame([("x", "y", 95.0), ("x", "z", 91.0), ("x", "gone", 99.0)], "text1 string, text2 string, score double")
    levels = {
        "title": R.banded_level(F.col("score"), [93, 97]),
        "color": R.equal_level(F.col("a_color"), F.col("b_color")),
        "size": R.banded_level(F.col("a_size") / F.col("b_size"), [0.4]),
    }
    got = {r.text2: (r.title, r.color, r.size) for r in R.compare_records(pairs, records, "name", levels).collect()}
    assert got == {"y": (1, -1, 1), "z": (0, 1, -1)}


def test_no_pairs_teach_nothing(spark):
    weights = R.fit_weights([], [3, 2])
    assert weights.prior == 0.1 and all(abs(sum(m) - 1) < 1e-9 for m in weights.match)
    none = spark.createDataFrame([], "text1 string, t int, u int")
    assert R.match_records(none, ["t", "u"], [3, 2])[0].collect() == []
