import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalign.operators import vectors as X


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else list(v)


def plain_dbscan(vectors, eps, min_samples):
    ids = sorted(vectors)
    units = {i: unit(vectors[i]) for i in ids}
    near = {
        i: [j for j in ids if i == j or 1 - sum(a * b for a, b in zip(units[i], units[j])) <= eps] for i in ids
    }
    core = {i for i in ids if len(near[i]) >= min_samples}
    label, n = {}, 0
    for i in ids:
        if i in core and i not in label:
            stack = [i]
            while stack:
                p = stack.pop()
                if p in core and label.get(p) != n:
                    label[p] = n
                    stack.extend(q for q in near[p] if q in core and q not in label)
            n += 1
    for i in ids:
        if i not in core:
            label[i] = min((label[j] for j in near[i] if j in core), default=-1)
    return label


def clustered_vectors(n=160, dims=6, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    made = {i: (centres[i % 7] + rng.normal(scale=0.55, size=dims)).tolist() for i in range(n)}
    for i in range(n, n + 60):  # a third of all rows are copies of two vectors
        made[i] = made[3] if i % 2 else made[8]
    made[n + 60] = [0.0] * dims
    return made


@pytest.mark.parametrize("block_vectors", [1024, 12])
@pytest.mark.parametrize("eps,min_samples", [(0.08, 3), (0.2, 1), (0.05, 5)])
def test_dbscan_against_plain(spark, block_vectors, eps, min_samples):
    made = clustered_vectors()
    df = spark.createDataFrame(list(made.items()), "id long, embedding array<double>").repartition(5)
    got = X.dbscan(df, eps, min_samples, block_vectors, single_task_rows=1_000_000 if block_vectors > 100 else 3)
    assert {r["id"]: r["cluster"] for r in got.collect()} == plain_dbscan(made, eps, min_samples)


def test_border_point_takes_the_lower_cluster(spark):
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    made = {0: angle(0), 1: angle(1), 2: angle(2), 3: angle(30), 4: angle(31), 5: angle(32), 9: angle(16)}
    df = spark.createDataFrame(list(made.items()), "id long, embedding array<double>")
    eps = 1 - math.cos(math.radians(14.5))
    got = {r["id"]: r["cluster"] for r in X.dbscan(df, eps, 4).collect()}
    assert got == plain_dbscan(made, eps, 4)


@pytest.mark.parametrize("block_vectors", [1024, 10])
def test_cosine_pairs_are_complete(spark, block_vectors):
    made = clustered_vectors()
    df = spark.createDataFrame(list(made.items()), "id long, embedding array<double>")
    first = {}
    for i in sorted(made):
        key = tuple(made[i])
        first.setdefault(key, i)
    heads = sorted(first.values())
    dist = lambda a, b: 1 - sum(x * y for x, y in zip(unit(made[a]), unit(made[b])))
    want = {(a, b) for a in heads for b in heads if a < b and dist(a, b) <= 0.1}
    got = [(r["id1"], r["id2"]) for r in X.cosine_pairs(df, 0.1, block_vectors=block_vectors).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_distance_is_the_builtin_formula(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert abs(df.select(X.cosine_distance(F.col("a"), F.col("b"))).first()[0] - (1 - 1 / math.sqrt(2))) < 1e-12


def test_weighted_embedding_halves_and_thirds(spark):
    cats = spark.createDataFrame([("A/B/C/D", 0), ("//", 1), ("A", 2)], "category string, first_row_id long")
    table = {"A": [1.0, 0, 0, 0], "B": [0, 1.0, 0, 0], "C": [0, 0, 1.0, 0], "D": [0, 0, 0, 1.0], "//": [4.0, 4, 4, 4]}
    known = spark.createDataFrame(list({k: [float(x) for x in v] for k, v in table.items()}.items()), "text string, embedding array<double>")
    got = {r[0]: r[2] for r in X.weighted_embedding(cats, lambda t: t.join(known, "text")).collect()}
    assert np.allclose(got["A/B/C/D"], [1 / 3, 1 / 6, 1 / 9, 0])
    assert got["//"] == [4.0] * 4 and got["A"] == [1.0, 0, 0, 0]


def test_model_embedding_runs_once_per_distinct_text(spark):
    def make_predict():
        def predict(texts):
            return np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

        return predict

    df = spark.createDataFrame([("ab",), ("ab",), ("xyz",)], "text string")
    got = {r["text"]: r["embedding"] for r in X.embed_with_model(df, make_predict).collect()}
    assert got == {"ab": [2.0, 1.0], "xyz": [3.0, 1.0]}


def test_strategies(spark):
    cats = spark.createDataFrame([("A/x", 0), ("B/x", 1), ("B/y", 2)], "category string, first_row_id long")
    for strategy in ("weighted_combined", "detailed_first", "parent_fallback"):
        assert X.hierarchical_clusters(cats, strategy=strategy).count() == 3


def test_null_vectors_are_noise_and_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.1]), (4, [None, 1.0])], "id long, embedding array<double>")
    got = {r["id"]: r["cluster"] for r in X.dbscan(df, 0.2, 2).collect()}
    assert got == {1: 0, 2: -1, 3: 0, 4: -1}
    assert [(r["id1"], r["id2"]) for r in X.cosine_pairs(df, 0.2).collect()] == [(1, 3)]
    with pytest.raises(ValueError):
        X.dbscan(df.unionByName(spark.createDataFrame([(5, [1.0])], df.schema)))


def test_vectors_are_sent_a_bounded_number_of_times(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 8)))]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    unit = df.select("id", X.unit_vector(F.col("embedding")).alias("vec"), F.lit(0).alias("by"))
    sent = X.compared_blocks(unit, 2.0, 5)
    # Blocks of 5 would send each vector 300 times and more.
    assert sent.count() <= 1500 * 50
    assert {tuple(r) for r in X.dbscan(df, 0.02, 3, block_vectors=5).collect()} == {tuple(r) for r in X.dbscan(df, 0.02, 3).collect()}


def test_parts_of_large_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    left, right = rng.normal(size=(23, 3)), rng.normal(size=(17, 3))
    frame = lambda pts, side, lo: pd.DataFrame({"id": range(len(pts)), "vec": list(pts / np.linalg.norm(pts, axis=1)[:, None]), "side": side, "lo": lo, "hi": 1})
    for pdf, alone in ((pd.concat([frame(left, 0, 0), frame(right, 1, 0)]), False), (frame(left, 0, 1), True)):
        outcomes = []
        for part in (1024, 6):
            monkeypatch.setattr(X, "PART_VECTORS", part)
            one, two, is_alone, parts = X.block_sides(pdf)
            near = np.zeros((len(one), len(two)), int)
            trees = X.Trees(len(one), len(two), is_alone)
            for at, to, same, distance in parts:
                near[at, to] += distance <= 0.1
                trees.add(at, to, distance <= 0.1)
                if is_alone and not same:
                    near.T[at, to] += distance <= 0.1
            outcomes.append((is_alone, near.tolist(), len(trees.rows), [int((trees.label == x).argmax()) for x in trees.label]))
        assert outcomes[0] == outcomes[1] and outcomes[0][0] == alone and max(map(max, outcomes[0][1])) == 1
