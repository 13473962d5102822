"""The random-projection index and the spanning forest against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalign.operators import forest as W
from catalign.operators import neighbours as H
from catalign.operators import rounds as R
from catalign.operators import vectors as X


def clouds(rng, n, dims=16, centres=12, spread=0.5):
    middle = rng.standard_normal((centres, dims))
    return middle[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dims))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)


def distances(points):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    return 1 - unit @ unit.T


def exact_pairs(points, eps):
    far = distances(points)
    return {(i, j): far[i, j] for i in range(len(points)) for j in range(i + 1, len(points)) if far[i, j] <= eps}


@pytest.mark.parametrize(
    "eps,plan,block", [(0.6, None, 1024), (0.6, H.Plan(8, 2, 6), 50), (0.2, H.Plan(10, 1, 12), 1024), (0.1, H.Plan(12, 0, 14), 30)]
)
def test_index_finds_nine_of_ten_pairs_and_no_wrong_ones(spark, eps, plan, block):
    points = clouds(np.random.default_rng(7), 400)
    want = exact_pairs(points, eps)
    got = [tuple(r) for r in H.lsh_pairs(frame(spark, [(i, p.tolist()) for i, p in enumerate(points)]), eps, plan=plan, block_vectors=block).collect()]
    pairs = {(a, b): d for a, b, d in got}
    assert len(pairs) == len(got) and set(pairs) <= set(want) and all(abs(pairs[k] - want[k]) < 1e-9 for k in pairs)
    assert len(pairs) >= 0.9 * len(want) > 100


def test_a_crowded_bucket_is_compared_whole(spark):
    rng = np.random.default_rng(8)
    points = np.ones((150, 8)) + 0.01 * rng.standard_normal((150, 8))
    got = H.lsh_pairs(frame(spark, [(i, p.tolist()) for i, p in enumerate(points)]), 0.5, plan=H.Plan(4, 1, 3), block_vectors=20)
    assert got.count() == 150 * 149 // 2


def test_copies_null_and_no_vectors(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.99, 0.01]), (7, None), (8, [None, 1.0])]
    assert [tuple(r)[:2] for r in H.lsh_pairs(frame(spark, rows), 0.1, recall=0.999999).collect()] == [(3, 9)]
    assert H.lsh_pairs(frame(spark, []), 0.1).collect() == [] and H.lsh_pairs(frame(spark, [(1, [1.0])]), 0.1).collect() == []


def test_plans_meet_the_recall_and_grow_with_the_table():
    for n in (100, 10**6, 10**9):
        for eps in (0.05, 0.2, 0.6):
            plan = H.plan_index(n, eps, 0.95)
            assert 1 - (1 - H.hit_chance(eps, plan.bits, plan.radius)) ** plan.tables >= 0.95
    assert H.plan_index(10**9, 0.1, 0.9).bits > H.plan_index(1000, 0.1, 0.9).bits


def test_plans_of_wide_neighbourhoods_send_few_rows():
    for n in (10**5, 6 * 10**5):
        plan = H.plan_index(n, 0.6, 0.99)
        # Of two neighbouring buckets one vector visits the other's.
        assert plan.tables * (1 + sum(math.comb(plan.bits, i) for i in range(plan.radius + 1))) / 2 <= 40


def brute_labels(points, ids, eps):
    far = distances(points)
    label = list(range(len(points)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in zip(*np.nonzero(far <= eps)):
        a, b = root(i), root(j)
        if a != b:
            label[max(a, b)] = min(a, b)
    return {ids[i]: ids[root(i)] for i in range(len(points))}


@pytest.mark.parametrize("block,single", [(1024, 10**6), (30, 0), (45, 40)])
def test_sweep_equals_the_components_of_each_width(spark, block, single):
    rng = np.random.default_rng(block)
    points = clouds(rng, 160, dims=6)
    rows = [(10 + i, p.tolist()) for i, p in enumerate(points)]
    extra = [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None)]
    widths = [0.01, 0.05, 0.2, 0.5, 1.0, 2.0]
    got = W.eps_sweep(frame(spark, rows + extra), widths, block, single).collect()
    assert len(got) == len(widths) * 163
    for eps in widths:
        want = brute_labels(points, [r[0] for r in rows], eps)
        numbers = {c: n for n, c in enumerate(sorted(set(want.values())))}
        own = {r.id: r.cluster for r in got if r.eps == eps}
        assert own.pop(1000) == own.pop(1001) == own[15] and own.pop(1002) == -1
        assert own == {i: numbers[c] for i, c in want.items()}


def test_sweep_agrees_with_density_clusters(spark):
    points = clouds(np.random.default_rng(3), 80)
    df = frame(spark, [(i, p.tolist()) for i, p in enumerate(points)])
    sweep = {(r.eps, r.id): r.cluster for r in W.eps_sweep(df, [0.1, 0.3]).collect()}
    for eps in (0.1, 0.3):
        assert {r.id: r.cluster for r in X.dbscan(df, eps, 1).collect()} == {i: c for (e, i), c in sweep.items() if e == eps}


@pytest.mark.parametrize("single", [0, 10, 10**6])
def test_forest_of_edges_with_ties_parallels_and_loops(spark, single):
    rng = random.Random(single)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(4))) for _ in range(150)] + [(100, 101, 1.0), (101, 100, 0.5)]
    got = W.minimum_forest(spark.createDataFrame(edges, "src long, dst long, weight double"), single).collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    total, n = 0.0, 0
    for a, b, w in sorted(((min(a, b), max(a, b), w) for a, b, w in edges if a != b), key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total, n = total + w, n + 1
    assert len(got) == n and abs(sum(r.weight for r in got) - total) < 1e-9
    assert W.minimum_forest(spark.createDataFrame([], "src long, dst long, weight double"), single).collect() == []


@pytest.mark.parametrize("alone", [True, False])
def test_forest_of_a_matrix(alone):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 5, (40, 2)).astype(float)
    far = np.abs(points[:, None] - points[None]).sum(2)
    far = far if alone else far[:15, 15:]
    i, j = W.local_forest(far, alone, 2.0)
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = n = 0
    ends = [(a, b, far[a, b]) for a in range(far.shape[0]) for b in range(far.shape[1]) if far[a, b] <= 2.0 and (not alone or a < b)]
    for a, b, w in sorted(ends, key=lambda e: e[2]):
        a, b = find(a), find(b if alone else b + 15)
        if a != b:
            root[a] = b
            total, n = total + w, n + 1
    assert len(i) == n and far[i, j].sum() == total


def test_sweep_of_nothing(spark):
    assert W.eps_sweep(frame(spark, []), [0.5]).collect() == []
    assert [tuple(r) for r in W.eps_sweep(frame(spark, [(4, None)]), [0.5]).collect()] == [(0.5, 4, -1)]


def test_clusters_of_the_table_need_no_collected_vectors(spark):
    df = frame(spark, [(i, [1.0, float(i)]) for i in range(20)]).withColumn("by", F.lit(1))
    assert W.eps_sweep(df.drop("by"), [2.0]).select("cluster").distinct().count() == 1


@pytest.mark.parametrize("eps,least,block", [(0.04, 3, 1024), (0.02, 1, 40), (0.05, 5, 25)])
def test_rounds_give_the_clusters_of_a_full_run(spark, eps, least, block):
    rng = np.random.default_rng(least)
    points = clouds(rng, 150, dims=5, centres=9, spread=0.3)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(200 + i, rows[i % 30][1]) for i in range(60)] + [(300 + i, rows[7][1]) for i in range(20)]
    rows += [(400, None), (401, [0.0] * 5), (402, [0.0] * 5), (-3, rows[11][1])]
    random.Random(least).shuffle(rows)
    state = R.empty_state(spark)
    seen = []
    for cut in (rows[:90], [], rows[90:200], rows[200:]):
        seen += cut
        state = R.add_vectors(state, frame(spark, cut), eps, least, block)
    got = {r.id: r.cluster for r in R.cluster_labels(state).collect()}
    want = {r.id: r.cluster for r in X.dbscan(frame(spark, rows), eps, least).collect()}
    assert got == want and len(set(want.values())) > 3
    # What is kept of neighbourhoods is bounded by the vectors that are no core.
    assert all(r["count"] < least for r in state.near.groupBy("src").count().collect())


def test_old_vectors_are_not_compared_again(spark):
    df = frame(spark, [(i, [1.0, float(i)]) for i in range(100)])
    mixed = df.select("id", X.unit_vector(F.col("embedding")).alias("vec"), F.lit(0).alias("by"), (F.col("id") < 10).alias("fresh"))
    met = X.compared_blocks(mixed, 2.0, 20).groupBy("lo", "hi").agg(F.bool_or("fresh").alias("any"), F.bool_and("fresh").alias("all"), F.count_distinct("fresh").alias("n"))
    facts = met.collect()
    assert len(facts) > 5 and all(r["any"] for r in facts) and any(r["n"] == 2 for r in facts)
