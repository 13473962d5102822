import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from catalign.operators import groups as G
from catalign.operators import hierarchy as H
from catalign.operators import overlap as O
from catalign.operators import schema as S
from catalign.runtime import stage
from suite import vector_queries


def cats(spark, names):
    return spark.createDataFrame([(c, i) for i, c in enumerate(names)], "category string, first_row_id long")


def labels(df):
    return {r["original_category"]: r["cluster"] for r in df.collect()}


def test_levels_trim_and_fill(spark):
    df = spark.createDataFrame([(1, " A / B"), (2, "A//C"), (3, None)], "row_id long, category string")
    wide, depth = H.parse_levels(df)
    assert depth == 3
    got = {r["row_id"]: [r[f"category_level_{i}"] for i in (1, 2, 3)] for r in wide.collect()}
    assert got == {1: ["A", "B", ""], 2: ["A", "", "C"], 3: ["", "", ""]}


def test_separator_is_literal(spark):
    df = spark.createDataFrame([("A|B.C",)], "category string")
    assert [r[0] for r in df.select(H.levels_of(F.col("category"), "|")).collect()] == [["A", "B.C"]]


def test_detailed_first_joins_equal_deepest_values(spark):
    got = labels(H.cluster_detailed_first(cats(spark, ["A/x", "B/x", "A", "x", "C/x/y", "//"])))
    assert got == {"C/x/y": 0, "A/x": 1, "B/x": 1, "A": 2, "x": 4}


@pytest.mark.parametrize("single_task_rows", [1_000_000, 2])
def test_parent_fallback(spark, single_task_rows):
    names = ["A/x", "B/x", "C/y", "C/z", "C", "D/q"]
    got = labels(H.cluster_parent_fallback(cats(spark, names), single_task_rows=single_task_rows))
    assert got == {"A/x": 0, "B/x": 0, "C/y": 1, "C/z": 1, "C": 1, "D/q": -1}


def clusters(spark):
    rows = [("a", 0, 0), ("b", 1, 0), ("c", 2, -1), ("d", 3, -1), ("e", 4, 1)]
    return spark.createDataFrame(rows, "original_category string, first_row_id long, cluster int")


def pairs(df):
    return {(r["category"], r["group_name"]) for r in df.collect()}


def test_auto_and_manual_joins_differ_on_noise_and_singles(spark):
    found = clusters(spark)
    assert pairs(G.auto_assignments(found)) == {("a", "a"), ("b", "a")}
    chosen = spark.createDataFrame([(-1,), (1,)], "cluster int")
    assert pairs(G.join_clusters(found, chosen)) == {("c", "c"), ("d", "c"), ("e", "e")}


def test_latest_round_wins(spark):
    rows = [("a", "g1", "auto", 1), ("a", "g3", "join", 2), ("a", "g2", "manual", 2)]
    got = G.resolve_assignments(spark.createDataFrame(rows, G.ASSIGNMENT_SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("a", "g2")]


def test_cross_source_filter_keeps_representatives_of_single_source_groups(spark):
    rows = [(1, "s1", "a", "a"), (2, "s1", "b", "a"), (3, "s1", "c", "c"), (4, "s2", "d", "e"), (5, "s1", "e", "e"), (6, "s1", "f", None)]
    df = spark.createDataFrame(rows, "row_id long, source_file string, category string, group_name string")
    assert sorted(r["row_id"] for r in G.cross_source_filter(df).collect()) == [1, 3, 4, 5]
    assert tuple(G.filter_diagnostics(G.cross_source_filter(df)).first()) == (3, 1)


def test_manual_merge_refuses_fixed_and_nameless(spark):
    fixed = spark.createDataFrame([("a", "g", "auto", 1)], G.ASSIGNMENT_SCHEMA)
    one = spark.createDataFrame([("a",)], "category string")
    with pytest.raises(ValueError, match="already"):
        G.manual_merge(fixed, one, "n", 2)
    with pytest.raises(ValueError, match="name"):
        G.manual_merge(fixed, one, "", 2)


def test_final_group_priority(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "row_id long, category string")
    working = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "c")], "row_id long, category string, group_name string")
    fixed = spark.createDataFrame([("a", "g", "auto", 1), ("d", "h", "auto", 1)], G.ASSIGNMENT_SCHEMA)
    got = {r["category"]: r["group_name"] for r in G.final_groups(df, working, fixed).collect()}
    assert got == {"a": "g", "b": "y", "c": "ungrouped", "d": "h"}
    summary = G.group_summary(G.final_groups(df, working, fixed)).first()
    assert tuple(summary) == (4, 3, 25.0)


def test_results_do_not_depend_on_row_order(spark):
    rows = [(i, f"s{i % 3}", f"{'AB'[i % 2]}/{i % 5}") for i in range(60)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    outcomes = []
    for data, parts in ((rows, 1), (shuffled, 7)):
        df = spark.createDataFrame(data, "row_id long, source_file string, category string").repartition(parts)
        outcomes.append(sorted(map(tuple, H.cluster_detailed_first(S.distinct_categories(df)).collect())))
    assert outcomes[0] == outcomes[1]


def plain_overlap(sets, t):
    heads, out = {}, set()
    for c in sorted(sets):
        heads.setdefault(frozenset(sets[c]), c)
    for c, s in sets.items():
        head = heads[frozenset(s)]
        if head != c:
            out.add((head, c, len(s), 1.0))
    names = sorted(heads.values())
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared / len(sets[a] | sets[b]) >= t:
                out.add((a, b, shared, shared / len(sets[a] | sets[b])))
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_product_overlap_against_plain(spark, threshold):
    rnd = random.Random(2)
    sets = {f"c{i}": {f"p{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randint(1, 15))} | {"everywhere"} for i in range(60)}
    sets["copy"] = set(sets["c1"])
    df = spark.createDataFrame([(c, p) for c, s in sets.items() for p in s] * 2, "category string, product_name string")
    got = {tuple(r) for r in O.product_overlap(df, threshold).collect()}
    want = plain_overlap(sets, threshold)
    assert {g[:3] for g in got} == {w[:3] for w in want}
    assert {g[:2]: round(g[3], 9) for g in got} == {w[:2]: round(w[3], 9) for w in want}


@pytest.mark.parametrize("holders", [1024, 5])
def test_only_sets_that_share_enough_are_compared(spark, monkeypatch, holders):
    rnd = random.Random(5)
    sets = {f"c{i}": set(rnd.sample(range(400), 60 + i)) for i in range(40)}
    sets["near"] = set(list(sets["c1"])[:50])
    staged = {}
    monkeypatch.setattr(O, "stage", lambda df, name="stage": staged.setdefault(name, stage(df, name)))
    monkeypatch.setattr(O, "BLOCK_HOLDERS", holders, raising=False)
    df = spark.createDataFrame([(c, f"p{p}") for c, s in sets.items() for p in s], "category string, product_name string")
    got = {tuple(r)[:3] for r in O.product_overlap(df, 0.4).collect()}
    assert got == {w[:3] for w in plain_overlap(sets, 0.4)} and ("c1", "near", 50) in got
    # Nearly all of the 820 pairs share a product.
    assert staged["candidates"].count() <= 10


@pytest.mark.parametrize("holders", [1024, 2])
def test_every_copy_of_a_set_makes_its_own_pairs(spark, monkeypatch, holders):
    rnd = random.Random(7)
    kinds = [set(rnd.sample(range(30), 12)) for _ in range(8)]
    sets = {f"c{i}": kinds[i % 8 if i < 24 else 0] for i in range(30)} | {"alone": {99}, "also alone": {99}}
    monkeypatch.setattr(O, "BLOCK_HOLDERS", holders)
    df = spark.createDataFrame([(c, p) for c, s in sets.items() for p in s] * 2, "category string, product_name long")
    got = [(*r[:3], round(r[3], 9)) for r in O.product_overlap(df, 0.3, every_copy=True).collect()]
    want = {
        (a, b, len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9))
        for a, b in itertools.combinations(sorted(sets), 2)
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3
    }
    assert len(got) == len(want) and set(got) == want and ("alone", "also alone", 1, 1.0) in want


def test_suppliers_of_the_same_parts_are_all_paired(spark, tmp_path):
    parts = {1: range(10), 2: range(10), 3: range(10), 4: range(2, 12), 5: range(2, 12), 6: range(50, 55)}
    rows = [(s, p) for s, own in parts.items() for p in own]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in vector_queries.Q["supplier_overlap"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert got == set(con.execute(vector_queries.SQL["supplier_overlap"]).fetchall())
    assert {g[:2] for g in got} == {(f"S{a}", f"S{b}") for a in range(1, 6) for b in range(a + 1, 6)}


def test_hybrid_score_counts_missing_sides_as_zero(spark):
    names = spark.createDataFrame([("a", "b", 90.0), ("a", "c", 100.0)], "text1 string, text2 string, score double")
    products = spark.createDataFrame([("a", "b", 1, 0.5), ("b", "c", 1, 1.0)], "category1 string, category2 string, shared long, jaccard double")
    got = {(r[0], r[1]): round(r["hybrid"], 6) for r in O.hybrid_pairs(names, products, 0.5, 0.5).collect()}
    assert got == {("a", "b"): 0.7, ("a", "c"): 0.5, ("b", "c"): 0.5}
