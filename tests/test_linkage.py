import itertools
import random

import duckdb
import pytest

from catalign.functions.strings import MEASURES, indel_ratio, jaro_winkler, lcs_length, token_sort_text
from catalign.operators.components import connected_components
from catalign.operators.linkage import fuzzy_pairs, link_values

WORDS = "small ring red widget blue bolt hot gear gizmo old economy promo large x1 12 7".split()


def some_texts(n, seed=3):
    rnd = random.Random(seed)
    made = {" ".join(rnd.choices(WORDS, k=rnd.randint(1, 4))) for _ in range(n)}
    return sorted(made | {"a", "b", "ab", "ba", "aab", "Weight", "Width"})


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_table():
    texts = some_texts(60)
    assert all(lcs_length(a, b) == plain_lcs(a, b) for a, b in itertools.product(texts, texts))
    assert lcs_length("blue bolt", "bolt blue") == 5 and indel_ratio("", "") == 100.0


def test_jaro_winkler_against_duckdb():
    texts = some_texts(120)
    rows = duckdb.connect().execute(
        "SELECT a, b, jaro_winkler_similarity(a, b) FROM (SELECT unnest(?) a), (SELECT unnest(?) b)", [texts, texts]
    ).fetchall()
    assert all(abs(s - jaro_winkler(a, b)) < 1e-12 for a, b, s in rows)


def test_token_sort_text(spark):
    df = spark.createDataFrame([("  b  a C ",), ("",)], "t string")
    assert [r[0] for r in df.select(token_sort_text(df.t)).collect()] == ["C a b", ""]


@pytest.mark.parametrize("method,threshold", [("token_sort", 70), ("token_sort", 90), ("jaro_winkler", 80), ("jaro_winkler", 92)])
@pytest.mark.parametrize("block_rows", [512, 8])
def test_fuzzy_pairs_lose_nothing(spark, method, threshold, block_rows):
    texts = some_texts(130)
    measure = MEASURES[method](threshold)
    want = {(a, b): measure.score(a, b) for a, b in itertools.combinations(texts, 2)}
    want = {k: v for k, v in want.items() if v >= threshold}
    df = spark.createDataFrame([(t,) for t in texts * 2], "text string")
    got = fuzzy_pairs(df, method, threshold, block_rows=block_rows).collect()
    assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == want


@pytest.mark.parametrize("method,threshold", [("token_sort", 75), ("jaro_winkler", 88)])
def test_long_and_short_texts_meet(spark, method, threshold):
    rnd = random.Random(8)
    texts = sorted({" ".join(rnd.choices(WORDS[:7], k=k)) for k in range(8, 18) for _ in range(12)})
    assert min(map(len, texts)) < 64 < max(map(len, texts))
    measure = MEASURES[method](threshold)
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if measure.score(a, b) >= threshold}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = fuzzy_pairs(df, method, threshold, block_rows=16).collect()
    assert want and {(r[0], r[1]) for r in got} == want and len(got) == len(want)


def test_link_values_takes_the_smallest_text(spark):
    df = spark.createDataFrame([("boltt",), ("bolt",), ("boltts",), ("zzz",)], "text string")
    linked = link_values(df, fuzzy_pairs(df, "token_sort", 85))
    assert {tuple(r) for r in linked.collect()} == {("bolt", "bolt"), ("boltt", "bolt"), ("boltts", "bolt"), ("zzz", "zzz")}


@pytest.mark.parametrize("single_task_edges", [500_000, 40])
def test_components_of_path_star_and_single(spark, single_task_edges):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(500, 700)] + [(702, 701), (701, 702)]
    found = connected_components(spark.range(800), spark.createDataFrame(edges, "src long, dst long"), single_task_edges)
    got = {r["id"]: r["component"] for r in found.collect()}
    assert len(got) == 800
    for i in range(800):
        want = 0 if i <= 200 else 500 if 500 <= i < 700 else 701 if i in (701, 702) else i
        assert got[i] == want
