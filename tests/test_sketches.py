"""Mergeable sketches and the fitted embedding against exact figures."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from catalign.operators import sketches as K
from catalign.operators import terms as T
from catalign.runtime import stage
from suite import vector_queries


def catalog(spark, n=3000):
    rng = random.Random(5)
    rows = [(f"s{i % 4}", f"{rng.lognormvariate(3, 1):.3f} kg" if i % 7 else None, f"{i % 50}x{i % 20}", "no number") for i in range(n)]
    return spark.createDataFrame(rows, "source_file string, weight string, size string, note string").repartition(6), rows


def test_merged_sketches_are_within_their_rank_error(spark):
    df, rows = catalog(spark)
    parts = K.sketch_profiles(K.column_numbers(df, ["weight", "size", "note"]))
    ranks = [0.0, 0.1, 0.5, 0.9, 1.0]
    merged = {r.column_name: r for r in K.merge_profiles(parts, ranks).collect()}
    single = {r.column_name: r for r in K.merge_profiles(K.sketch_profiles(K.column_numbers(df.withColumn("source_file", F.lit("all")), ["weight", "size"])), ranks).collect()}
    weights = sorted(float(r[1].split()[0]) for r in rows if r[1])
    sizes = sorted(float(x) for r in rows for x in r[2].split("x"))
    assert set(merged) == {"weight", "size"} and merged["weight"].n_sources == 4 and single["weight"].n_sources == 1
    for name, values in (("weight", weights), ("size", sizes)):
        for found in (merged[name], single[name]):
            assert found.n == len(values) and (found.min_value, found.max_value) == (values[0], values[-1])
            assert abs(found.mean_value - sum(values) / len(values)) < 1e-9
            for rank, value in zip(ranks, found.quantiles):
                low = sum(v < value for v in values) / len(values)
                high = sum(v <= value for v in values) / len(values)
                assert low - 2 * K.rank_error() <= rank <= high + 2 * K.rank_error()


def test_sketches_of_nothing(spark):
    df, _ = catalog(spark, 1)
    assert K.merge_profiles(K.sketch_profiles(K.column_numbers(df, ["note"])), [0.5]).collect() == []


@pytest.mark.parametrize("lg", [6, 12])
def test_overlaps_from_sketches_of_parts(spark, lg):
    rng = random.Random(lg)
    sets = {f"c{i}": {rng.randrange(3000) for _ in range(rng.choice([5, 200, 1500]))} for i in range(12)}
    rows = [(c, p, f"f{p % 3}") for c, own in sets.items() for p in own] * 2
    held = spark.createDataFrame(rows, "category string, product_name long, file string").repartition(5)
    merged = K.merge_sets(K.sketch_sets(held, "file", lg), lg)
    names = sorted(sets)
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "category1 string, category2 string")
    got = K.sketched_overlap(pairs, merged, lg).collect()
    inside = 0
    for r in got:
        one, two = sets[r.category1], sets[r.category2]
        inside += r.shared_low <= len(one & two) <= r.shared_high
        if len(one | two) <= 2**lg:
            assert r.shared == len(one & two) and r.shared_low == r.shared_high == len(one & two)
            assert abs(r.jaccard - len(one & two) / len(one | two)) < 1e-12
    assert len(got) == 66 and inside >= 0.9 * 66


def test_suppliers_are_sketched_by_year_of_delivery(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    lines = [(s, rng.randrange(12), datetime.datetime(rng.choice([1995, 1996, 1999]), rng.randrange(1, 13), 5)) for s in range(4) for _ in range(40)]
    lines += [(0, 50, None), (0, 51, None), (1, 50, None), (9, 1, datetime.datetime(1999, 12, 31, 23, 59))]
    rows = spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_shipdate timestamp")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    staged = {}
    monkeypatch.setattr(vector_queries, "stage", lambda df, name="stage": staged.setdefault(name, stage(df, name)))
    found = vector_queries.Q["overlap_sketch"](spark, str(tmp_path)).first()
    want = {}
    for s, p, at in lines:
        want.setdefault((f"S{s}", at and at.year), set()).add(p)
    got = staged["years"].select("category", "year", F.theta_sketch_estimate("sketch")).collect()
    assert {tuple(r)[:2]: r[2] for r in got} == {k: len(v) for k, v in want.items()} and len(got) == len(want)
    # A part delivered in several years counts once in the merged sketch.
    every = {c: set().union(*(v for k, v in want.items() if k[0] == c)) for c, _ in want}
    merged = staged["sets"].select("category", F.theta_sketch_estimate("sketch")).collect()
    assert {r[0]: r[1] for r in merged} == {c: len(v) for c, v in every.items()}
    assert found.n_pairs >= 6 and found.within


def brute_grams(text, dims, size):
    import hashlib

    padded = f"^{text.lower()}$"
    return [int(hashlib.md5(padded[i : i + size].encode()).hexdigest()[:8], 16) % dims for i in range(max(1, len(padded) - size + 1))]


def test_fitted_embedding_of_unseen_names(spark, tmp_path):
    names = ["Desk Lamp", "desk lamps", "Floor lamp", "Oven", "", "Ёлка", "x"]
    model = T.fit_idf(spark.createDataFrame([(n,) for n in [*names, None]], "text string"), dims=64)
    seen = [set(brute_grams(n, 64, 3)) for n in names]
    idf = {b: math.log((len(names) + 1) / (sum(b in s for s in seen) + 1)) for s in seen for b in s}
    assert {r.bucket: round(r.idf, 12) for r in model.collect()} == {b: round(w, 12) for b, w in idf.items()}
    model = T.load_idf(spark, T.save_idf(model, str(tmp_path / "idf")))
    texts = ["Desk Lamp", "never seen before", "", None]
    got = {r.text: r.embedding for r in T.embed_idf(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert got.pop(None) is None and set(got) == set(texts[:3])
    for text, vector in got.items():
        grams = brute_grams(text, 64, 3)
        raw = [grams.count(b) * idf.get(b, max(idf.values())) for b in range(64)]
        norm = math.sqrt(sum(x * x for x in raw))
        assert len(vector) == 64 and all(abs(v - x / norm) < 1e-9 for v, x in zip(vector, raw))


def test_a_model_of_no_names(spark):
    none = spark.createDataFrame([], "text string")
    assert T.fit_idf(none).collect() == [] and T.embed_idf(none, T.fit_idf(none)).collect() == []
