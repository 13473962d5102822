"""Resampling, exact copies and centroid clusters against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from cases import awkward, frame, plain
from pyspark.sql import functions as F

from catalign.llm import centroids as C
from catalign.llm import exact_dedup as X
from catalign.llm import resample as R

BENCHMARK = [(1, "alma bene corlit durosa ÉTÉ"), (2, None), (3, ""), (4, "Alma, BENE! corlit?"), (5, "hutu ixlit " * 30)]


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, percent, min_words, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source = Counter(bucket(f) for r in rows for f in features(r[1])[1])
    wanted = Counter(bucket(f) for _, text in target for f in features(text)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    scored = []
    for row in rows:
        words, own = features(row[1])
        weight = sum(gain[bucket(f)] for f in own)
        name = "" if row[0] is None else row[0]
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([row[0], len(own), weight, score, None, len(words) >= min_words])
    able = sorted((r for r in scored if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in scored), key=repr)


@pytest.mark.parametrize("percent, min_words", [(5, 20), (50, 1), (100, 0)])
def test_resampling_against_brute_force(spark, percent, min_words):
    rows = awkward(11)
    target = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = R.resample(frame(spark, rows, clashing=True), target, percent, min_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert plain(got) == brute_resample(rows, BENCHMARK, percent, min_words, R.BUCKETS)


def test_resampling_of_empty_tables(spark):
    rows, target = awkward(12), spark.createDataFrame(BENCHMARK, "item_id long, text string")
    assert R.resample(frame(spark, []), target).collect() == []
    assert plain(R.resample(frame(spark, rows), target.limit(0))) == brute_resample(rows, [], 5, 20, R.BUCKETS)


def test_drawn_documents_keep_their_columns(spark):
    docs = frame(spark, awkward(13), clashing=True)
    ranked = R.resample(docs, docs, percent=50)
    drawn = {r["doc_id"] for r in ranked.filter("rank is not null").collect()}
    kept = R.keep_drawn(docs, ranked)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == drawn - {None}


def test_joined_checksums():
    rng = random.Random(3)
    joiner = R.CrcJoiner()
    left = [rng.randbytes(rng.randrange(0, 90)) for _ in range(200)]
    right = [rng.randbytes(n) for n in (0, 1, 2, 63, 64, 65, 127, 128, 4096, 70001)] * 20
    crc = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    joined = joiner.join(crc(left), crc(right), np.array([len(r) for r in right]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]


@pytest.mark.parametrize("pivots", [1, 4])
def test_selection_finds_every_place(spark, monkeypatch, pivots):
    monkeypatch.setattr(R, "PIVOTS", pivots)
    rng = random.Random(pivots)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for _ in range(60)]
    df = spark.createDataFrame(rows, "x int, y string").filter("x is not null").cache()
    order = sorted(((r.x, r.y) for r in df.collect()), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    for k in (1, 2, 17, len(order) // 2, len(order)):
        assert tuple(R.kth_key(df, ["x", "y"], k)) == order[k - 1]


def brute_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        digest, open_place = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            stays = i == best and open_place
            open_place &= not stays
            out.append((i, best, len(ids), stays, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("support", [0.5, 0.05, 0.001])
def test_exact_copies_against_brute_force(spark, support):
    rows = awkward(14) + [(9000 + i, "hot text", None, None, None) for i in range(80)] + [(None, "only null", None, None, None)] * 3
    got = X.exact_duplicates(frame(spark, rows, clashing=True, parts=5), support)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert plain(got) == brute_copies(rows)


def test_exact_copies_of_an_empty_table(spark):
    assert X.exact_duplicates(frame(spark, [])).collect() == []


def test_kept_rows_keep_their_columns(spark):
    rows = awkward(15)
    docs = frame(spark, rows, clashing=True)
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["text"] or "" for r in kept.collect())) == sorted({r[1] or "" for r in rows})


def test_heavy_digests_leave_the_shuffle_and_no_python_runs(spark):
    rows = [(i, "hot" if i % 3 else f"text {i}", None, None, None) for i in range(300)]
    docs = frame(spark, rows)
    digests = docs.select("doc_id", X.text_digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    assert [r["n"] for r in X._heavy_hitters(digests, 0.1).collect()] == [200]
    plan = X.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_clusters(vectors, k, rounds):
    kept = []
    for vec_id, x in vectors:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, [max(-C.LARGEST, min(C.LARGEST, math.floor(Fraction(v) * 64))) for v in x]))
    name = lambda v: hashlib.sha256(f"1:{'' if v is None else v}".encode()).hexdigest()
    cents = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for turn in range(rounds + 1):
        at = [min((dist(x, c), j) for j, c in enumerate(cents)) for _, x in kept]
        if turn < rounds:
            for j in range(len(cents)):
                own = [x for (_, x), (_, c) in zip(kept, at) if c == j]
                if own:
                    cents[j] = [sum(col) // len(own) for col in zip(*own)]
    per = Counter()
    for d, c in at if kept else []:
        per[c] += d
    cut = lambda n: min(n, C.LONG_MAX)
    return sorted([(v, c, d, cut(per[c]), cut(sum(per.values()))) for (v, _), (d, c) in zip(kept, at)] if kept else [], key=repr), cents


@pytest.mark.parametrize("n, k", [(300, 16), (5, 16), (40, 3)])
def test_clusters_against_brute_force(spark, n, k):
    rng = random.Random(n)
    near = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [a + rng.gauss(0, 0.3) for a in rng.choice(near)]) for i in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (8000, rows[2][1]), (8001, [0.0] * 64), (8002, [-1e300] * 32 + [1e300] * 32)]
    rows += [(9000, None), (9001, []), (9002, [1.0] * 63), (9003, [None] + [1.0] * 63), (9004, [math.nan] + [0.0] * 63), (9005, [-math.inf] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1))
    got, cents = C.cluster_vectors(df.repartition(3), k=k)
    want, want_cents = brute_clusters(rows, k, 3)
    assert plain(got) == want and cents == want_cents


def test_clusters_of_an_empty_table(spark):
    got, cents = C.cluster_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert got.collect() == [] and cents == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_transform_keeps_distances_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(5)
    x = rng.integers(-C.LARGEST, C.LARGEST, (50, 64))
    c = np.concatenate([x[:4], x[:4]])
    assert ((C.walsh(x) ** 2).sum(1) // 64 == (x.astype(object) ** 2).sum(1)).all()
    found, distance = C.nearest(C.walsh(x), C.walsh(c))
    every = ((x[:, None].astype(object) - c[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()
