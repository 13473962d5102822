"""URL judgement, benchmark search and language identification."""

import random

import numpy as np
import pytest
from cases import awkward, frame, plain, prose
from pyspark.sql import functions as F

from catalign.llm import decontaminate as D
from catalign.llm import langid as L
from catalign.llm import url_filter as U

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [
        (len(r), r, v)
        for v, r in RULES
        if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])
    ]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "nonsense", "http://", "http://?a://b", "HTTP://Example.NET/en/x?utm_a=1", "http://example.net/EN/x", "http://net/", "http://xnet/",
    "http://a.example.com/de/", "http://a.example.com/de", "https://w.ORG/fr/1#t", "ftp://É.net?x", "a://b://c/d", "http://x.net#f/en/",
    "http://h/" + "p" * 5000,
]


def test_urls_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.example.net", "example.com", "b.example.com", "w.org", "q.io", "Q.io"]
    urls = URLS + [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(300)}" for _ in range(1500)]
    urls += urls[-5:]
    pages = spark.createDataFrame([(i % 1000 if i % 77 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, listed string")
    keys = {"".join(brute_parts(u)) for u in rng.sample(urls, 200)} | {"elsewhere/1", ""}
    listed = spark.createDataFrame([(k,) for k in [*keys, *keys, None]], "key string")
    got = U.judge_urls(pages.repartition(3), listed, RULES, shard_keys=100)
    want = []
    for i, url in enumerate(urls):
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        verdict = verdict or ("block" if host + path in keys else "allow")
        want.append((i % 1000 if i % 77 else None, host, path, rule, verdict))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and plain(got) == sorted(want, key=repr)


def test_waves_judge_like_one_broadcast(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("k://h/"), "id").alias("url"))
    listed = spark.range(0, 9000, 7).select(F.concat(F.lit("h/"), "id").alias("key"))
    cascade, shards = U.build_cascade(pages.select(F.substring("url", 5, 99).alias("key")), listed, shard_keys=200)
    rows = pages.select("page_id", F.substring("url", 5, 99).alias("key"))
    many = U.with_membership(rows, F.col("key"), cascade, shards, wave_bytes=100)
    assert shards > 10 and {r.page_id for r in many.filter("listed").collect()} == set(range(0, 3000, 7)) and many.count() == 3000


def test_cascade_edge_cases():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(2))
    for listed in (np.zeros(500, bool), np.ones(500, bool), rng.random(500) < 0.3, np.arange(500) == 7):
        assert (U.probe(U.build_levels(h1, h2, listed), h1, h2) == listed).all()
    with pytest.raises(ValueError):
        U.build_levels(h1[[0, 0]], h2[[0, 0]], np.array([True, False]))


def test_no_pages_and_no_list(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(pages, spark.createDataFrame([], "key string"), RULES).count() == 0


def brute_hits(text, items, window):
    words = D.words_of(text.encode() if text is not None else None)
    hit, found = set(), set()
    for name, other in items:
        own = D.words_of(other.encode() if other is not None else None)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("wave_bytes", [1 << 24, 300])
def test_benchmark_search_against_brute_force(spark, wave_bytes):
    rng = random.Random(9)
    items = [(str(i), prose(rng, rng.choice([1, 2, 3, 9, 10, 11, 40]))) for i in range(12)] + [("12", None), ("13", "..."), ("14", "")]
    items += [("15", items[5][1])]
    rows = awkward(3)
    for i, (_, text) in enumerate(items[:12]):
        cut = text.split(" ")
        rows.append((9000 + i, f"{prose(rng, 5)}, {'; '.join(cut).upper()}!{prose(rng, 3)}", None, None, None))
        rows.append((9100 + i, " ".join(cut[1:]), None, None, None))
    bench = spark.createDataFrame([(int(n), t, 1) for n, t in items], "item_id long, text string, doc_id int")
    got = D.find_contamination(frame(spark, rows, clashing=True), bench, wave_bytes=wave_bytes)
    want = [(r[0], *brute_hits(r[1], items, 10)) for r in rows]
    assert plain(got.select("doc_id", "n_words", "n_hit", "item_ids")) == sorted(want, key=repr)
    assert got.filter(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]) != F.col("n_hit")).count() == 0


def test_contaminated_documents_go_with_all_their_rows(spark):
    rows = [(1, "one two three", "a", None, 1), (1, "clean", "b", None, 2), (2, "clean", None, None, 3), (None, "three", "c", None, 4)]
    bench = spark.createDataFrame([(5, "two three")], "item_id long, text string")
    kept = D.drop_contaminated(frame(spark, rows, clashing=True), bench)
    assert plain(kept.select("doc_id", "text")) == sorted([(2, "clean"), (None, "three")], key=repr) and "_hit" in kept.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.drop_contaminated(frame(spark, rows), none).count() == 4
    assert D.find_contamination(frame(spark, []), bench).count() == 0


def language_rows(seed, n, first):
    rng = random.Random(seed)
    heads = {"aa": ["ta", "ri", "ko", "ma"], "bb": ["sch", "ung", "ver", "ich"], "cc": ["é", "eau", "oi", "ç"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(heads))
        words = ["".join(rng.choice(heads[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 60))]
        rows.append((first + i, " ".join(words), lang, "s", 0))
    return rows


def test_held_out_accuracy_and_calibration(spark):
    docs = frame(spark, language_rows(1, 900, 0) + awkward(2), clashing=True)
    model = L.train(docs.withColumn("lang", F.when(F.col("lang") != "xx", F.col("lang"))), rows_per_language=150)
    assert model.languages == ["aa", "bb", "cc"]
    found = L.predict(docs, model).withColumn("fold", L.fold_of(F.col("doc_id")))
    truth = {r[0]: r[2] for r in language_rows(1, 900, 0)}
    held = [(r.lang_pred, truth[r.doc_id], r.score) for r in found.filter("fold = 0").collect() if r.doc_id in truth and r.doc_id > 300]
    right = np.mean([a == b for a, b, _ in held])
    assert len(held) > 60 and right > 0.97 and abs(np.mean([s for _, _, s in held]) - right) < 0.05
    assert found.count() == docs.count() and found.filter("score < 0 or score > 1").count() == 0


def test_texts_without_letters_are_undetermined(spark):
    model = L.train(frame(spark, language_rows(3, 300, 0)))
    texts = [None, "", "12 34 !?", "ⅷ 5", "é", "Ж", "ta ri koma"]
    found = {r.doc_id: r for r in L.predict(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    assert [found[i].lang_pred == "und" for i in range(7)] == [True, True, True, True, False, False, False]
    assert all(found[i].score == 0 and found[i].rejected for i in range(4)) and found[6].lang_pred == "aa"
    kept = L.drop_rejected(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)], clashing=True), model)
    assert {r.doc_id for r in kept.collect()} == {i for i in found if not found[i].rejected} and "kept" in kept.columns


def test_prediction_uses_text_alone_and_training_may_have_nothing(spark):
    rows = language_rows(5, 200, 0)
    model = L.train(frame(spark, rows))
    other = [(r[0] + 5000, r[1], "zz", "q", 9) for r in rows]
    one = {r.doc_id: r[1:] for r in L.predict(frame(spark, rows), model).collect()}
    two = {r.doc_id - 5000: r[1:] for r in L.predict(frame(spark, other), model).collect()}
    assert one == two
    nothing = L.train(frame(spark, []))
    assert L.predict(frame(spark, []), nothing).count() == 0


@pytest.mark.parametrize("rows,wrong", [(1, 0.0), (8, 0.2), (40, 0.03), (320, 0.015), (320, 0.03), (3000, 0.03)])
def test_rejection_keeps_what_is_judged_rightly(rows, wrong):
    rng = np.random.default_rng(rows)
    lost = []
    for _ in range(300):
        score = rng.beta(8, 1, rows)
        limit = L.rejection_limit(score, rng.random(rows) >= wrong)
        lost.append((rng.beta(8, 1, 2000) < limit).mean())
    assert np.mean(lost) < 0.05 and np.median(lost) < 0.01


def test_rejected_answers_are_mostly_wrong():
    rng = np.random.default_rng(4)
    score = rng.random(4000)
    right = rng.random(4000) < score
    limit = L.rejection_limit(score, right)
    assert 0.4 < limit < 0.6 and right[score < limit].mean() < 0.5
    assert L.rejection_limit(np.array([0.3, 0.9]), np.array([False, False])) == 0.0
    assert L.rejection_limit(np.array([0.3, 0.9]), np.array([False, True])) == 0.0
