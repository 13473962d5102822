"""Near duplicates of documents and lines, and fingerprints."""

import hashlib
import random

import numpy as np
import pytest
from cases import WORDS, awkward, edited, frame, plain, prose
from pyspark.sql import functions as F

from catalign.llm import edit_batches as EB
from catalign.llm import edit_embedding as E
from catalign.llm import line_dedup as LD
from catalign.llm import minhash as M


def groups_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if find(a) != find(b) and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def brute_components(rows, size, percent=80):
    sets = [set(M.word_shingles(r[1].encode() if r[1] is not None else None, size)) for r in rows]

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x and y) and rows[a][0] is not None and rows[b][0] is not None and 100 * len(x & y) >= percent * len(x | y)

    group = groups_of(len(rows), linked)
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i]]
        component = None if row[0] is None else min(ids) if sets[i] else row[0]
        out.append((row[0], len(sets[i]), component, component is None or component == row[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, size):
    rng = random.Random(size)
    rows = awkward(size)
    seed = prose(rng, 60)
    for i in range(30):  # a chain of copies, each an edit away from the last
        seed = edited(rng, seed, 1)
        rows.append((5000 - i, seed, None, None, None))
    got = M.near_duplicates(frame(spark, rows, clashing=True), shingle=size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert plain(got) == brute_components(rows, size)


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(8)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, 2), None, None, None) for i in range(300)] + [(900 + i, prose(rng, 40), None, None, None) for i in range(50)]
    got = {r.doc_id: r for r in M.near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert {got[i].component_id for i in range(300)} == {0} and all(got[900 + i].kept for i in range(50))


def test_links_among_documents_that_share_a_passage(spark):
    rng = random.Random(21)
    passage = prose(rng, 60)
    rows = [(i, passage + " " + prose(rng, 25), None, None, None) for i in range(120)]
    rows += [(200 + i, edited(rng, rows[i][1], 3), None, None, None) for i in range(0, 120, 2)]
    got = M.near_duplicates(frame(spark, rows), shingle=2)
    assert plain(got) == brute_components(rows, 2)


def test_keep_first_keeps_columns_and_lone_rows(spark):
    rows = awkward(6)
    docs = frame(spark, rows, clashing=True)
    kept = M.keep_first(docs)
    judged = brute_components(rows, 5)
    stay = {i for i, _, _, ok in judged if ok}
    assert kept.columns == docs.columns and plain(kept.select("doc_id")) == sorted([(r[0],) for r in rows if r[0] in stay], key=repr)
    assert M.keep_first(frame(spark, [])).count() == 0


def test_pruning_bounds_are_the_posterior():
    steps = M.least_matches(200, 20, 0.8, 1e-7)
    rng = np.random.default_rng(0)
    like = rng.beta(8, 2, 400_000)
    n, least = steps[1]
    matches = rng.binomial(n, like)
    assert steps[-1][0] == 200 and (like[matches < least] >= 0.8).sum() == 0
    same = rng.integers(0, 9, (4, 200)).astype(np.uint16)
    other = np.where(rng.random((4, 200)) < 0.2, 99, same).astype(np.uint16)
    assert list(M.passing(np.vstack([same, same]), np.vstack([other, same[::-1]]), steps))[:4] == [0, 1, 2, 3]


def brute_lines(rows):
    lines = [
        (r[0], n, LD.normal_line(line).decode())
        for r in rows
        if r[1] is not None
        for n, line in enumerate(x.encode() for x in r[1].split("\n"))
        if len(LD.normal_line(line)) >= LD.MIN_CHARS
    ]
    texts = sorted({t for _, _, t in lines})
    sims = [int(x) for x in LD.simhashes([t.encode().split() for t in texts])]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def linked(a, b):
        if (sims[a] ^ sims[b]).bit_count() > LD.DISTANCE:
            return False
        x, y = texts[a], texts[b]
        return 100 * distance(x, y) <= 10 * max(len(x), len(y))

    group = dict(zip(texts, groups_of(len(texts), linked)))
    order = lambda d, n: (d is not None, d or 0, n)
    first = {}
    for d, n, t in lines:
        first[group[t]] = min(first.get(group[t], (True, 1 << 60, 0)), order(d, n))
    return sorted({(d, n) for d, n, t in lines if order(d, n) != first[group[t]]}, key=repr)


def line_rows(seed):
    rng = random.Random(seed)
    common = [prose(rng, rng.randrange(5, 60)) for _ in range(20)]
    rows = awkward(seed, long_words=300)
    for i in range(60):
        lines = [rng.choice(common) for _ in range(2)] + [prose(rng, rng.randrange(1, 30)) for _ in range(2)]
        line = rng.choice(common)
        at = rng.randrange(len(line))
        lines += [line[:at] + rng.choice("xyz 7,.") + line[at + 1 :], rng.choice(common).upper() + f" {i}", "", "As."]
        rng.shuffle(lines)
        rows.append((3000 + i, "\n".join(lines), None, None, None))
    return rows


def test_repeated_lines_against_brute_force(spark):
    rows = line_rows(5)
    got = LD.repeated_lines(frame(spark, rows, clashing=True)).distinct()
    want = brute_lines(rows)
    assert len(want) > 100 and plain(got) == want


def test_lines_are_cut_and_columns_stay(spark):
    rows = line_rows(7)
    docs = frame(spark, rows, clashing=True)
    gone = set(brute_lines(rows))
    out = LD.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    cut = lambda r: None if r[1] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if (r[0], n) not in gone)
    want = [(r[0], cut(r), None if r[1] is None else len(cut(r))) for r in rows]
    assert plain(out.select("doc_id", "text", "n_chars")) == sorted(want, key=repr)
    left = LD.drop_repeated_lines(docs, drop_emptied=True)
    whole = [r for r in rows if r[1] is None or any((r[0], n) not in gone for n in range(r[1].count("\n") + 1))]
    assert left.count() == len(whole)
    assert LD.drop_repeated_lines(frame(spark, [])).count() == 0


def test_edit_similarity():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert LD.edit_similar(a, b, 80) == (row[-1] <= max(len(a), len(b)) * 20 // 100), (a, b)


def test_close_simhashes_share_a_key():
    rng = np.random.default_rng(3)
    sims = rng.integers(0, 2**63, 200).astype(np.uint64)
    for _ in range(5):
        other = sims.copy()
        for _ in range(3):
            other ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        a, b = LD.block_keys(sims, 3, 5), LD.block_keys(other, 3, 5)
        assert (a == b).any(axis=1).all()


def brute_edits(rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    out = []
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        out.append((key, text, text[: len(text) - half] + after[:half], after))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 24, 3000])
def test_edits_and_likeness_against_brute_force(spark, part_bytes):
    rows = awkward(4)
    got = E.compare_edits(frame(spark, rows, clashing=True), part_bytes=part_bytes)
    want = []
    for key, text, edit, after in brute_edits(rows):
        own, other, following = E.fingerprints([text])[0], E.fingerprints([edit])[0], E.fingerprints([after])[0]
        digest = hashlib.sha256(edit.encode()).hexdigest()
        want.append((key, len(text), digest, own, other, round(E.likeness(own, other), 9), round(E.likeness(own, following), 9)))
    rounded = got.withColumn("near_edited", F.round("near_edited", 9)).withColumn("near_next", F.round("near_next", 9))
    assert plain(rounded) == sorted(want, key=repr)


def test_one_document_is_its_own_successor(spark):
    (row,) = E.compare_edits(frame(spark, [(1, "abcdef", None, None, None)])).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert E.compare_edits(frame(spark, [])).count() == 0


def test_few_edits_leave_most_of_the_fingerprint():
    rng = random.Random(11)
    near, far = [], []
    for _ in range(60):
        text = prose(rng, rng.randrange(50, 400))
        few = list(text)
        for _ in range(3):
            few[rng.randrange(len(few))] = rng.choice(["", "q", "zz"])
        a, b, c = E.fingerprints([text, "".join(few), prose(rng, 200)])
        near.append(E.likeness(a, b))
        far.append(E.likeness(a, c))
    assert np.median(near) > 0.75 and max(far) < 0.5 and E.fingerprints(["x", "x"])[0] == E.fingerprints(["x"])[0]


def test_fingerprints_do_not_depend_on_the_batch():
    texts = ["", "a", "é" * 9, "".join(WORDS), "😀" * 300]
    assert E.fingerprints(texts) == [E.fingerprints([t])[0] for t in texts] and E.fingerprints([]) == []


def test_edit_distance_of_many_edits():
    rng = random.Random(4)
    for _ in range(200):
        a = "".join(rng.choice("abé 😀") for _ in range(rng.randrange(1, 150)))
        b = "".join(rng.choice([c, c, c, c, "", "x", c + "y"]) for c in a)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        for most in (row[-1] - 1, row[-1], row[-1] + 1, 41, 60):
            assert LD.edit_within(a, b, most) == (row[-1] <= most), (a, b, most)


def near_rows():
    """Long texts with a few scattered edits, far from their originals in doc_id order; and awkward rows."""
    rng = random.Random(31)
    base = [prose(rng, rng.randrange(8, 250)) for _ in range(40)]
    rows = awkward(3, long_words=400)
    for i, text in enumerate(base):
        few = list(text)
        for _ in range(max(1, len(text) // 80)):
            few[rng.randrange(len(few))] = rng.choice(["", "q", "zz"])
        rows += [(4000 + i, text, None, None, None), (9000 - i, "".join(few), None, None, None)]
    return rows


def test_groups_of_near_texts_against_brute_force(spark):
    rows = near_rows()
    docs = frame(spark, rows, clashing=True)
    texts = [r[1] or "" for r in rows]
    group = groups_of(len(rows), lambda a, b: LD.edit_similar(texts[a], texts[b], E.PERCENT))
    ids = lambda g: [r[0] for r, own in zip(rows, group) if own == g and r[0] is not None]
    want = sorted(((r[0], min(ids(g), default=None)) for r, g in zip(rows, group)), key=repr)
    got = E.compare_and_group(docs)
    assert got.columns == [*E.compare_edits(docs).columns, "group_id"] and plain(got.select("doc_id", "group_id")) == want
    assert sum(key is not None and key >= 8000 and key != g for key, g in want) == 40
    assert E.compare_and_group(frame(spark, [])).count() == 0


def test_lines_of_rows_that_share_or_lack_an_id(spark):
    rng = random.Random(17)
    a, b, c, d, e, f, g = (prose(rng, 20) for _ in range(7))
    texts = [(None, f"{d}\n{g}"), (1, a), (None, f"{b}\n{a}"), (None, f"{c}\n{d}"), (None, f"{e}\n{b}"), (7, f"{f}\n{d}"), (7, f"{f}x\n{e} {f}"), (8, f)]
    out = LD.drop_repeated_lines(frame(spark, [(*t, None, None, None) for t in texts]), drop_emptied=True)
    got = plain(out.select("doc_id", "text"))
    # Null ids come first: what ids 1 and 7 repeat from them goes, and each row is cut by its own lines only.
    lines = [line for _, t in got for line in t.split("\n")]
    assert all(lines.count(line) == 1 for line in (a, b, c, d, e, f, g)) and (7, f"{f}x\n{e} {f}") in got
    assert {(None, c), (None, e), (7, f)} <= set(got) and (8, f) not in got and (1, a) not in got and len(got) == 6


def test_clean_rows_without_an_id_stay(spark):
    from catalign.llm import decontaminate as D

    rows = [(None, "one two three"), (None, "clean"), (None, None), (None, "clean"), (4, "one two three"), (5, "x")]
    bench = spark.createDataFrame([(5, "two three")], "item_id long, text string")
    kept = D.drop_contaminated(frame(spark, [(*r, None, None, None) for r in rows]), bench)
    assert plain(kept.select("doc_id", "text")) == sorted([(None, "clean"), (None, None), (None, "clean"), (5, "x")], key=repr)


def test_buckets_are_compared_in_pieces_without_losing_a_pair(monkeypatch):
    import pyarrow as pa

    from catalign.llm import common

    monkeypatch.setattr(common, "RUN_ROWS", 50)
    monkeypatch.setattr(common, "RUN_LIMIT", 200)
    rng = np.random.default_rng(9)
    # Keys of one member to 700; the tags of key 3 are few and far apart, those of key 5 all alike.
    keys = np.sort(np.concatenate([np.full(700, 4), np.full(90, 3), np.full(60, 5), rng.integers(10, 60, 400)]))
    tags = rng.integers(0, 1000, len(keys))
    tags[keys == 3], tags[keys == 5] = np.arange(90) * 100, 7
    columns = [pa.array(x.astype(np.int64)) for x in (keys, np.arange(len(keys)), tags)]
    rows = pa.RecordBatch.from_arrays(columns, names=["key", "id", "tag"])
    near = lambda a, b: np.abs(a - b) <= 2
    pairs, crowded, seen = set(), {}, 0
    for (k, i, t), cut in common._whole_keys(rows.slice(s, 30) for s in range(0, len(keys), 30)):
        seen += len(k)
        for batch in common._met(k, i, t, near, None, cut):
            for key, one, _, other in zip(*(c.to_pylist() for c in batch.columns)):
                if other is None:
                    crowded.setdefault(key, set()).add(one)
                else:
                    pairs.add((one, other))
    assert seen == len(keys) and {4, 5} <= set(crowded) and 3 not in crowded
    assert all(near(tags[a], tags[b]) and keys[a] == keys[b] for a, b in pairs)
    want = {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if keys[a] == keys[b] and near(tags[a], tags[b])}
    assert all(p in pairs or set(p) <= crowded[keys[p[0]]] for p in want) and len(pairs) < len(want) // 2


def test_texts_of_links_are_read_once_for_all_rounds(spark):
    from catalign.llm.common import KeptTexts

    asked = []

    def read(ids):
        asked.append(sorted(r.id for r in ids.collect()))
        return ids.withColumn("text", F.col("id").cast("string"))

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    kept = KeptTexts(read)
    for now in ((1, 2), (2, 3), (3, 9)):
        assert set(now) <= {r.id for r in kept.of(ids(*now), ids(2, 3)).collect()}
    assert asked == [[1, 2, 3], [9]]


def test_few_texts_are_in_a_batch_while_links_are_verified(spark):
    from catalign.runtime import arrow_rows

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = lambda: spark.range(0, 100, 1, 1).mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), "id bigint").count()
    with arrow_rows(spark, 10):
        assert sizes() == 10
    assert sizes() == 1 and spark.conf.get(name) == before


def test_candidates_that_do_not_hold_make_no_rows(spark, monkeypatch):
    """600 texts that share most of their words, a few of them linked: pairs grow with links, not with the square."""
    from catalign.llm import common

    rng = random.Random(31)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([2, 6, 7])):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    made, compared = [], common._compared_blocks

    def counted(*args):
        out = compared(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(common, "_compared_blocks", counted)
    monkeypatch.setattr(common, "BLOCK_MEMBERS", 64)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2)
    assert plain(got) == brute_components(rows, 2)
    assert made and sum(made) < 3 * len(rows)


def test_shared_numbers_are_counted_exactly():
    rng = np.random.default_rng(4)
    one, two = ([np.unique(rng.integers(0, 6000, n).astype(np.uint32)) for n in sizes] for sizes in ((0, 1, 3000, 40), (5000, 0, 7)))
    assert M.common_counts(one, two).tolist() == [[len(np.intersect1d(x, y)) for y in two] for x in one]
    assert M.common_counts([], two).shape == (0, 3)


def test_many_edits_are_not_looked_for_along_diagonals(monkeypatch):
    """Missing n-grams tell that a text of 4 % edits needs more than diagonals reach."""
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    letters = list(text)
    for at in range(10, 4000, 25):
        letters[at] = "#"
    calls, slide = [], LD._slide
    monkeypatch.setattr(LD, "_slide", lambda *args: calls.append(1) or slide(*args))
    assert E.near_texts(text, "".join(letters), 95) and not E.near_texts(text, "".join(letters), 97)
    assert len(calls) <= 4


def test_slides_stop_at_the_first_other_letter():
    rng = random.Random(13)
    for _ in range(2000):
        a, b = ("".join(rng.choice("aaaaaaab") for _ in range(rng.randrange(40))) for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        n = next((n for n, (x, y) in enumerate(zip(a[i:], b[j:])) if x != y), min(len(a) - i, len(b) - j))
        assert LD._slide(a, b, i, j) == i + n


def with_edits(rng, text, every):
    return "".join(rng.choice(["", c, c + "x", "😀"]) if rng.random() < 1 / every else c for c in text)


def test_edit_distances_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(14)
    monkeypatch.setattr(EB, "CHECK_COLUMNS", 32)
    pairs = [(a, with_edits(rng, a, rng.choice([3, 10, 40]))) for a in ("".join(rng.choice("abé 😀") for _ in range(rng.randrange(150))) for _ in range(150))]
    for most in (0, 1, 5, 20, 60):
        some = [p for p in pairs if abs(len(p[0]) - len(p[1])) <= most]
        got = EB.within([tuple(EB.code_points(t) for t in p) for p in some], np.full(len(some), most))
        assert got.tolist() == [LD.edit_within(a, b, most) for a, b in some]


def test_near_pairs_and_what_joins_them():
    rng = random.Random(15)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(6)]
    texts = ["", "a", "b", *(with_edits(rng, t, rng.choice([25, 50, 200])) for t in base for _ in range(8))]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    near = [LD.edit_similar(texts[i], texts[j], 95) for i, j in pairs]
    assert EB.near_pairs(texts, pairs, 95).tolist() == near
    some = EB.linking_pairs(texts, pairs, 95)
    assert all(near[nth] for nth in some) and len(some) < sum(near)
    linked = {pairs[nth] for nth in some}
    want = groups_of(len(texts), lambda a, b: LD.edit_similar(texts[a], texts[b], 95))
    assert groups_of(len(texts), lambda a, b: (a, b) in linked or (b, a) in linked) == want and len(some) == len(texts) - len(set(want))


def test_walks_by_code_points_are_the_walks_by_steps(monkeypatch):
    rng, sampled = random.Random(16), set(E.STEPS.tolist())
    texts = ["", "z", "y" * 300, "".join(rng.choice("ab cé") for _ in range(5000)), *(prose(rng, n) for n in range(1, 60))]
    for few in (0, 10**9):
        monkeypatch.setattr(E, "FEW_WALKS", few)
        for walk in range(E.WALKS):
            for text, got in zip(texts, E.fingerprints(texts, walk)):
                letters, place, step, want = [*E.letter_classes(text).tolist(), E.DONE], 0, 0, ""
                while letters[place] != E.DONE:
                    want += "%x" % (letters[place] & 15) if step in sampled else ""
                    place += int(E._WALKS[walk][step % E.WALK_ROWS, letters[place]])
                    step += 1
                assert got == want


@pytest.mark.parametrize("chars", [1 << 21, 2000])
def test_candidates_of_a_group_stand_together(spark, monkeypatch, chars):
    monkeypatch.setattr(E, "DEALT_CHARS", chars)
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12)] + [(100, 101), (101, 102), (200, 201)]
    df = spark.createDataFrame([(a, b, 500, 500) for a, b in pairs], "a long, b long, n_a long, n_b long")
    rows = E._dealt(df).collect()
    assert sorted((r.a, r.b) for r in rows) == pairs
    held = {}
    for r in rows:
        held.setdefault(r.key, set()).update([r.a, r.b])
    assert len(held) == 3 if chars > 2000 else max(map(len, held.values())) < 12
