"""Near-duplicate documents: banded MinHash candidates, pruned batch by batch by Bayesian bounds, then verified."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalign.llm.common import DOC_ROWS, TEXT_ROWS, KeptTexts, KeyFilter, first_common, free_name, linked_groups, mix64, texts_of, with_row_ids
from catalign.runtime import arrow_rows, stage

BANDS, ROWS = 40, 5
# Chance to prune a pair at the threshold, at each batch of signature places.
MISS = 1e-7
BATCH = 20
SEED = 977


def word_shingles(text: bytes | None, size: int) -> list[tuple[bytes, ...]]:
    """The shingles in order, A-Z lower-cased, words between the six ASCII white-space characters.

    A text of fewer words, but not none, is one shingle.
    """
    words = text.lower().split() if text else []
    if len(words) <= size:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(size))))


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a text, sorted."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    taken = min(size, len(words))
    count = len(words) - taken + 1
    out = own[:count]
    for i in range(1, taken):
        out = mix64(out) + own[i : i + count]
    return np.unique(mix64(out))


def signature(hashes: np.ndarray, places: int) -> np.ndarray:
    """``places`` minima of seeded 32-bit hashes, cut to 16 bits each."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 31, places, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(places, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        spread = np.multiply.outer(factors, low[start : start + 2048])
        best = np.minimum(best, spread.min(axis=1))
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def least_matches(places: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """After each batch the number of equal places below which a pair is pruned.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1); its mass from the threshold on is the chance of at most m successes
    in n + 1 trials at the threshold. A pair goes when that is under ``miss``.
    """
    out = []
    for n in range(batch, places + 1, batch):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def passing(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the signature pairs that no batch prunes; pruned ones aren't compared further."""
    return matching(left, right, steps)[0]


def matching(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """``passing`` and the number of equal places of those pairs."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in steps:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        kept = matches >= least
        alive, matches, done = alive[kept], matches[kept], n
    return alive, matches


def band_keys(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of each signature."""
    salt = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(SEED))
    signs = signs.reshape(-1, bands, rows)
    keys = np.tile(salt, (len(signs), 1))
    for i in range(rows):
        keys = mix64(keys ^ signs[:, :, i].astype(np.uint64)) + np.uint64(i)
    return mix64(keys).view(np.int64)


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set, as two signed longs."""
    import xxhash

    whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return int(np.uint64(whole >> 64).view(np.int64)), int(np.uint64(whole & (2**64 - 1)).view(np.int64))


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each hash, sorted."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def _signs_and_sets(data, places: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The signatures and short hashes of a block's members."""
    signs = np.frombuffer(b"".join(d[: 2 * places] for d in data), np.uint16).reshape(-1, places)
    return signs, [np.frombuffer(d, np.uint32, offset=2 * places) for d in data]


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set of ``one`` shares with each of ``two``, by products of 0-1 matrices."""
    flat = [np.concatenate(side) if side else np.empty(0, np.uint32) for side in (one, two)]
    owner = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (one, two)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(one), len(two)), np.float32)
    if not len(shared):
        return out.astype(np.int64)
    held = []
    for numbers, who in zip(flat, owner):
        place = np.minimum(np.searchsorted(shared, numbers), len(shared) - 1)
        found = np.flatnonzero(shared[place] == numbers)
        found = found[np.argsort(place[found], kind="stable")]
        held.append((place[found], who[found]))
    for start in range(0, len(shared), 2048):
        width, sides = min(2048, len(shared) - start), []
        for (place, who), side in zip(held, (one, two)):
            lo, hi = np.searchsorted(place, [start, start + width])
            table = np.zeros((len(side), width), np.float32)
            table[who[lo:hi], place[lo:hi] - start] = 1
            sides.append(table)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``.

    Rows are linked if 100 * |intersection| >= percent * |union| of their sets of distinct word
    shingles. ``component_id`` is the smallest doc_id that links reach, ``kept`` tells whether it
    is the row's own. Rows without words (null, empty, blank) are linked with nothing. Rows
    without an id belong to no component (null) and are kept. Rows that repeat an id are rows of
    their own: what they link is linked by text, and all of them may be kept. Other columns are
    ignored.

    Equal sets become one before anything else. The distinct sets are banded; candidates are
    pruned by comparing batches of their signatures until the posterior chance of reaching the
    threshold is under ``miss``; survivors are compared by their full sets of words. The chance
    that banding alone misses a pair at the threshold is (1 - (percent/100)^rows)^bands, 1.3e-7
    by default. No group is expanded into its pairs, see ``linked_groups``: members of large buckets are
    compared by their whole sets where they meet, and only what joins two components is written down.
    """
    places = bands * rows
    steps = least_matches(places, BATCH, percent / 100, miss)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            counts, one, two, signs = [], [], [], []
            for text in texts_of(batch.column(1)):
                hashes = shingle_hashes(text, shingle)
                counts.append(len(hashes))
                key = _set_key(hashes)
                one.append(key[0])
                two.append(key[1])
                signs.append(signature(hashes, places).tobytes() if len(hashes) else b"")
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(signs, pa.binary())], names=["doc_id", "n", "k1", "k2", "sign"])

    rows_in = docs.select("doc_id", "text")
    with arrow_rows(docs.sparkSession, DOC_ROWS):
        sketched = stage(rows_in.mapInArrow(sketch, f"doc_id {kind}, n bigint, k1 bigint, k2 bigint, sign binary"), "sketches")
    named = sketched.filter("n > 0 and doc_id is not null")
    sets = with_row_ids(named.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("sign").alias("sign")), "sets")

    def banded(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16), bands, rows)
            ids, sizes = (pa.array(np.repeat(batch.column(i).to_numpy(), bands)) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids, sizes], names=["key", "id", "tag"])

    members = sets.select("id", "sign", "n").mapInArrow(banded, "key bigint, id bigint, tag bigint")

    def prune(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, places) for i in (2, 3))
            kept = pa.array(passing(left, right, steps))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(kept) for i in range(2)], names=["a", "b"])

    def reread(batches):
        """The set key of each text, so that a reused doc_id can't bring in another text."""
        import pyarrow as pa

        for batch in batches:
            keys = [_set_key(shingle_hashes(t, shingle)) for t in texts_of(batch.column(0))]
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0)], names=["k1", "k2", "text"])

    def confirm(batches):
        import pyarrow as pa

        # A representative comes up again and again; 512 KB of text are remembered, whose sets take some fifty times that.
        known: dict[bytes, set] = {}

        def whole(text: bytes) -> set:
            if text not in known:
                if sum(map(len, known)) + len(text) > 512 << 10:
                    known.clear()
                known[text] = set(word_shingles(text, shingle))
            return known[text]

        for batch in batches:
            holds = []
            for left, right in zip(texts_of(batch.column(2)), texts_of(batch.column(3))):
                x, y = whole(left), whole(right)
                both = len(x & y)
                holds.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(holds, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(2)], names=["a", "b"])

    ends = "a bigint, b bigint"

    side = lambda df, s, c: df.select(F.col("id").alias(s), F.col(c).alias(f"{c}_{s}"))

    def verify(pairs: DataFrame, later: DataFrame) -> DataFrame:
        signed = pairs.join(side(sets, "a", "sign"), "a").join(side(sets, "b", "sign"), "b")
        alive = stage(signed.select("a", "b", "sign_a", "sign_b").mapInArrow(prune, ends), "survivors")
        needed = alive.select(F.col("a").alias("id")).unionByName(alive.select(F.col("b").alias("id"))).distinct()
        texts = known_texts.of(needed, later)
        full = alive.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(confirm, ends)

    def texts_of_sets(needed: DataFrame) -> DataFrame:
        """``(id, text)``, one text for each of the sets ``needed(id)``."""
        owners = stage(needed.join(sets.select("id", "k1", "k2", "doc_id"), "id"), "needed")
        hashed = rows_in.withColumn("h", F.xxhash64("doc_id"))
        near = KeyFilter(owners.select(F.xxhash64("doc_id").alias("h")), "h").thin(hashed, "h")
        near = near.join(owners.select("doc_id").distinct(), "doc_id").select("text").mapInArrow(reread, "k1 bigint, k2 bigint, text string")
        return near.join(owners.select("id", "k1", "k2"), ["k1", "k2"]).groupBy("id").agg(F.first("text").alias("text"))

    known_texts = KeptTexts(texts_of_sets)

    def linked(key, one, two):
        """Links of two blocks that differ in component and share no band before this one, by their whole sets."""
        m, n = one["tag"][:, None], two["tag"][None, :]
        (left, x), (right, y) = (_signs_and_sets(side["data"], places) for side in (one, two))
        # Of hashes cut to 32 bits a set may hold fewer; the two may share that many more.
        fewer = np.minimum(m - np.array([[len(own)] for own in x]), n - np.array([[len(own) for own in y]]))
        both = common_counts(x, y) + fewer
        i, j = np.nonzero((100 * both >= percent * (m + n - both)) & (one["at"][:, None] != two["at"][None, :]))
        mine = first_common(band_keys(left, bands, rows), band_keys(right, bands, rows), i, j) == key
        return i[mine], j[mine], both[i, j][mine]

    def whole_sets(batches):
        import pyarrow as pa

        for batch in batches:
            short = [_short(shingle_hashes(text, shingle)).tobytes() for text in texts_of(batch.column(2))]
            data = [sign + own for sign, own in zip(batch.column(1).to_pylist(), short)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    def signs_and_sets(ids: DataFrame) -> DataFrame:
        with arrow_rows(docs.sparkSession, TEXT_ROWS):
            with_texts = sets.select("id", "sign").join(known_texts.of(ids, ids), "id").join(ids, "id")
            return stage(with_texts.select("id", "sign", "text").mapInArrow(whole_sets, "id bigint, data binary"), "whole-sets")

    similar_size = lambda m, n: np.minimum(m, n) * 100 >= np.maximum(m, n) * percent
    groups = linked_groups(members, verify, similar_size, linked, signs_and_sets, sure=True)
    # Sets that link with no other set are components of their own.
    of_sets = sets.select("id", "k1", "k2", "doc_id").join(groups, "id", "left")
    of_sets = stage(of_sets.select("k1", "k2", "doc_id", F.coalesce("component", "id").alias("component")), "of-sets")
    first = of_sets.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_sets = of_sets.join(first, "component").select("k1", "k2", "component_id")
    found = sketched.select("doc_id", "n", "k1", "k2").join(of_sets, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its group of near duplicates.

    Rows that repeat an id go only if none of them is kept; rows without an id stay.
    """
    judged = stage(near_duplicates(docs, **how).filter("doc_id is not null"), "judged")
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("any")).filter("not any").select(F.col("doc_id").alias(free_name(docs, "_gone")))
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")
