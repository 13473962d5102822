"""Importance resampling towards a target: array-scored n-gram gains, Gumbel keys, distributed quickselect."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from catalign.llm.common import text_slices, texts_of
from catalign.llm.decontaminate import words_of
from catalign.runtime import global_rank, stage

BUCKETS = 10_000
# Bytes of text whose words are hashed at once; a longer text stands alone.
SLICE_BYTES = 4 << 20
# Pivots of a selection round; each round leaves about one part in PIVOTS + 1 of the rows.
PIVOTS = 15
# Winners that one task ranks; more are ranked in ranges.
RANKED_BY_ONE_TASK = 10_000


class CrcJoiner:
    """The crc32 of joined strings from those of their parts.

    crc32(a + b) is crc32(a), moved over as many zero bytes as ``b`` has, xor crc32(b). Moving is
    linear, so it is four table lookups, one a byte of the number; tables exist for up to 64
    zero bytes, and are squared for longer strings.
    """

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, np.uint32(0xEDB88320) ^ (byte >> 1), byte >> 1).astype(np.uint32)
        step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        tables = [step]
        for _ in range(64):
            step = byte[step & 255] ^ (step >> np.uint32(8))
            tables.append(step)
        self.tables = np.stack(tables)

    @staticmethod
    def look_up(flat: np.ndarray, base: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
        out = flat[base + (crc & 255)]
        for k in (1, 2, 3):
            out = out ^ flat[base + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
        return out

    def join(self, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of left + right, given the crc32 of both and the sizes of the right strings."""
        moved = self.look_up(self.tables[:64].reshape(-1), (sizes & 63) * 1024, left)
        rest, power = sizes >> 6, self.tables[64]
        while rest.any():
            long = (rest & 1).astype(bool)
            moved[long] = self.look_up(power.reshape(-1), 0, moved[long])
            power = self.look_up(power.reshape(-1), 0, power)
            rest = rest >> 1
        return moved ^ right


_joiner: list[CrcJoiner] = []


def feature_buckets(texts: list[list[bytes]], buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The text that each word belongs to, and for runs of 1, 2 and 3 words the places where they start and their buckets."""
    if not _joiner:
        _joiner.append(CrcJoiner())
    words = [w for own in texts for w in own]
    owner = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
    distinct = dict.fromkeys(words)
    number = dict(zip(distinct, range(len(distinct))))
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))[at]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))[at]
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))[at] + 1
    places = np.arange(len(words))
    crc, runs = alone, [(places, alone % np.uint32(buckets))]
    for more in (1, 2):
        inside = owner[places[: max(0, len(words) - more)]] == owner[more:]
        crc = _joiner[0].join(crc[: len(inside)], spaced[more:], sizes[more:])
        runs.append((places[: len(inside)][inside], (crc % np.uint32(buckets))[inside]))
    return owner, runs


def count_features(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over all whole texts; a task sends one row a bucket at most."""

    def counted(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0, SLICE_BYTES):
                _, runs = feature_buckets([words_of(t) for t in texts_of(part.column(0))], buckets)
                for _, own in runs:
                    total += np.bincount(own, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["bucket", "n"])

    return rows.select("text").mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket how much likelier the target is to have it, in floored thousandths of the natural logarithm."""
    both = []
    for rows in (docs, target):
        own = np.zeros(buckets, np.int64)
        found = count_features(rows, buckets).toArrow()  # one row a bucket at most
        own[found["bucket"].to_numpy()] = found["n"].to_numpy()
        both.append(own)
    source, wanted = (own.tolist() for own in both)
    s_all, t_all = float(sum(source) + buckets), float(sum(wanted) + buckets)
    gains = [math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(source, wanted)]
    return np.array(gains, np.int64)


def weigh_documents(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weighed(batches):
        import pyarrow as pa

        own_gains = shared.value
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                texts = [words_of(t) for t in texts_of(part.column(1))]
                owner, runs = feature_buckets(texts, len(own_gains))
                n_words = np.array([len(t) for t in texts], np.int64)
                per_place, n_features = np.zeros(len(owner) + 1, np.int64), np.zeros(len(texts), np.int64)
                for places, own in runs:
                    per_place[places + 1] += own_gains[own]
                    n_features += np.bincount(owner[places], minlength=len(texts))
                ends = np.cumsum(n_words)
                sums = np.cumsum(per_place)
                columns = [part.column(0), pa.array(n_words), pa.array(n_features), pa.array(sums[ends] - sums[ends - n_words])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weighed, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of Gumbel noise that the id and the seed determine."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")


def kth_key(rows: DataFrame, order: list[str], k: int, seed: int = 0) -> Row | None:
    """The ``k``-th row (from 1) of ``rows`` in the ascending order of the columns ``order``, found by quickselect.

    Each round draws PIVOTS random keys of the rows that are left, counts exactly how many keys
    stand below and at each, and goes on between the two pivots around the k-th key. Nothing
    is sorted, and the driver sees pivots and counts only. Nulls come first in each column.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    key = F.struct(*order)
    lit = lambda row: F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in order])
    left, need = rows.select(*order), k
    low = high = None
    for turn in range(10_000):
        within = left
        if low is not None:
            within = within.filter((F.col(order[0]) >= low[order[0]]) & (key > lit(low)))
        if high is not None:
            within = within.filter((F.col(order[0]) <= high[order[0]]) & (key < lit(high)))
        drawn = within.orderBy(F.xxhash64(*order, F.lit(seed + turn)), *order).limit(PIVOTS)
        pivots = drawn.orderBy(*order).collect()
        if not pivots:
            return None
        below = [F.count(F.when(key < lit(p), 1)) for p in pivots]
        equal = [F.count(F.when(key == lit(p), 1)) for p in pivots]
        counts = within.agg(*below, *equal).first()
        ends = [(counts[i], counts[i] + counts[len(pivots) + i]) for i in range(len(pivots))]
        after = next((i for i, (_, end) in enumerate(ends) if end >= need), len(pivots))
        if after < len(pivots) and ends[after][0] < need:
            return pivots[after]
        high = pivots[after] if after < len(pivots) else high
        if after:
            low, need = pivots[after - 1], need - ends[after - 1][1]
    raise RuntimeError("the selection did not end")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of each row of ``docs(doc_id, text)``, ``rank`` for drawn ones.

    Features are all runs of one to three words of whole texts, hashed to ``buckets``. A bucket's
    gain tells how much likelier it is in ``target(text)`` than in all documents; a document's
    weight is the sum of its gains, its score the weight and Gumbel noise of its id. Of
    documents with ``min_words`` words or more, ``percent`` in a hundred (floored) are drawn, highest score first,
    ties to the smaller id.

    Null and empty texts have no features, weight 0, and are never drawn if ``min_words`` is over 0.
    Rows are scored one by one, so repeated rows may both be drawn; null ids share the noise of an empty id
    and come last among ties. An empty table gives no rows, an empty target equal chances. Other
    columns of ``docs`` play no part. A text is hashed in one piece, other texts in slices of 4 MB.
    """
    docs = docs.select("doc_id", "text")
    weighed = weigh_documents(docs, bucket_gains(docs, target, buckets))
    scored = weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))
    scored = scored.withColumn("down", -F.col("score")).withColumn("nameless", F.col("doc_id").isNull())
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    order = ["down", "nameless", "doc_id", "n_features", "row"]
    able = F.col("n_words") >= min_words
    wanted = percent * scored.filter(able).count() // 100
    last = kth_key(scored.filter(able), order, wanted) if wanted else None
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    kinds = {f.name: f.dataType for f in scored.schema.fields}
    limit = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in order])
    drawn = able & (F.struct(*order) <= limit)
    ranked = global_rank(scored.filter(drawn), [F.asc_nulls_first(c) for c in order], "rank", 1, RANKED_BY_ONE_TASK)
    others = scored.filter(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*out, "rank").unionByName(others)


def keep_drawn(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn by :func:`resample`, with all their columns."""
    return docs.join(ranked.filter("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi").select(*[docs[f"`{c}`"] for c in docs.columns])
