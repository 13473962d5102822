"""Approximate neighbours: a random-projection index with several tables and probes, at a chosen recall.

Each table gives a vector one bit for each random hyperplane, the side it lies on. Vectors whose bits differ in at
most ``radius`` places meet: a vector lives in the bucket of its own bits and visits those around it. What meets is compared
exactly, so only recall is approximate. A crowded bucket is cut into blocks, none is left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalign.operators.vectors import BLOCK_VECTORS, BLOCKS, MAX_BLOCK, PART_VECTORS, distinct_vectors, staged_vectors
from catalign.runtime import spread, stage

# Comparisons that cost as much as sending one vector to a bucket.
ROW_COST = 5000
MAX_PROBES = 400
MAX_TABLES = 64


class Plan(NamedTuple):
    """Bits of a bucket's key, places in which keys may differ, and tables."""

    bits: int
    radius: int
    tables: int


def hit_chance(eps: float, bits: int, radius: int) -> float:
    """Chance that two vectors at cosine distance ``eps`` meet in one table."""
    differ = math.acos(max(-1.0, min(1.0, 1 - eps))) / math.pi
    return sum(math.comb(bits, i) * differ**i * (1 - differ) ** (bits - i) for i in range(radius + 1))


def plan_index(n: int, eps: float, recall: float) -> Plan:
    """The cheapest index in which any two vectors within ``eps`` meet with chance ``recall`` or more.

    Counted are rows sent to buckets and comparisons of vectors in unrelated directions.
    """
    best: tuple[float, Plan] | None = None
    for bits in range(1, 25):
        for radius in range(min(4, bits)):
            probes = sum(math.comb(bits, i) for i in range(radius + 1))
            chance = hit_chance(eps, bits, radius)
            tables = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log1p(-chance))
            if probes > MAX_PROBES or tables > MAX_TABLES:
                continue
            cost = tables * (n * (1 + probes) / 2 * ROW_COST + n * n / 2 * probes / 2**bits)
            if best is None or cost < best[0]:
                best = cost, Plan(bits, radius, tables)
    return best[1]


def lsh_pairs(
    vectors: DataFrame,
    eps: float,
    recall: float = 0.95,
    plan: Plan | None = None,
    seed: int = 1,
    collapse: bool = True,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """``(id1, id2, distance)``: pairs ``id1 < id2`` of distinct vectors within a cosine distance, nearly all of them.

    A pair within ``eps`` is missed with chance ``1 - recall`` at most, over the choice of hyperplanes; all
    distances are exact. Copies are represented by the smallest id; null vectors have no neighbours. A pair that
    meets in several tables is reported by the first, so nothing is made distinct afterwards.
    """
    _, whole = staged_vectors(vectors)
    distinct, _ = distinct_vectors(whole, collapse)
    id_type = vectors.schema["id"].dataType.simpleString()
    total, dims = distinct.agg(F.count("*"), F.max(F.size("vec"))).first()
    bits, radius, tables = plan or plan_index(total, eps, recall)
    planes = np.random.default_rng(seed).standard_normal((dims or 1, tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def keyed(batches):
        for batch in batches:
            if len(batch):
                sides = (np.vstack(batch["vec"].to_numpy()) @ planes > 0).reshape(len(batch), tables, bits)
                yield batch.assign(keys=list(sides @ weights))

    schema = f"id {id_type}, by {whole.schema['by'].dataType.simpleString()}, vec array<double>, keys array<bigint>"
    rows = stage(distinct.select("id", "by", "vec").mapInPandas(keyed, schema), "keyed")
    masks = [sum(1 << b for b in flips) for i in range(radius + 1) for flips in itertools.combinations(range(bits), i)]
    placed = rows.select("id", "by", "vec", "keys", F.posexplode("keys").alias("nth", "own"))
    placed = placed.select("*", F.explode(F.transform(F.lit(masks), lambda m: F.col("own").bitwiseXOR(m.cast("bigint")))).alias("bucket"))
    # Of two keys the larger one's vector visits the smaller one's bucket.
    placed = placed.filter("bucket <= own")
    at = ["by", "nth", "bucket"]
    home = F.col("own") == F.col("bucket")
    sizes = placed.groupBy(*at).agg(F.count_if(home).alias("homes"), F.count("*").alias("members")).filter("homes > 0 and members > 1")
    # Each part of a bucket is sent once for every part that it meets.
    block_vectors = max(block_vectors, min(MAX_BLOCK, math.ceil(total / BLOCKS)))
    cut = lambda c: F.ceil(F.col(c) / block_vectors).cast("int")
    sizes = stage(sizes.select(*at, cut("homes").alias("h_parts"), cut("members").alias("m_parts")), "buckets")
    met = placed.join(sizes, at)
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = [*at, "id", "vec", "keys"]
    living = met.filter(home).withColumn("side", F.lit(0)).withColumn("h", part("h_parts")).withColumn("m", every("m_parts"))
    coming = met.withColumn("side", F.lit(1)).withColumn("m", part("m_parts")).withColumn("h", every("h_parts"))
    block = living.select(*fields, "side", "h", "m").unionByName(coming.select(*fields, "side", "h", "m"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        nth, bucket = int(pdf["nth"].iloc[0]), int(pdf["bucket"].iloc[0])
        sides = [pdf[pdf["side"] == side] for side in (0, 1)]
        if not len(sides[0]) or not len(sides[1]):
            return
        (a, one, left), (b, two, right) = ((side["id"].to_numpy(), np.vstack(side["keys"].to_numpy()), np.vstack(side["vec"].to_numpy())) for side in sides)
        starts = itertools.product(range(0, len(a), PART_VECTORS), range(0, len(b), PART_VECTORS))
        for x, y in ((slice(i, i + PART_VECTORS), slice(j, j + PART_VECTORS)) for i, j in starts):
            distance = 1 - left[x] @ right[y].T
            i, j = np.nonzero((distance <= eps) & ((two[y, nth] != bucket)[None, :] | (a[x][:, None] < b[y][None, :])))
            fresh = np.ones(len(i), bool)
            for earlier in range(nth):
                fresh &= np.bitwise_count(one[x][i, earlier] ^ two[y][j, earlier]) > radius
            i, j = i[fresh], j[fresh]
            first, second = a[x][i], b[y][j]
            yield pd.DataFrame({"id1": np.where(first < second, first, second), "id2": np.where(first < second, second, first), "distance": distance[i, j]})

    return spread(block, *at, "h", "m").groupBy(*at, "h", "m").applyInPandas(near, f"id1 {id_type}, id2 {id_type}, distance double")
