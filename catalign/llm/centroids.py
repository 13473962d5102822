"""Vectors in clusters around centroids: Walsh-Hadamard coefficients compared coarse to fine, in whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalign.runtime import stage

SIZE, SCALE = 64, 64
# Whole components beyond this are set to it: squared distances of 64 transformed ones then fit into 63 bits.
LARGEST = 1 << 24
# Ends of the runs of coefficients that are compared one after the other.
LEVELS = (4, 8, 16, 32, 64)
# Vectors whose distances a task holds at once.
SLICE_ROWS = 2048
LONG_MAX = (1 << 63) - 1


def whole_numbers(vector: Column) -> Column:
    """The vector's components as whole numbers, floor(64 x)."""
    floor = lambda x: F.floor(x.cast("double") * SCALE)
    return F.transform(vector, lambda x: F.greatest(F.least(floor(x), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def kept_vectors(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(vec_id, x)`` of the vectors with 64 components, all of them finite."""
    wide = F.col(f"`{vector}`")
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    sound = vectors.filter((F.size(wide) == SIZE) & ~F.exists(wide, bad))
    return sound.select(F.col(f"`{id_column}`").alias("vec_id"), whole_numbers(wide).alias("x"))


def coarse_first() -> np.ndarray:
    """The coefficients by the number of sign changes of their Walsh function."""
    signs = np.array([[1 - 2 * (bin(i & j).count("1") & 1) for j in range(SIZE)] for i in range(SIZE)])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, exact, coarse coefficients first.

    Squared distances of transformed rows are 64 times those of the rows.
    """
    out = x.astype(np.int64)
    half = 1
    while half < SIZE:
        pairs = out.reshape(len(out), SIZE // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), SIZE)
        half *= 2
    return out[:, coarse_first()]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid (ties: the smaller number), both sides transformed.

    The sum over the first coefficients never exceeds the whole one. The centroid with the smallest
    first sum is finished at once; whatever has already more than that is strictly worse and drops out,
    level after level. Those that stay are summed over all 64 coefficients.
    """
    first = LEVELS[0]
    sums = ((x[:, None, :first] - centroids[None, :, :first]) ** 2).sum(2)
    bound = ((x - centroids[sums.argmin(1)]) ** 2).sum(1)
    for start, end in zip(LEVELS, LEVELS[1:]):
        row, number = np.nonzero(sums <= bound[:, None])
        sums[row, number] += ((x[row, start:end] - centroids[number, start:end]) ** 2).sum(1)
    # One that dropped out has more than the bound already, so the smallest sum is a whole one.
    found = sums.argmin(1)
    return found, sums[np.arange(len(x)), found] // SIZE


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _cluster_sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each centroid's vectors; a task sends one row a centroid."""

    def summed(batches):
        import pyarrow as pa

        coded = walsh(centroids)
        n, total = np.zeros(len(coded), np.int64), np.zeros((len(coded), SIZE), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                x = _vectors(batch.column(0).slice(start, SLICE_ROWS)).astype(np.int64)
                found, _ = nearest(walsh(x), coded)
                for number in np.unique(found):
                    n[number] += (found == number).sum()
                    total[number] += x[found == number].sum(0)
        hit = np.flatnonzero(n)
        columns = [pa.array(hit, pa.int32()), pa.array(n[hit]), pa.array(list(total[hit]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    parts = rows.select("x").mapInArrow(summed, "cluster int, n bigint, sums array<bigint>")
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(SIZE)])
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("sums")).collect()
    return {r["cluster"]: (r["n"], r["sums"]) for r in found}


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def placed(batches):
        import pyarrow as pa

        coded = walsh(centroids)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found, distance = nearest(walsh(_vectors(part.column(1))), coded)
                columns = [part.column(0), pa.array(found, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(placed, f"vec_id {kind}, cluster int, distance bigint")


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, id_column: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia)`` of each kept vector, and the final centroids.

    Vectors count if they have 64 components, none null or not finite; components become floor(64 x). The
    first centroids are the ``k`` vectors of the smallest hash of their id. Each round assigns all vectors and replaces a centroid by the
    floored mean of its vectors; one without vectors stays. All sums and distances are exact.

    Null, empty and odd vectors give no row. Repeated rows count one by one, also as first centroids; a null id is hashed as
    an empty one. With fewer than ``k`` vectors there are as many centroids. An empty table gives no rows and no
    centroids. Whole components beyond 2^24 are set to 2^24; inertias beyond a long are set to the largest long.
    Other columns play no part. The driver sees ``k`` vectors a round.
    """
    spark = vectors.sparkSession
    rows = stage(kept_vectors(vectors, id_column, vector), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["x"]) for r in rows.orderBy(rank, "x").limit(k).collect()]
    if not centroids:
        nothing = rows.select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"))])
        return nothing.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("cluster_inertia", "inertia")]), []
    for _ in range(rounds):
        for number, (n, sums) in _cluster_sums(rows, np.array(centroids, np.int64)).items():
            centroids[number] = [s // n for s in sums]
    placed = stage(_assigned(rows, np.array(centroids, np.int64)), "placed")
    found = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in found}
    cut = lambda n: min(n, LONG_MAX)
    per_cluster = spark.createDataFrame(
        [(c, cut(s), cut(sum(inertia.values()))) for c, s in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint"
    )
    return placed.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
