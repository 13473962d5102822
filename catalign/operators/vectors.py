"""Embeddings of names and exact density clustering of them at scale.

Vectors are cut into blocks of bounded size by their nearest pivot (and a hash
within a crowded cell), and pairs of blocks that can hold neighbours at all (by
the triangle inequality on angles) are compared by small matrix products, part
by part. A task reports neighbour counts, a spanning forest of the links it saw, or
the pairs asked for; never all pairs of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalign.constants import EPS_FLAT, EPS_HIERARCHICAL, MIN_SAMPLES_FLAT, MIN_SAMPLES_HIERARCHICAL
from catalign.operators.components import connected_components, spanning_forest
from catalign.operators.hierarchy import NOISE, levels_of, long_levels
from catalign.runtime import SINGLE_TASK_ROWS, global_rank, spread, stage

BLOCK_VECTORS = 1024
# Blocks grow with the table up to this, as each vector is sent once for every block that its own one meets;
# a task then compares this many vectors of either side at a time.
MAX_BLOCK, BLOCKS, PART_VECTORS = 16384, 16, 1024
MAX_PIVOTS = 1024
# Parts of one cell are numbered below this.
MAX_PARTS = 1 << 32
WEIGHTED_LEVELS = 3


def ngram_embedding(text: Column, dims: int = 64, n: int = 3) -> Column:
    """Counts of hashed character n-grams of the lower-case, padded text."""
    padded = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
    bucket = lambda i: F.pmod(
        F.conv(F.substring(F.md5(F.substring(padded, i, F.lit(n)).cast("binary")), 1, 8), 16, 10).cast("bigint"),
        F.lit(dims),
    )
    count = lambda buckets: F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda d: F.size(F.filter(buckets, lambda b: b == d)).cast("double"),
    )
    return F.get(F.transform(F.array(F.transform(starts, bucket)), count), F.lit(0))


def embed_ngrams(texts: DataFrame, dims: int = 64, n: int = 3) -> DataFrame:
    return texts.select("text", ngram_embedding(F.col("text"), dims, n).alias("embedding"))


def embed_with_model(texts: DataFrame, make_predict, batch_size: int = 256) -> DataFrame:
    """Embed distinct texts with a caller's model, loaded once per Python worker.

    ``make_predict()`` returns a function from a numpy array of strings to a
    two-dimensional float array.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    predict = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    distinct = texts.select("text").distinct()
    return distinct.select("text", predict("text").cast("array<double>").alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_vector(vector: Column) -> Column:
    scaled = lambda p: F.transform(p["v"], lambda x: x / F.when(p["n"] > 0, p["n"]).otherwise(F.lit(1.0)))
    vector = vector.cast("array<double>")
    pair = F.struct(vector.alias("v"), F.sqrt(dot(vector, vector)).alias("n"))
    return F.get(F.transform(F.array(pair), scaled), F.lit(0))


def staged_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ids with their ``by``, and ``(id, by, raw)`` of the vectors, computed once.

    A vector that is null or holds a null has no neighbours; lengths must be equal.
    """
    by = F.col("by") if "by" in vectors.columns else F.lit(0)
    every = stage(vectors.select("id", by.alias("by"), F.col("embedding").cast("array<double>").alias("raw")), "raw")
    whole = every.filter(F.col("raw").isNotNull() & ~F.exists("raw", lambda x: x.isNull()))
    low, high = whole.agg(F.min(F.size("raw")), F.max(F.size("raw"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} dimensions can't be compared")
    return every.select("id", "by"), whole


def distinct_vectors(vectors: DataFrame, collapse: bool) -> tuple[DataFrame, DataFrame | None]:
    """Unit vectors with the number of copies they stand for, and who stands for whom.

    Copies are counted by a pre-aggregated group-by, so a vector that a third of
    the rows share costs one row per task. Zero vectors have no direction and
    stay apart.
    """
    if not collapse:
        return stage(vectors.select("id", "by", unit_vector(F.col("raw")).alias("vec"), F.lit(1).cast("bigint").alias("copies")), "vectors"), None
    rows = vectors
    apart = F.when(F.exists("raw", lambda x: x != 0), F.lit(None)).otherwise(F.col("id"))
    groups = rows.groupBy("by", "raw", apart.alias("_apart")).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    chosen = stage(groups.select("id", "by", "raw", unit_vector(F.col("raw")).alias("vec"), "copies"), "vectors")
    copied = chosen.filter("copies > 1").select("by", "raw", F.col("id").alias("stands_for"))
    return chosen.drop("raw"), rows.join(copied, ["by", "raw"]).select("id", "by", "stands_for").filter("id <> stands_for")


def compared_blocks(vectors: DataFrame, eps: float, block_vectors: int) -> DataFrame:
    """Vectors repeated for every block pair they take part in: ``+ lo, hi, side``.

    ``block_vectors`` is the size of a block in a small table; in a large one blocks are larger, but bounded.
    If there is a column ``fresh``, fresh vectors have blocks of their own, and blocks without any don't meet
    each other (all of a small table is one block, though).
    """
    own_blocks = ["fresh"] if "fresh" in vectors.columns else []
    total = vectors.count()
    if total <= block_vectors:
        zero = F.lit(0).cast("bigint")
        return vectors.select("*", zero.alias("lo"), zero.alias("hi"), F.lit(0).alias("side"))
    block_vectors = max(block_vectors, min(MAX_BLOCK, math.ceil(total / BLOCKS)))
    pivots = np.array(
        [
            r["vec"]
            for r in vectors.orderBy(F.xxhash64("id"), "id").limit(min(MAX_PIVOTS, math.ceil(total / block_vectors))).select("vec").collect()
        ]
    )

    def assign(batches):
        for batch in batches:
            sims = np.clip(np.vstack(batch["vec"].to_numpy()) @ pivots.T, -1, 1)
            cell = sims.argmax(axis=1)
            yield batch.assign(cell=cell.astype("int32"), angle=np.arccos(sims[np.arange(len(cell)), cell]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    placed = stage(vectors.mapInPandas(assign, schema + ", cell int, angle double"), "placed")
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach = math.acos(max(-1.0, 1 - eps)) + 1e-6

    @F.pandas_udf("double")
    def apart(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series(between[one.to_numpy(), other.to_numpy()])

    # A crowded cell is cut by a hash into parts; a block is one part of one cell of one ``by``.
    cells = placed.groupBy("by", "cell", *own_blocks).agg(
        F.ceil(F.count(F.lit(1)) / block_vectors).cast("int").alias("parts"), F.max("angle").alias("radius")
    )
    cells = stage(cells, "cells")
    other = cells.select("by", *[F.col(c).alias(f"{c}2") for c in ("cell", "parts", "radius", *own_blocks)])
    met = (
        cells.join(other, "by")
        .filter((F.col("cell") == F.col("cell2")) | (apart("cell", "cell2") - F.col("radius") - F.col("radius2") <= reach))
        .filter(F.col("fresh") | F.col("fresh2") if own_blocks else F.lit(True))
        .select("by", "cell", "parts", "cell2", "parts2", *own_blocks, *[f"{c}2" for c in own_blocks])
    )
    place = lambda cell: F.col(cell) * 2 + F.col(cell.replace("cell", "fresh")).cast("int") if own_blocks else F.col(cell)
    block = lambda cell, part: place(cell).cast("bigint") * MAX_PARTS + part
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    met = placed.join(stage(met, "plan"), ["by", "cell", *own_blocks]).select(
        *vectors.columns,
        block("cell", own).alias("block"),
        F.explode(F.sequence(block("cell2", F.lit(0)), block("cell2", F.col("parts2") - 1))).alias("partner"),
    )
    return met.select(
        *vectors.columns,
        F.least("block", "partner").alias("lo"),
        F.greatest("block", "partner").alias("hi"),
        (F.col("block") > F.col("partner")).cast("int").alias("side"),
    )


def block_sides(pdf):
    """Both sides of a block pair, if they are the same one, and its parts.

    A part is a slice of the left side, one of the right side, whether both are the same vectors, and the matrix of
    cosine distances; of a block with itself each pair of slices comes once.
    """
    left = pdf[pdf["side"] == 0]
    alone = bool((pdf["lo"] == pdf["hi"]).iloc[0])
    right = left if alone else pdf[pdf["side"] == 1]

    def parts():
        if len(left) == 0 or len(right) == 0:
            return
        one = np.vstack(left["vec"].to_numpy())
        two = one if alone else np.vstack(right["vec"].to_numpy())
        for i in range(0, len(one), PART_VECTORS):
            for j in range(i if alone else 0, len(two), PART_VECTORS):
                at, to = slice(i, min(i + PART_VECTORS, len(one))), slice(j, min(j + PART_VECTORS, len(two)))
                distance = 1 - one[at] @ two[to].T
                if same := alone and i == j:
                    np.fill_diagonal(distance, 0.0)
                yield at, to, same, distance

    return left, right, alone, parts()


class Trees:
    """Union-find over both sides of a block pair, for whole matrices of links at once."""

    def __init__(self, left: int, right: int, alone: bool):
        self.shift = 0 if alone else left
        self.label = np.arange(left if alone else left + right)
        self.rows: list[int] = []
        self.columns: list[int] = []

    def merge(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Join the trees of rows ``one`` and columns ``two``; which of these pairs joined two."""
        a, b = self.label[one], self.label[two + self.shift]
        used, root, parent = spanning_forest(a.tolist(), b.tolist())
        touched = list(parent)
        become = np.arange(len(self.label))
        become[touched] = [root(x) for x in touched]
        self.label = become[self.label]
        kept = set(used)
        new = np.zeros(len(a), bool)
        for n, ends in enumerate(zip(a.tolist(), b.tolist())):
            if ends in kept:
                kept.discard(ends)
                new[n] = True
        return new

    def add(self, at: slice, to: slice, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the links of ``hit`` that join two trees; they are kept, too."""
        ends = np.concatenate([self.label[at], self.label[to.start + self.shift : to.stop + self.shift]])
        if (ends == ends[0]).all():
            return np.zeros(0, int), np.zeros(0, int)
        i, j = np.nonzero(hit)
        i, j = i + at.start, j + to.start
        rows, columns = [np.zeros(0, int)], [np.zeros(0, int)]
        while True:
            apart = self.label[i] != self.label[j + self.shift]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            # One link from each tree at a time, seen from either side.
            first = [np.unique(self.label[x], return_index=True)[1] for x in (i, j + self.shift)]
            first = np.unique(np.concatenate(first))
            new = self.merge(i[first], j[first])
            rows.append(i[first][new])
            columns.append(j[first][new])
        rows, columns = np.concatenate(rows), np.concatenate(columns)
        self.rows += rows.tolist()
        self.columns += columns.tolist()
        return rows, columns


def cosine_pairs(vectors: DataFrame, eps: float, collapse: bool = True, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """Pairs ``id1 < id2`` of distinct vectors within a cosine distance.

    Copies of a vector are represented by the smallest id (``collapse=False``
    lists them like any other pair).
    """
    _, whole = staged_vectors(vectors)
    distinct, _ = distinct_vectors(whole, collapse)
    id_type = vectors.schema["id"].dataType.simpleString()

    # Pairs are returned part by part: all of a large block would not fit.
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, _, parts = block_sides(pd.concat(list(batches)))
        one, two = left["id"].to_numpy(), right["id"].to_numpy()
        for at, to, same, distance in parts:
            hit = distance <= eps
            i, j = np.nonzero(np.triu(hit, 1) if same else hit)
            a, b = one[at][i], two[to][j]
            swap = a > b
            yield pd.DataFrame({"id1": np.where(swap, b, a), "id2": np.where(swap, a, b), "distance": distance[i, j]})

    return (
        spread(compared_blocks(distinct, eps, block_vectors), "by", "lo", "hi")
        .groupBy("by", "lo", "hi")
        .applyInPandas(near, f"id1 {id_type}, id2 {id_type}, distance double")
    )


def dbscan(
    vectors: DataFrame,
    eps: float = EPS_FLAT,
    min_samples: int = MIN_SAMPLES_FLAT,
    block_vectors: int = BLOCK_VECTORS,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Density clusters of ``vectors(id, embedding[, by])`` by cosine distance.

    A vector with at least ``min_samples`` vectors (itself included) within
    ``eps`` is a core. Linked cores share a cluster, numbered from 0 by the
    smallest core id; another vector near a core takes the smallest such number;
    the rest is noise (-1). With ``by``, vectors only meet within the same value
    and clusters are numbered across all of them, ordered by it first. Null vectors are noise.

    With ``min_samples`` of 1 or 2 every vector that is near another is a core, so one pass over the
    distances finds cores and links; with more, a first pass counts and a second one links.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    every, whole = staged_vectors(vectors)
    distinct, copies = distinct_vectors(whole, True)
    if min_samples <= 2:
        found = stage(_near_links(distinct, eps, block_vectors), "links")
        cores = distinct.select("id", "by", "copies")
        if min_samples == 2:
            ends = found.select(F.col("src").alias("id")).unionByName(found.select(F.col("dst").alias("id"))).distinct()
            linked = ends.withColumn("linked", F.lit(True))
            cores = cores.join(linked, "id", "left").filter("copies > 1 or linked")
        cores = stage(cores.select("id", "by"), "cores")
        border = every.select("id", F.lit(0).alias("cluster")).limit(0)
        return _numbered_clusters(vectors, every, copies, cores, found, lambda labelled: border, single_task_rows)

    def tally(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, alone, parts = block_sides(pdf)
        copies = [side["copies"].to_numpy(np.float64) for side in (left, right)]
        n = [np.zeros(len(left)), np.zeros(len(right))]
        n = [n[0], n[0]] if alone else n
        for at, to, same, distance in parts:
            hit = (distance <= eps).astype(np.float64)
            n[0][at] += hit @ copies[1][to]
            if not same:
                n[1][to] += copies[0][at] @ hit
        sides = [(left, n[0])] if alone else [(left, n[0]), (right, n[1])]
        return pd.concat([pd.DataFrame({"id": side["id"], "n": found.astype(np.int64)}) for side, found in sides])

    counts = (
        spread(compared_blocks(distinct, eps, block_vectors), "by", "lo", "hi")
        .groupBy("by", "lo", "hi")
        .applyInPandas(tally, f"id {id_type}, n bigint")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
    )
    flagged = stage(
        distinct.join(counts, "id").withColumn("core", F.col("n") >= min_samples).drop("n"), "cores"
    )

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, alone, parts = block_sides(pdf)
        lc, rc = left["core"].to_numpy(dtype=bool), right["core"].to_numpy(dtype=bool)
        li, ri = left["id"].to_numpy(), right["id"].to_numpy()
        trees = Trees(len(left), len(right), alone)
        src, dst = [li[:0]], [li[:0]]
        for at, to, same, distance in parts:
            hit = distance <= eps
            trees.add(at, to, hit & lc[at][:, None] & rc[to][None, :])
            # A vector that is no core has fewer than min_samples neighbours to list.
            i, j = np.nonzero(hit & ~lc[at][:, None] & rc[to][None, :])
            src.append(li[at][i])
            dst.append(ri[to][j])
            if not same:
                i, j = np.nonzero(hit & lc[at][:, None] & ~rc[to][None, :])
                src.append(ri[to][j])
                dst.append(li[at][i])
        both = pd.DataFrame({"src": li[np.array(trees.rows, int)], "dst": ri[np.array(trees.columns, int)], "both_core": True})
        return pd.concat([both, pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "both_core": False})])

    found = stage(
        spread(compared_blocks(flagged, eps, block_vectors), "by", "lo", "hi")
        .groupBy("by", "lo", "hi")
        .applyInPandas(links, f"src {id_type}, dst {id_type}, both_core boolean"),
        "links",
    )
    cores = flagged.filter("core").select("id", "by")
    border = lambda labelled: (
        found.filter("NOT both_core")
        .join(labelled.withColumnRenamed("id", "dst"), "dst")
        .groupBy(F.col("src").alias("id"))
        .agg(F.min("cluster").alias("cluster"))
    )
    return _numbered_clusters(vectors, every, copies, cores, found.filter("both_core"), border, single_task_rows)


def _near_links(vectors: DataFrame, eps: float, block_vectors: int) -> DataFrame:
    """``(src, dst)``: from each block pair a spanning forest of the vectors within ``eps`` of each other."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, alone, parts = block_sides(pdf)
        trees = Trees(len(left), len(right), alone)
        for at, to, _, distance in parts:
            trees.add(at, to, distance <= eps)
        return pd.DataFrame({"src": left["id"].to_numpy()[np.array(trees.rows, int)], "dst": right["id"].to_numpy()[np.array(trees.columns, int)]})

    blocks = spread(compared_blocks(vectors, eps, block_vectors), "by", "lo", "hi")
    return blocks.groupBy("by", "lo", "hi").applyInPandas(links, f"src {id_type}, dst {id_type}")


def _numbered_clusters(vectors, every, copies, cores, links, border, single_task_rows: int) -> DataFrame:
    """``(id[, by], cluster)``: components of ``cores(id, by)``, what ``border(labelled)`` adds, copies and noise."""
    parts = stage(connected_components(cores.select("id"), links.select("src", "dst")).join(cores, "id"), "parts")
    numbers = global_rank(
        parts.select("by", "component").distinct(), [F.col("by"), F.col("component")], "cluster", single_task_rows=single_task_rows
    )
    labelled = stage(parts.join(numbers.drop("by"), "component").select("id", F.col("cluster").cast("int").alias("cluster")), "labels")
    known = labelled.unionByName(border(labelled))
    if copies is not None:
        known = stage(known, "known")
        same = copies.join(known.withColumnRenamed("id", "stands_for"), "stands_for").select("id", "cluster")
        known = known.unionByName(same)
    return every.select("id", *(["by"] if "by" in vectors.columns else [])).join(known, "id", "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(NOISE))
    )


def _label_categories(categories: DataFrame, clusters: DataFrame) -> DataFrame:
    return categories.join(clusters.withColumnRenamed("id", "first_row_id"), "first_row_id").select(
        F.col("category").alias("original_category"), "first_row_id", "cluster"
    )


def cluster_flat(
    categories: DataFrame, embed=embed_ngrams, eps: float = EPS_FLAT, min_samples: int = MIN_SAMPLES_FLAT
) -> DataFrame:
    """Cluster category names by their embedding."""
    texts = categories.select(F.col("category").alias("text"))
    vectors = embed(texts).join(categories.withColumnRenamed("category", "text"), "text").select(
        F.col("first_row_id").alias("id"), "embedding"
    )
    return _label_categories(categories, dbscan(vectors, eps, min_samples))


def weighted_embedding(
    categories: DataFrame, embed=embed_ngrams, separator: str = "/", max_levels: int = WEIGHTED_LEVELS
) -> DataFrame:
    """Mean of the level embeddings weighted 1, 1/2, 1/3; at most three levels.

    Distinct level texts are embedded once. A path without any level text is
    embedded as a whole.
    """
    parts = F.filter(levels_of(F.col("category"), separator), lambda p: p != "")
    whole = F.when(F.size(parts) > 0, F.slice(parts, 1, max_levels)).otherwise(F.array("category"))
    levels = categories.select("category", "first_row_id", F.posexplode(whole).alias("pos", "text"))
    vectors = stage(embed(levels.select("text").distinct()), "level_vectors")
    scaled = levels.join(vectors, "text").select(
        "category",
        "first_row_id",
        "pos",
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x / (F.col("pos") + 1)).alias("v"),
    )
    # At most max_levels vectors per category.
    gathered = scaled.groupBy("category", "first_row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("vs"))
    summed = F.aggregate(
        F.slice("vs", 2, max_levels),
        F.get("vs", F.lit(0))["v"],
        lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + b),
    )
    return gathered.select(
        "category", "first_row_id", F.transform(summed, lambda x: x / F.size("vs")).alias("embedding")
    )


def cluster_weighted(
    categories: DataFrame,
    embed=embed_ngrams,
    separator: str = "/",
    eps: float = EPS_HIERARCHICAL,
    min_samples: int = MIN_SAMPLES_HIERARCHICAL,
) -> DataFrame:
    vectors = weighted_embedding(categories, embed, separator)
    found = dbscan(vectors.select(F.col("first_row_id").alias("id"), "embedding"), eps, min_samples)
    return _label_categories(categories, found)


def cluster_by_levels(
    categories: DataFrame,
    embed=embed_ngrams,
    eps: float = EPS_FLAT,
    min_samples: int = MIN_SAMPLES_FLAT,
    separator: str = "/",
) -> DataFrame:
    """Cluster the values of each level on their own, all levels in one job.

    Levels with fewer than two values are left out. Cluster numbers start at 0
    on every level.
    """
    values = (
        long_levels(categories, separator)
        .groupBy("level", F.col("value").alias("text"))
        .agg(F.min("first_row_id").alias("seen"))
    )
    values = stage(values, "level_values")
    enough = values.groupBy("level").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("level")
    numbered = global_rank(values.join(enough, "level"), [F.col("level"), F.col("seen"), F.col("text")], "id")
    numbered = stage(numbered, "numbered")
    vectors = stage(embed(numbered.select("text").distinct()), "level_vectors")
    found = dbscan(
        numbered.join(vectors, "text").select("id", F.col("level").alias("by"), "embedding"), eps, min_samples
    )
    labelled = stage(numbered.join(found.drop("by"), "id"), "labelled")
    first = labelled.filter(F.col("cluster") != NOISE).groupBy("level").agg(F.min("cluster").alias("lowest"))
    return labelled.join(first, "level", "left").select(
        "level",
        F.col("text").alias("category"),
        F.when(F.col("cluster") == NOISE, F.col("cluster")).otherwise(F.col("cluster") - F.col("lowest")).alias("cluster"),
    )


def hierarchical_clusters(
    categories: DataFrame, separator: str = "/", strategy: str = "weighted_combined", threshold: float = EPS_HIERARCHICAL, embed=embed_ngrams
) -> DataFrame:
    """Cluster category paths by one of three strategies."""
    from catalign.operators.hierarchy import cluster_detailed_first, cluster_parent_fallback

    if strategy == "detailed_first":
        return cluster_detailed_first(categories, separator)
    if strategy == "parent_fallback":
        return cluster_parent_fallback(categories, separator)
    return cluster_weighted(categories, embed, separator, threshold)
