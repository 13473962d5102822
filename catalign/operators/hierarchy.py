"""Categories written as paths (``A/B/C``) and groupings by level equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalign.runtime import SINGLE_TASK_ROWS, global_rank, stage

NOISE = -1


def levels_of(category: Column, separator: str = "/") -> Column:
    """The path as an array of trimmed parts (a null category has none)."""
    return F.transform(F.split(category, "\\Q" + separator + "\\E"), lambda part: F.trim(part))


def parse_levels(df: DataFrame, category: str = "category", separator: str = "/") -> tuple[DataFrame, int]:
    """Add ``category_level_1..n``; a missing level is the empty string."""
    depth = df.agg(F.max(F.size(levels_of(F.col(category), separator)))).first()[0] or 0
    depth = max(depth, 0)
    parts = levels_of(F.col(category), separator)
    wide = [
        F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f"category_level_{i + 1}") for i in range(depth)
    ]
    return df.select("*", *wide), depth


def long_levels(categories: DataFrame, separator: str = "/") -> DataFrame:
    """One row per non-empty level: ``(category, first_row_id, level, value)``."""
    return (
        categories.select("category", "first_row_id", F.posexplode(levels_of(F.col("category"), separator)))
        .filter(F.col("col") != "")
        .select("category", "first_row_id", (F.col("pos") + 1).alias("level"), F.col("col").alias("value"))
    )


def cluster_detailed_first(
    categories: DataFrame, separator: str = "/", single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Group categories that share the value of their deepest level.

    Cluster ids run over all (level, value) pairs, deepest level first and by
    first appearance within a level, and each category takes its deepest pair.
    A category without any non-empty level gets no row.
    """
    levels = long_levels(categories, separator)
    pairs = levels.groupBy("level", "value").agg(F.min("first_row_id").alias("seen"))
    ids = global_rank(
        pairs, [F.col("level").desc(), F.col("seen"), F.col("value")], "cluster", single_task_rows=single_task_rows
    )
    deepest = levels.groupBy("category", "first_row_id").agg(
        F.max(F.struct("level", "value")).alias("deepest")
    ).select("category", "first_row_id", "deepest.level", "deepest.value")
    return deepest.join(ids, ["level", "value"]).select(
        F.col("category").alias("original_category"), "first_row_id", F.col("cluster").cast("int").alias("cluster")
    )


def cluster_parent_fallback(
    categories: DataFrame, separator: str = "/", single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Group by the deepest shared level, falling back to parents.

    Levels are taken from the deepest up; at each level the still ungrouped
    categories with the same value form a group if there are at least two.
    What remains is noise. Ids follow level (deepest first), then appearance.
    """
    pool = stage(categories.select("category", "first_row_id"), "pool")
    depth = pool.agg(F.max(F.size(levels_of(F.col("category"), separator)))).first()[0] or 0
    grouped: DataFrame | None = None
    for level in range(depth, 0, -1):
        value = F.get(levels_of(F.col("category"), separator), F.lit(level - 1))
        keyed = pool.withColumn("value", value).filter(F.col("value") != "")
        shared = keyed.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("first_row_id").alias("seen"))
        hit = keyed.join(shared.filter("n > 1"), "value").select(
            "category", "first_row_id", F.lit(level).alias("level"), "value", "seen"
        )
        hit = stage(hit, "level")
        grouped = hit if grouped is None else grouped.unionByName(hit)
        pool = stage(pool.join(hit.select("category"), "category", "left_anti"), "pool")
    if grouped is None:
        return categories.limit(0).select(
            F.col("category").alias("original_category"), "first_row_id", F.lit(NOISE).alias("cluster")
        )
    ids = global_rank(
        grouped.select("level", "value", "seen").distinct(),
        [F.col("level").desc(), F.col("seen"), F.col("value")],
        "cluster",
        single_task_rows=single_task_rows,
    )
    named = grouped.join(ids, ["level", "value", "seen"]).select(
        F.col("category").alias("original_category"), "first_row_id", F.col("cluster").cast("int").alias("cluster")
    )
    rest = pool.select(F.col("category").alias("original_category"), "first_row_id", F.lit(NOISE).alias("cluster"))
    return named.unionByName(rest)


def number_of_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.countDistinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"))
