"""Group names for clusters, the table of assignments, and the final tables.

``assignments`` holds one row per fixed category:
``category, group_name, kind ('auto' | 'join' | 'manual'), round``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalign.operators.hierarchy import NOISE
from catalign.runtime import lookup, stage

ASSIGNMENT_SCHEMA = "category string, group_name string, kind string, round int"
UNGROUPED = "ungrouped"


def representatives(clusters: DataFrame) -> DataFrame:
    """The first member of each cluster names it."""
    return clusters.groupBy("cluster").agg(
        F.min_by("original_category", F.struct("first_row_id", "original_category")).alias("group_name"),
        F.count(F.lit(1)).alias("n_members"),
    )


def auto_assignments(clusters: DataFrame, round_no: int = 1) -> DataFrame:
    """Every non-noise cluster of at least two categories becomes a fixed group."""
    named = representatives(clusters).filter((F.col("cluster") != NOISE) & (F.col("n_members") > 1))
    return _members(clusters, named, "auto", round_no)


def join_clusters(clusters: DataFrame, chosen: DataFrame, round_no: int = 1) -> DataFrame:
    """Fix the chosen clusters, whatever their size and even the noise cluster."""
    picked = clusters.join(chosen.select("cluster").distinct(), "cluster", "left_semi")
    return _members(picked, representatives(picked), "join", round_no)


def _members(clusters: DataFrame, named: DataFrame, kind: str, round_no: int) -> DataFrame:
    return clusters.join(named.select("cluster", "group_name"), "cluster").select(
        F.col("original_category").alias("category"),
        "group_name",
        F.lit(kind).alias("kind"),
        F.lit(round_no).alias("round"),
    )


def no_assignments(spark: SparkSession) -> DataFrame:
    """The reset state: nothing is fixed."""
    return spark.createDataFrame([], ASSIGNMENT_SCHEMA)


def resolve_assignments(assignments: DataFrame) -> DataFrame:
    """One group per category: the latest round wins, then the smaller name."""
    return assignments.groupBy("category").agg(
        F.min_by("group_name", F.struct(-F.col("round"), F.col("group_name"))).alias("assigned_group")
    )


def rename_map(clusters: DataFrame, assignments: DataFrame) -> DataFrame:
    """Category to group name: the assigned group, else the category itself."""
    return clusters.join(
        resolve_assignments(assignments).withColumnRenamed("category", "original_category"), "original_category", "left"
    ).select(
        F.col("original_category").alias("category"),
        F.coalesce("assigned_group", "original_category").alias("group_name"),
    )


def apply_groups(df: DataFrame, renames: DataFrame, category: str = "category") -> DataFrame:
    """Give every row the group of its category; rows of other categories keep theirs."""
    keep = F.col("group_name") if "group_name" in df.columns else F.lit(None).cast("string")
    joined = lookup(
        df.withColumn("_kept", keep).drop("group_name"),
        renames.select(F.col("category").alias(category), "group_name"),
        category,
    )
    return joined.withColumn("group_name", F.coalesce("group_name", "_kept")).drop("_kept")


def cross_source_filter(df: DataFrame, category: str = "category") -> DataFrame:
    """Keep rows whose group spans several sources, or that carry their own name.

    Counting is a two-step aggregate (min and max of the source decide "more
    than one" without ever collecting a group) and is joined back as a lookup.
    """
    spans = df.filter(F.col("group_name").isNotNull()).groupBy("group_name").agg(
        F.min("source_file").alias("_lo"), F.max("source_file").alias("_hi")
    )
    wide = spans.filter(F.col("_lo") != F.col("_hi")).select("group_name", F.lit(True).alias("_wide"))
    return (
        lookup(df, wide, "group_name")
        .filter(F.col("_wide") | (F.col("group_name") == F.col(category)))
        .drop("_wide")
    )


def filter_diagnostics(df: DataFrame, category: str = "category") -> DataFrame:
    same = F.col("group_name") == F.col(category)
    return df.agg(F.count_if(same).alias("own_name_rows"), F.count_if(~same).alias("grouped_rows"))


def unfixed_pool(categories: DataFrame, assignments: DataFrame) -> DataFrame:
    """Categories still open for the next clustering round."""
    return categories.join(assignments.select("category").distinct(), "category", "left_anti")


def manual_merge(assignments: DataFrame, chosen: DataFrame, name: str, round_no: int) -> DataFrame:
    """Fix any open categories under one name; refuses fixed ones and an empty name."""
    if not name:
        raise ValueError("a group name is needed")
    taken = chosen.select("category").join(assignments, "category", "left_semi").limit(5).collect()
    if taken:
        raise ValueError(f"already in a fixed group: {[r[0] for r in taken]}")
    added = chosen.select("category").distinct().select(
        "category", F.lit(name).alias("group_name"), F.lit("manual").alias("kind"), F.lit(round_no).alias("round")
    )
    return assignments.unionByName(added)


def category_listing(categories: DataFrame, assignments: DataFrame) -> DataFrame:
    """All categories with the group they are fixed in, if any."""
    return (
        categories.select("category")
        .join(resolve_assignments(assignments), "category", "left")
        .select("category", "assigned_group", F.col("assigned_group").isNull().alias("available"))
        .orderBy("category")
    )


def group_members(assignments: DataFrame, *tables: DataFrame, category: str = "category") -> DataFrame:
    """Categories of each fixed group, from the history and from given tables."""
    found = assignments.select("group_name", "category")
    fixed = assignments.select("group_name").distinct()
    for table in tables:
        pairs = table.select("group_name", F.col(category).alias("category")).distinct()
        found = found.unionByName(pairs.join(fixed, "group_name", "left_semi"))
    return found.distinct()


def explode_groups(
    assignments: DataFrame, df: DataFrame, exploded: DataFrame, category: str = "category"
) -> tuple[DataFrame, DataFrame]:
    """Dissolve groups: drop their assignments, put their rows back to the category."""
    names = exploded.select("group_name").distinct()
    left = assignments.join(names, "group_name", "left_anti").select(*assignments.columns)
    marked = lookup(df, names.withColumn("_hit", F.lit(True)), "group_name")
    restored = marked.withColumn(
        "group_name", F.when(F.col("_hit"), F.col(category)).otherwise(F.col("group_name"))
    ).drop("_hit")
    return left, restored


def current_groups(df: DataFrame, category: str = "category", order: str = "row_id") -> DataFrame:
    """The working group of each category: that of its first row."""
    return df.groupBy(F.col(category).alias("category")).agg(
        F.min_by("group_name", order).alias("current_group")
    )


def final_groups(
    df: DataFrame, working: DataFrame, assignments: DataFrame, category: str = "category"
) -> DataFrame:
    """Final group per row: assignment, else a working group that differs from
    the category, else ``ungrouped``. Two aggregates per category, one lookup."""
    resolved = current_groups(working, category).join(resolve_assignments(assignments), "category", "full_outer").select(
        F.col("category").alias(category),
        F.coalesce(
            "assigned_group", F.when(F.col("current_group") != F.col("category"), F.col("current_group"))
        ).alias("_final"),
    )
    joined = lookup(df.drop("group_name"), resolved, category)
    return joined.withColumn("group_name", F.coalesce("_final", F.lit(UNGROUPED))).drop("_final")


def working_table(working: DataFrame, assignments: DataFrame, category: str = "category") -> DataFrame:
    """The working rows with assigned categories overridden, for the next stage."""
    resolved = resolve_assignments(assignments).withColumnRenamed("category", category)
    joined = lookup(working, resolved, category)
    return joined.withColumn("group_name", F.coalesce("assigned_group", "group_name")).drop("assigned_group")


def group_summary(final: DataFrame, category: str = "category") -> DataFrame:
    """Distinct categories, distinct groups, and how far the list shrank."""
    pairs = final.select(category, "group_name").distinct()
    counts = pairs.agg(
        F.countDistinct(category).alias("total_categories"),
        F.countDistinct(F.when(F.col("group_name") != UNGROUPED, F.col("group_name"))).alias("grouped_categories"),
    )
    shrunk = F.round((1 - F.col("grouped_categories") / F.col("total_categories")) * 100, 1)
    return counts.withColumn(
        "reduction_pct", F.when(F.col("total_categories") > 0, shrunk).otherwise(F.lit(0.0))
    )


def top_groups(final: DataFrame, n: int = 5) -> DataFrame:
    return (
        final.filter(F.col("group_name") != UNGROUPED)
        .groupBy("group_name")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), "group_name")
        .limit(n)
    )


def cluster_listing(clusters: DataFrame) -> DataFrame:
    """Members in order of appearance, numbered inside their cluster.

    One row per member, so a cluster of any size stays distributed.
    """
    first = representatives(clusters).withColumnRenamed("group_name", "representative")
    return clusters.join(first, "cluster").select(
        "cluster",
        "original_category",
        "first_row_id",
        "representative",
        "n_members",
        (F.col("cluster") == NOISE).alias("is_noise"),
    )


def next_round(categories: DataFrame, assignments: DataFrame, cluster, round_no: int) -> DataFrame:
    """Cluster what is still open and append its groups to the assignments.

    ``cluster`` maps a frame ``(category, first_row_id)`` to cluster rows.
    """
    pool = stage(unfixed_pool(categories, assignments), "pool")
    added = auto_assignments(cluster(pool), round_no)
    return stage(assignments.unionByName(added), "assignments")
