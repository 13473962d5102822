"""Mergeable summaries: quantile sketches of columns and theta sketches of product sets, a row for each file.

A new file adds its own rows; tables are never read again, only their sketches are merged. Sketches have a
fixed size, so a profile of any table is as large as that of a small one, within stated errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalign.operators.profile import number_unit_pairs
from catalign.operators.schema import unpivot_values

# Size of quantile sketches, and the binary logarithm of the entries of theta sketches.
QUANTILE_K, THETA_LG = 400, 13


def rank_error(k: int = QUANTILE_K) -> float:
    """How far the rank of a quantile may be off, as a share of all values, in 99 of 100 cases."""
    return 2.296 / k**0.9723


def column_numbers(df: DataFrame, columns: list[str], source: str = "source_file") -> DataFrame:
    """``(source, column_name, number)``: all numbers of all values of the columns, in no order."""
    cells = unpivot_values(df, columns, [source])
    pairs = cells.select(F.col(f"`{source}`").alias("source"), "column_name", F.explode(number_unit_pairs(F.col("value"))).alias("p"))
    return pairs.select("source", "column_name", F.col("p.number").cast("double").alias("number"))


def sketch_profiles(numbers: DataFrame, k: int = QUANTILE_K) -> DataFrame:
    """One row a source and column: ``(source, column_name, sketch, n, total, min_value, max_value)``."""
    return numbers.groupBy("source", "column_name").agg(
        F.kll_sketch_agg_double("number", F.lit(k)).alias("sketch"),
        F.count("number").alias("n"),
        F.sum("number").alias("total"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
    )


def merge_profiles(profiles: DataFrame, ranks: list[float]) -> DataFrame:
    """``(column_name, n, n_sources, min_value, max_value, mean_value, quantiles)`` from the sketches of any sources.

    ``quantiles`` stand in the order of ``ranks`` (0 to 1); each one's true rank is off by ``rank_error`` at most in 99 of
    100 cases. All other figures are exact.
    """
    merged = profiles.groupBy("column_name").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("n").alias("n"),
        F.count_distinct("source").alias("n_sources"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("total").alias("total"),
    )
    wanted = F.array(*[F.lit(float(r)) for r in ranks])
    return merged.select(
        "column_name",
        "n",
        "n_sources",
        "min_value",
        "max_value",
        (F.col("total") / F.col("n")).alias("mean_value"),
        F.kll_sketch_get_quantile_double("sketch", wanted).alias("quantiles"),
    )


def sketch_sets(held: DataFrame, source: str | None = None, lg_entries: int = THETA_LG) -> DataFrame:
    """One theta sketch of the distinct products of each category (and source) of ``held(category, product_name)``."""
    by = ["category", *([source] if source else [])]
    products = F.col("product_name").cast("string")
    return held.groupBy(*by).agg(F.theta_sketch_agg(products, lg_entries).alias("sketch"))


def merge_sets(sketches: DataFrame, lg_entries: int = THETA_LG) -> DataFrame:
    """``(category, sketch)`` over all sources."""
    return sketches.groupBy("category").agg(F.theta_union_agg("sketch", lg_entries).alias("sketch"))


def sketched_overlap(pairs: DataFrame, sets: DataFrame, lg_entries: int = THETA_LG) -> DataFrame:
    """``(category1, category2, shared, jaccard, shared_low, shared_high)`` of wanted pairs, from sketches alone.

    The shared products are both counts less the count of the union; ``shared_low`` and ``shared_high`` are
    that far off as two standard errors of the union's estimate allow. Sets of fewer products than the sketch has
    entries are counted exactly.
    """
    one = sets.select(F.col("category").alias("category1"), F.col("sketch").alias("s1"))
    two = sets.select(F.col("category").alias("category2"), F.col("sketch").alias("s2"))
    both = pairs.join(one, "category1").join(two, "category2")
    size = lambda c: F.theta_sketch_estimate(c)
    counted = both.select(
        "category1",
        "category2",
        size("s1").alias("n1"),
        size("s2").alias("n2"),
        size(F.theta_union("s1", "s2", lg_entries)).alias("together"),
        size(F.theta_intersection("s1", "s2")).alias("shared"),
    )
    # Counts below the number of entries are exact; beyond, the relative error is one over its root.
    off = F.when(F.col("together") <= 2**lg_entries, 0.0).otherwise(2 * F.col("together") / 2 ** (lg_entries / 2))
    return counted.select(
        "category1",
        "category2",
        "shared",
        (F.col("shared") / F.col("together")).alias("jaccard"),
        F.greatest(F.col("n1") + F.col("n2") - F.col("together") - off, F.lit(0.0)).alias("shared_low"),
        (F.col("n1") + F.col("n2") - F.col("together") + off).alias("shared_high"),
    )
