"""The three jobs in sequence: categories, attribute columns, values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalign.constants import EPS_FLAT, LOW_CONFIDENCE, MIN_SAMPLES_FLAT
from catalign.operators import groups as G
from catalign.operators import params as P
from catalign.operators import profile as N
from catalign.operators import standardize as V
from catalign.operators import units as U
from catalign.operators.schema import attribute_columns, distinct_categories, measurable_columns
from catalign.operators.vectors import cluster_flat, embed_ngrams, hierarchical_clusters
from catalign.runtime import stage, stages_of_job


@dataclass
class Harmonized:
    working: DataFrame
    final: DataFrame
    assignments: DataFrame


def harmonize_categories(
    catalog: DataFrame,
    strategy: str | None = None,
    embed=embed_ngrams,
    eps: float = EPS_FLAT,
    min_samples: int = MIN_SAMPLES_FLAT,
    only_cross_source: bool = True,
    assignments: DataFrame | None = None,
    round_no: int = 1,
) -> Harmonized:
    """One automatic round. ``strategy`` picks a hierarchical clustering, none the flat one."""
    if assignments is None:
        assignments = G.no_assignments(catalog.sparkSession)
    pool = stage(G.unfixed_pool(distinct_categories(catalog), assignments), "pool")
    if strategy is None:
        clusters = cluster_flat(pool, embed, eps, min_samples)
    else:
        clusters = hierarchical_clusters(pool, strategy=strategy, embed=embed)
    clusters = stage(clusters, "clusters")
    assignments = stage(assignments.unionByName(G.auto_assignments(clusters, round_no)), "assignments")
    renames = G.rename_map(clusters, assignments)
    working = G.apply_groups(catalog, renames)
    if only_cross_source:
        working = G.cross_source_filter(working)
    working = stage(working, "working")
    return Harmonized(
        G.working_table(working, assignments), G.final_groups(catalog, working, assignments), assignments
    )


def merge_attributes(table: DataFrame, smart: bool = True, **methods) -> tuple[DataFrame, DataFrame]:
    """Find mergeable attribute columns and add a merged column for each pair."""
    columns = [c for c in attribute_columns(table.columns) if c not in ("row_id", "category", "group_name", "SKU")]
    pairs = stage(P.similar_pairs(table, columns, smart, **methods), "pairs")
    chosen = [(r["col1"], r["col2"]) for r in pairs.collect()]
    return P.merge_all(table, chosen), pairs


def harmonize_attributes(table: DataFrame, pairs: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """One column for each attribute: the columns that accepted pairs connect, coalesced in table order."""
    known = {c for r in pairs.select("col1", "col2").collect() for c in (r["col1"], r["col2"])}
    columns = [c for c in table.columns if c in known]
    members = P.attribute_components(table.sparkSession, columns, pairs)
    rest = [c for c in table.columns if c not in known]
    return P.harmonize_attributes(table, members, rest if ids is None else ids)


def standardize_catalog(table: DataFrame, mode: str = "simple") -> tuple[DataFrame, DataFrame]:
    """Standardize every numeric column whose unit is known well enough."""
    columns = [c for c in measurable_columns(table.columns) if c != "row_id"]
    numeric = [r["column_name"] for r in N.numeric_columns(N.numeric_profile(table, columns)).collect()]
    if not numeric:
        return table, N.numeric_profile(table, columns).select("column_name").limit(0)
    measured = stage(U.measurement_types(table, numeric), "measured")
    left_out = {r["column_name"] for r in U.low_confidence(measured, LOW_CONFIDENCE).collect()}
    chosen = [c for c in numeric if c not in left_out]
    if not chosen:
        return table, measured
    units = stage(U.category_units(table, chosen), "units")
    headers = stage(V.header_units(chosen, units, measured), "headers")
    return V.rename_headers(V.standardize_columns(table, chosen, units, mode=mode), headers), headers


def run(spark: SparkSession, paths: list[str], out: str, **options) -> dict[str, str]:
    """From files to the harmonized, merged and standardized tables under ``out``.

    ``files`` tells for each file how many rows were kept and dropped; null drops: it could not be read.
    """
    from catalign.sources.files import load_catalog, write_stage

    with stages_of_job(spark):
        loaded = load_catalog(spark, paths)
        catalog = write_stage(loaded.catalog, f"{out}/catalog")
        unread = spark.createDataFrame([(p,) for p in loaded.failed], "file string")
        zero = F.lit(0).cast("bigint")
        write_stage(loaded.counts.unionByName(unread.select("file", zero.alias("kept"), F.lit(None).cast("bigint").alias("dropped"))), f"{out}/files")
        result = harmonize_categories(catalog, **options)
        final = write_stage(result.final, f"{out}/harmonized")
        write_stage(result.assignments, f"{out}/assignments")
        merged, pairs = merge_attributes(final)
        merged = write_stage(merged, f"{out}/merged")
        write_stage(harmonize_attributes(final, pairs), f"{out}/attributes")
        write_stage(standardize_catalog(merged)[0], f"{out}/standardized")
    return {name: f"{out}/{name}" for name in ("files", "catalog", "harmonized", "assignments", "merged", "attributes", "standardized")}
