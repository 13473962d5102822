"""Rewrite values as number and unit, and put the unit in the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalign.functions import measures as M
from catalign.operators.profile import column_samples
from catalign.operators.schema import quoted
from catalign.operators.units import category_units, role_column, role_value
from catalign.runtime import lookup, with_parsed

WRITERS = {"simple": M.standardize_simple, "best": M.standardize_best}
PARSERS = {"simple": M.parse_simple, "best": M.parse_best}


def unit_maps(units: DataFrame) -> DataFrame:
    """One row per category with its units by column (at most one per column)."""
    return units.groupBy("category").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "unit"))).alias("_units")
    )


def _fallback(df: DataFrame, column: str, category: Column | None) -> Column:
    product, description = role_value(df, "product"), role_value(df, "description")
    return F.coalesce(
        F.try_element_at(F.col("_units"), F.lit(column)),
        M.rule_unit(column, product, category, description),
        M.context_unit(column, product, category, description),
    )


def standardize_columns(
    df: DataFrame,
    columns: list[str],
    units: DataFrame | None = None,
    category: str | None = "group_name",
    mode: str = "simple",
    fmt: str = "number_unit",
    order: str = "row_id",
) -> DataFrame:
    """Standardize columns in place: one lookup of the category's units, one select.

    ``units`` is the table of :func:`category_units` (computed if not given).
    Rows without a category keep their values.
    """
    if category is None or category not in df.columns:
        category = role_column(df, "category")
    if units is None:
        units = category_units(df, columns, category, order=order)
    maps = unit_maps(units)
    if category is None:
        joined = lookup(df.withColumn("_category", F.lit("default")), maps.withColumnRenamed("category", "_category"), "_category")
        text = None
    else:
        joined = lookup(
            df.withColumn("_category", quoted(category).cast("string")),
            maps.withColumnRenamed("category", "_category"),
            "_category",
        )
        text = F.col("_category")
    parsed = {c: f"_parsed{i}" for i, c in enumerate(columns)}
    joined = with_parsed(joined, parsed, lambda v: PARSERS[mode](v, fmt))
    values = {}
    for c in columns:
        new = M.written(F.col(parsed[c]), quoted(c).cast("string"), _fallback(df, c, text), fmt, blank=mode == "best")
        values[c] = F.when(F.col("_category").isNotNull(), new).otherwise(quoted(c).cast("string"))
    return joined.select(*[values[c].alias(c) if c in values else quoted(c) for c in df.columns])


def header_name(column: str, unit: str | None) -> str:
    return f"{column} ({unit})" if unit and f"({unit})" not in column else column


def header_units(columns: list[str], units: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """New header per column: the top measured unit, else the first category's."""
    spark = units.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "column_name string")
    first = units.groupBy("column_name").agg(F.min_by("unit", "category").alias("category_unit"))
    joined = names.join(first, "column_name", "left")
    if measured is None:
        joined = joined.withColumn("top_unit", F.lit(None).cast("string"))
    else:
        tops = measured.select("column_name", F.get("common_units", F.lit(0)).alias("top_unit"))
        joined = joined.join(tops, "column_name", "left")
    unit = F.coalesce("top_unit", "category_unit")
    bracket = F.concat(F.lit("("), unit, F.lit(")"))
    return joined.select(
        "column_name",
        unit.alias("unit"),
        F.when(unit.isNotNull() & ~F.col("column_name").contains(bracket), F.concat_ws(" ", "column_name", bracket))
        .otherwise(F.col("column_name"))
        .alias("new_name"),
    )


def rename_headers(df: DataFrame, headers: DataFrame) -> DataFrame:
    """Swap columns for their new names in one select (the mapping is schema-sized)."""
    names = {r["column_name"]: r["new_name"] for r in headers.collect()}
    return df.select(*[quoted(c).alias(names.get(c, c)) for c in df.columns])


def standardize_preview(
    df: DataFrame,
    columns: list[str],
    units: DataFrame,
    category: str = "group_name",
    mode: str = "simple",
    order: str = "row_id",
) -> DataFrame:
    """First non-blank value of each column before and after."""
    product, description = role_column(df, "product"), role_column(df, "description")
    keep = [c for c in dict.fromkeys([category, product, description]) if c]
    samples = column_samples(df, columns, 10, order, keep).filter(F.trim("value") != "")
    chosen = samples.withColumn("_n", F.row_number().over(Window.partitionBy("column_name").orderBy("rn"))).filter("_n = 1")
    joined = chosen.join(
        units.withColumnRenamed("category", "_category"),
        (F.col("_category") == F.col(category)) & (units["column_name"] == chosen["column_name"]),
        "left",
    ).drop(units["column_name"])
    name, text = F.col("column_name"), F.col(category)
    item, about = role_value(joined, "product"), role_value(joined, "description")
    fallback = F.coalesce(
        "unit", M.rule_unit(name, item, text, about), M.context_unit(name, item, text, about)
    )
    after = WRITERS[mode](F.col("value"), fallback)
    rows = joined.select("column_name", F.col("value").alias("before"), after.alias("after"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(rows, "column_name", "left").select(
        "column_name",
        "before",
        "after",
        F.when(F.col("before").isNull(), "no data")
        .when(F.col("before") != F.col("after"), "changed")
        .otherwise("unchanged")
        .alias("state"),
    )


def preview_counts(preview: DataFrame) -> DataFrame:
    return preview.agg(
        F.count_if(F.col("state") == "changed").alias("changed"),
        F.count_if(F.col("state") == "unchanged").alias("unchanged"),
        F.count_if(F.col("state") == "no data").alias("no_data"),
    )


def replacement_report(
    before: DataFrame, after: DataFrame, headers: DataFrame, columns: list[str], n: int = 3, order: str = "row_id"
) -> DataFrame:
    """Old and new header with the first values of each side by side."""
    old = column_samples(before, columns, n, order).select("column_name", "rn", F.col("value").alias("original"))
    new = column_samples(after, columns, n, order).select("column_name", "rn", F.col("value").alias("standardized"))
    return headers.select("column_name", "new_name").join(old.join(new, ["column_name", "rn"]), "column_name")


def convert_units(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """Amounts in base units, long form: ``ids…, column_name, value, amount, base_unit, dimension``."""
    from catalign.operators.schema import unpivot_values

    return (
        with_parsed(unpivot_values(df, columns, ids), {"value": "_converted"}, M.converted)
        .filter("_converted IS NOT NULL")
        .select(*ids, "column_name", "value", "_converted.amount", "_converted.base_unit", "_converted.dimension")
    )
