"""Bring tables with different headers into one catalogue schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalign.constants import NA_TOKENS, PARAM_EXCLUDED, ROLE_SYNONYMS, STANDARD_EXCLUDED

NARROW_COLUMNS = ["group_name", "category", "product_name", "SKU", "source_file"]
SERVICE_COLUMNS = ["original_category", "group_name_x", "group_name_y"]


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters that name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_if_na(value: Column) -> Column:
    return F.when(~F.trim(value).isin(NA_TOKENS), value)


def normalize_na(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn missing-value tokens into nulls in every text column, in one select."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    chosen = text if columns is None else text & set(columns)
    return df.select(*[null_if_na(quoted(c)).alias(c) if c in chosen else quoted(c) for c in df.columns])


def detect_roles(columns: list[str]) -> dict[str, str]:
    """Map role to header: exact match after trim and lower-case, first synonym wins."""
    by_name: dict[str, str] = {}
    for column in columns:
        by_name.setdefault(column.strip().lower(), column)
    found = {}
    for role, synonyms in ROLE_SYNONYMS.items():
        header = next((by_name[s] for s in synonyms if s in by_name), None)
        if header is not None:
            found[role] = header
    return found


def unify_schema(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Rename role columns to their canonical names and fill in a missing SKU."""
    roles = detect_roles(df.columns) if roles is None else roles
    names = {header: role for role, header in roles.items() if header}
    taken = set(names.values())
    df = df.select(
        *[
            quoted(c).alias(names.get(c, c))
            for c in df.columns
            if c in names or c not in taken
        ]
    )
    return default_key(df)


def default_key(df: DataFrame, key: str = "SKU", source: str = "product_name") -> DataFrame:
    if key in df.columns or source not in df.columns:
        return df
    return df.withColumn(key, quoted(source))


def stack(tables: list[DataFrame]) -> DataFrame:
    """Outer union by name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_initial_group(df: DataFrame, category: str = "category") -> DataFrame:
    if "group_name" in df.columns:
        return df
    source = category if category in df.columns else df.columns[0]
    return df.withColumn("group_name", quoted(source))


def with_provenance(df: DataFrame, source: Column) -> DataFrame:
    """Add ``source_file`` right after ``product_name`` (or at the end)."""
    columns = [c for c in df.columns if c != "source_file"]
    at = columns.index("product_name") + 1 if "product_name" in columns else len(columns)
    picked = [quoted(c) for c in columns]
    return df.select(*picked[:at], source.alias("source_file"), *picked[at:])


def attribute_columns(columns: list[str], excluded: list[str] = PARAM_EXCLUDED) -> list[str]:
    """Columns whose lower-case name holds none of the excluded substrings."""
    return [c for c in columns if not any(word in c.lower() for word in excluded)]


def measurable_columns(columns: list[str]) -> list[str]:
    return attribute_columns(columns, STANDARD_EXCLUDED)


def split_fixed(df: DataFrame, fixed: DataFrame, key: str = "group_name") -> tuple[DataFrame, DataFrame]:
    """Rows whose group is fixed, and the rest (rows without a group stay unfixed)."""
    names = fixed.select(F.col("group_name").alias(key)).distinct()
    return df.join(names, key, "left_semi"), df.join(names, key, "left_anti")


def distinct_categories(df: DataFrame, category: str = "category", order: str = "row_id") -> DataFrame:
    """Every category text once, with the row where it first appears.

    Partial aggregation runs before the shuffle, so a category that fills a
    third of the table still sends one row per input partition.
    """
    return (
        df.filter(quoted(category).isNotNull())
        .groupBy(quoted(category).cast("string").alias("category"))
        .agg(F.min(order).alias("first_row_id"))
    )


def narrow(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in NARROW_COLUMNS if c in df.columns])


def drop_service_columns(df: DataFrame) -> DataFrame:
    return df.drop(*SERVICE_COLUMNS)


def preview(df: DataFrame, n: int = 20, order: str = "row_id") -> DataFrame:
    """First rows in catalogue order: a top-n by heap, not a full sort."""
    return df.orderBy(order).limit(n)


def unpivot_values(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """Long form ``(ids…, column_name, value)`` of the filled cells."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("string").alias("v")) for c in columns])
    return (
        df.select(*ids, F.explode(F.filter(cells, lambda x: x["v"].isNotNull())).alias("cell"))
        .select(*ids, F.col("cell.c").alias("column_name"), F.col("cell.v").alias("value"))
    )


def table_summary(df: DataFrame) -> DataFrame:
    merged = sum(1 for c in df.columns if "_merged" in c)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(merged).cast("bigint").alias("n_merged"),
    )
