"""Units of columns and of categories within a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalign.constants import (
    CATEGORY_SAMPLE,
    CONFIDENCE_THRESHOLD,
    CONTEXT_CONFIDENCE,
    LOW_CONFIDENCE,
    MEASURE_SAMPLE,
    NUMBER,
    PATTERN_CONFIDENCE,
    QUANTITY_CONFIDENCE,
    UNIT_CLASS,
)
from catalign.functions.measures import (
    all_extractions,
    confidence_of,
    context_unit,
    find_unit,
    pattern_pairs,
    quantity_pairs,
    rule_unit,
    validate_unit,
)
from catalign.operators.profile import column_samples
from catalign.operators.schema import unpivot_values
from catalign.runtime import lookup, stage

ROLE_NAMES = {
    "product": ["product_name", "name"],
    "description": ["description"],
    "category": ["group_name", "Category", "category"],
}


def role_column(df: DataFrame, role: str) -> str | None:
    """Column for a role, whatever the case of its header."""
    by_name: dict[str, str] = {}
    for c in df.columns:
        by_name.setdefault(c.lower(), c)
    return next((by_name[n.lower()] for n in ROLE_NAMES[role] if n.lower() in by_name), None)


def role_value(df: DataFrame, role: str) -> Column:
    name = role_column(df, role)
    return F.lit(None).cast("string") if name is None else F.col(f"`{name}`")


def extraction_rows(df: DataFrame, value: str, ids: list[str], quantities: bool = True, patterns: bool = True) -> DataFrame:
    """One row per extraction of a text column.

    Unit texts are looked up once each: the distinct ones meet the dictionary, and the result is joined back.
    """
    if not quantities and not patterns:
        raise ValueError("no extractor is active")
    tagged = lambda pairs, method: F.transform(
        pairs, lambda p: F.struct(F.lit(method).alias("kind"), p["number"].alias("number"), p["raw"].alias("raw"))
    )
    text = F.col(value)
    parts = [tagged(quantity_pairs(text), "quantity")] * quantities + [tagged(pattern_pairs(text), "pattern")] * patterns
    found = df.filter(text.rlike("[0-9]")).select(*ids, F.posexplode(F.concat(*parts))).select(*ids, "pos", "col.*")
    found = stage(found, "extractions")
    known = found.select("raw").distinct().withColumn("v", validate_unit(F.col("raw"))).filter("v IS NOT NULL")
    rows = lookup(found, known.select("raw", "v.canonical", "v.dimension", "v.how"), "raw")
    quantity = F.col("kind") == "quantity"
    return rows.select(
        *ids,
        "pos",
        "number",
        F.col("raw").alias("raw_unit"),
        F.coalesce("canonical", "raw").alias("unit"),
        F.coalesce("dimension", F.when(quantity, "").otherwise("unknown")).alias("dimension"),
        F.when(quantity, confidence_of("how", QUANTITY_CONFIDENCE))
        .otherwise(confidence_of("how", PATTERN_CONFIDENCE))
        .cast("double")
        .alias("confidence"),
        F.when(F.col("how").isNotNull(), F.concat("kind", F.lit("_known"))).otherwise(F.col("kind")).alias("method"),
        F.col("how").isNotNull().alias("is_valid"),
    )


def unit_tokens(df: DataFrame, value: str) -> DataFrame:
    """Distinct unit texts of a column with how the dictionary knows them.

    Texts are made distinct first (pre-aggregated), so the containment check
    runs once per text and not once per row.
    """
    found = F.explode(F.regexp_extract_all(F.lower(value), F.lit(rf"{NUMBER}\s*({UNIT_CLASS}+)"), 1))
    tokens = (
        df.select(found.alias("found"))
        .groupBy(F.trim("found").alias("unit"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("unit <> ''")
    )
    valid = tokens.withColumn("v", validate_unit(F.col("unit")))
    return valid.select("unit", "n_rows", "v.canonical", "v.dimension", F.coalesce("v.how", F.lit("none")).alias("how"))


def measurement_types(df: DataFrame, columns: list[str], n: int = MEASURE_SAMPLE, order: str = "row_id") -> DataFrame:
    """Dimension and units of each column, from its name first and its values second.

    A valid unit in the name wins with 0.95 if over half of the sample holds a
    number. Otherwise extractions vote: one point for their dimension, two more
    when the unit is in the dictionary; the name's unit starts with a point per value.
    """
    samples = stage(column_samples(df, columns, n, order), "samples")
    name = F.col("column_name")
    base = samples.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.trim("value").rlike(NUMBER)).alias("n_numeric"),
        F.array_sort(F.collect_list(F.when(F.col("rn") <= 10, F.struct("rn", "value")))).alias("s"),
    )
    base = base.select(
        "column_name",
        "n_values",
        "n_numeric",
        F.transform("s", lambda x: x["value"]).alias("sample_values"),
        context_unit(name).alias("context_unit"),
    ).withColumn("v", F.when(F.col("context_unit").isNotNull(), validate_unit(F.col("context_unit"))))
    base = stage(
        base.withColumn("by_name", F.col("v").isNotNull() & (F.col("n_numeric") / F.col("n_values") > 0.5)), "named"
    )
    found = (
        samples.select("column_name", order, F.posexplode(all_extractions(F.col("value"))))
        .select("column_name", order, "pos", "col.*")
        .filter(F.col("confidence") >= CONFIDENCE_THRESHOLD)
    )
    at = F.struct(F.col(order).cast("bigint").alias("o"), F.col("pos").alias("p"))
    votes = found.select(
        "column_name",
        at.alias("seen"),
        F.explode(
            F.array(
                F.struct(
                    F.lit("dimension").alias("kind"),
                    F.when(F.col("dimension") != "unknown", F.col("dimension")).alias("key"),
                    F.when(F.col("is_valid"), 3).otherwise(1).alias("points"),
                ),
                F.struct(F.lit("unit").alias("kind"), F.col("unit").alias("key"), F.lit(1).alias("points")),
            )
        ).alias("vote"),
    ).select("column_name", "seen", "vote.*")
    first = F.struct(F.lit(-(2**62)).cast("bigint").alias("o"), F.lit(0).alias("p"))
    seeds = base.filter("v IS NOT NULL").select(
        "column_name",
        first.alias("seen"),
        F.explode(
            F.array(
                F.struct(F.lit("dimension").alias("kind"), F.col("v.dimension").alias("key"), F.col("n_values").cast("int").alias("points")),
                F.struct(F.lit("unit").alias("kind"), F.col("v.canonical").alias("key"), F.col("n_values").cast("int").alias("points")),
            )
        ).alias("vote"),
    ).select("column_name", "seen", "vote.*")
    voted = votes.join(base.filter("NOT by_name").select("column_name"), "column_name", "left_semi")
    tally = (
        voted.unionByName(seeds)
        .filter(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("column_name", "kind", "key")
        .agg(F.sum("points").alias("points"), F.min("seen").alias("seen"))
    )
    rank = F.row_number().over(Window.partitionBy("column_name", "kind").orderBy(F.desc("points"), "seen", "key"))
    ranked = tally.withColumn("rank", rank)
    listed = lambda kind, k=None: F.array_sort(
        F.collect_list(
            F.when(
                (F.col("kind") == kind) & (F.col("rank") <= k if k else F.lit(True)),
                F.struct("rank", "key", "points"),
            )
        )
    )
    summary = ranked.groupBy("column_name").agg(
        listed("dimension").alias("dims"), listed("unit").alias("all_units"), listed("unit", 3).alias("top_units")
    )
    as_map = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["key"], x["points"])))
    empty = F.create_map().cast("map<string,bigint>")
    return base.join(summary, "column_name", "left").select(
        "column_name",
        F.coalesce(F.get("dims", F.lit(0))["key"], F.lit("unknown")).alias("primary_dimension"),
        F.when(F.col("by_name"), F.lit(CONTEXT_CONFIDENCE))
        .otherwise(F.coalesce(F.get("dims", F.lit(0))["points"] / F.col("n_values"), F.lit(0.0)))
        .alias("confidence"),
        F.coalesce(F.transform("top_units", lambda x: x["key"]), F.array().cast("array<string>")).alias("common_units"),
        F.when(F.col("by_name"), "context").otherwise("mixed").alias("method"),
        "context_unit",
        "sample_values",
        F.coalesce(as_map("dims"), empty).alias("dimensions_found"),
        F.coalesce(as_map("all_units"), empty).alias("units_found"),
    )


def success_rate(measured: DataFrame) -> DataFrame:
    hit = F.when(F.col("confidence") > 0, 1.0).otherwise(0.0)
    return measured.agg(
        F.count_if(F.col("confidence") > 0).alias("successful"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.round(F.avg(hit) * 100, 1), F.lit(0.0)).alias("success_pct"),
    )


def low_confidence(measured: DataFrame, limit: float = LOW_CONFIDENCE) -> DataFrame:
    return measured.filter(F.col("confidence") < limit).select("column_name", "confidence")


def measurement_report(measured: DataFrame) -> DataFrame:
    return measured.select(
        "column_name",
        F.col("primary_dimension").alias("dimension"),
        F.format_string("%.2f", "confidence").alias("confidence"),
        F.array_join(F.slice("common_units", 1, 5), ", ").alias("units"),
        F.array_join(F.slice("sample_values", 1, 3), ", ").alias("samples"),
        "method",
        F.coalesce("context_unit", F.lit("none")).alias("context_unit"),
    )


def measurement_counts(measured: DataFrame) -> DataFrame:
    """The votes behind each result, one row per dimension and unit."""
    tag = lambda kind, c: measured.select("column_name", F.lit(kind).alias("kind"), F.explode(c).alias("key", "points"))
    return tag("dimension", "dimensions_found").unionByName(tag("unit", "units_found"))


def category_units(
    df: DataFrame,
    columns: list[str],
    category: str | None = "group_name",
    sample: int = CATEGORY_SAMPLE,
    order: str = "row_id",
) -> DataFrame:
    """Unit of each column in each category: ``category, column_name, unit``.

    Majority of the product rules over the first rows of the category, else the
    first valid unit among its first values, else the column's context. Ranking
    the first few rows per category is a group limit that runs before the
    shuffle, so a huge category sends a few rows per task. Without a category
    column the result has the single category ``default``.
    """
    if category is None or category not in df.columns:
        category = role_column(df, "category")
    group = F.lit("default") if category is None else F.col(f"`{category}`").cast("string")
    product, description = role_value(df, "product"), role_value(df, "description")
    heads = df.select(
        order, group.alias("category"), product.alias("product"), description.alias("description")
    ).filter("category IS NOT NULL")
    limit = 1 if category is None else sample
    first = F.row_number().over(Window.partitionBy("category").orderBy(order))
    heads = stage(heads.withColumn("rn", first).filter(F.col("rn") <= limit), "heads")
    context = None if category is None else F.col("category")
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
    rows = heads.select("*", names).withColumn(
        "rule", rule_unit(F.col("column_name"), F.col("product"), context, F.col("description"))
    )
    votes = (
        rows.filter("rule IS NOT NULL")
        .groupBy("category", "column_name", "rule")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("seen"))
        .groupBy("category", "column_name")
        .agg(F.min_by("rule", F.struct(-F.col("n"), F.col("seen"))).alias("by_rule"))
    )
    last = rows.filter("rn = 1").select(
        "category",
        "column_name",
        context_unit(F.col("column_name"), F.col("product"), context, F.col("description")).alias("by_context"),
    )
    found = stage(last.join(votes, ["category", "column_name"], "left"), "by_rule")
    # Values are only looked at for columns that some category has no rule for.
    unruled = [] if category is None else [
        r["column_name"] for r in found.filter("by_rule IS NULL").select("column_name").distinct().collect()
    ]
    if not unruled:
        return found.select("category", "column_name", F.coalesce("by_rule", "by_context").alias("unit")).filter(
            "unit IS NOT NULL"
        )
    cells = unpivot_values(df.withColumn("_group", group).filter("_group IS NOT NULL"), unruled, ["_group", order])
    nth = F.row_number().over(Window.partitionBy("_group", "column_name").orderBy(order))
    text = F.trim(F.regexp_extract(F.trim("value"), rf"{NUMBER}\s*({UNIT_CLASS}+)", 1))
    values = (
        cells.withColumn("rn", nth)
        .filter(F.col("rn") <= sample)
        .withColumn("unit", text)
        .filter((F.col("unit") != "") & (F.length("unit") < 10) & find_unit(F.col("unit")).isNotNull())
        .groupBy(F.col("_group").alias("category"), "column_name")
        .agg(F.min_by("unit", "rn").alias("by_value"))
    )
    return (
        found.join(values, ["category", "column_name"], "left")
        .select("category", "column_name", F.coalesce("by_rule", "by_value", "by_context").alias("unit"))
        .filter("unit IS NOT NULL")
    )
