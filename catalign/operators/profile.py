"""Which columns hold numbers, with which units, and what they look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalign.constants import MEASURE_SAMPLE, NOT_UNITS, NUMBER, NUMERIC_SHARE, PROFILE_SAMPLE, VALUE_PATTERN
from catalign.functions.measures import all_extractions, confident, fixed_text
from catalign.operators.schema import quoted, unpivot_values
from catalign.runtime import stage


def column_samples(
    df: DataFrame, columns: list[str], n: int | None = PROFILE_SAMPLE, order: str = "row_id", keep: list[str] = ()
) -> DataFrame:
    """The first ``n`` filled values of every column, with the column's total.

    Sorting all cells to find a few per column would dominate at scale. So one
    aggregate counts the filled cells in ranges of the row number that double
    in width; from it follow the totals and, per column, the range that holds
    its n-th value. Only cells up to there (about twice ``n``) are ranked.
    ``n=None`` keeps every value, unranked.
    """
    band = F.floor(F.log2(F.greatest(F.col(order), F.lit(0)) + F.lit(1))).cast("int")
    counts = df.groupBy(band.alias("band")).agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])
    bands = counts.select("band", F.inline(cells))
    so_far = F.sum("n").over(Window.partitionBy("column_name").orderBy("band"))
    reached = bands.withColumn("so_far", so_far).groupBy("column_name").agg(
        F.sum("n").alias("total_values"),
        F.min(F.when(F.col("so_far") >= (n or 0), F.col("band"))).alias("last_band") if n else F.lit(None).cast("int").alias("last_band"),
    )
    facts = {r["column_name"]: r for r in reached.collect()}
    total = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(facts[c]["total_values"] if c in facts else 0).cast("bigint"))])
    rows = df
    if n:
        last = {c: facts[c]["last_band"] for c in columns if c in facts}
        if last and all(b is not None for b in last.values()):
            # pushed to the scan: rows behind the last needed one are not read
            rows = rows.filter(F.col(order) < 2 ** (max(last.values()) + 1))
        limited = [
            F.when(band <= last[c], quoted(c)).otherwise(F.lit(None)).alias(c) if last.get(c) is not None else quoted(c)
            for c in columns
        ]
        rows = rows.select(order, *keep, *limited)
    long = unpivot_values(rows, columns, [order, *keep])
    if n:
        place = F.row_number().over(Window.partitionBy("column_name").orderBy(order))
        ranked = long.withColumn("rn", place).filter(F.col("rn") <= n)
    else:
        ranked = long.withColumn("rn", F.lit(None).cast("int"))
    return ranked.withColumn("total_values", F.try_element_at(total, F.col("column_name")))


def number_unit_pairs(value: Column) -> Column:
    """All ``(number, unit)`` matches of a value."""
    text = F.trim(value)
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(VALUE_PATTERN), 1).alias("number"),
        F.transform(F.regexp_extract_all(text, F.lit(VALUE_PATTERN), 2), lambda u: F.trim(u)).alias("unit"),
    )


def is_unit_token(unit: Column) -> Column:
    return (
        (unit != "")
        & (F.length(unit) < 15)
        & ~F.lower(unit).isin(NOT_UNITS)
        & unit.rlike("[a-zA-Zа-яё]")
    )


def extracted_pairs(samples: DataFrame, order: str = "row_id", keep: list[str] = ()) -> DataFrame:
    """One row per number found: ``column_name, order, keep…, pos, number, unit`` (unit null if not one)."""
    pairs = samples.select("column_name", order, *keep, F.posexplode(number_unit_pairs(F.col("value"))))
    return pairs.select(
        "column_name",
        order,
        *keep,
        "pos",
        F.col("col.number").alias("number"),
        F.when(is_unit_token(F.col("col.unit")), F.col("col.unit")).alias("unit"),
    )


def top_units(pairs: DataFrame, k: int = 5, order: str = "row_id", times: str | None = None) -> DataFrame:
    """Most frequent units per column; ties go to the one seen first. ``times`` tells how often a pair counts."""
    counted = (
        pairs.filter(F.col("unit").isNotNull())
        .groupBy("column_name", "unit")
        .agg(F.sum(F.lit(1) if times is None else F.col(times)).alias("n"), F.min(F.struct(order, "pos")).alias("seen"))
    )
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "seen"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k).select("column_name", "unit", "n", "rank")


def numeric_profile(
    df: DataFrame, columns: list[str], n: int | None = PROFILE_SAMPLE, order: str = "row_id"
) -> DataFrame:
    """One row per column with any value: totals, share with digits, units, numbers.

    Texts that repeat are taken apart once each and counted as often as they stand; the first numbers come from the
    first rows that hold one.
    """
    samples = stage(column_samples(df, columns, n, order), "samples")
    has_digit = F.trim("value").rlike(NUMBER)
    grouped = samples.groupBy("column_name", "value")
    texts = stage(
        grouped.agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first_row"), F.max("total_values").alias("total_values")),
        "texts",
    )
    base = texts.groupBy("column_name").agg(
        F.max("total_values").alias("total_values"),
        F.sum("times").alias("analyzed_values"),
        F.sum(F.when(has_digit, F.col("times")).otherwise(0)).alias("numeric_count"),
    )
    pairs = extracted_pairs(texts, "first_row", ["times"])
    number = F.col("number").cast("double")
    total, count = F.sum(number * F.col("times")), F.sum(F.when(number.isNotNull(), F.col("times")))
    means = pairs.groupBy("column_name").agg((total / count).alias("mean_value"))
    in_column = Window.partitionBy("column_name")
    leading = samples.filter(has_digit).withColumn("k", F.row_number().over(in_column.orderBy(order))).filter(F.col("k") <= 10)
    firsts = (
        extracted_pairs(leading.drop("k"), order)
        .withColumn("k", F.row_number().over(in_column.orderBy(order, "pos")))
        .filter(F.col("k") <= 10)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list(F.struct("k", "number"))).alias("first"))
        .select("column_name", F.transform("first", lambda x: x["number"]).alias("first_numbers"))
    )
    numbers = means.join(firsts, "column_name")
    units = (
        top_units(pairs, 5, "first_row", "times")
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "unit", "n"))).alias("units"))
    )
    share = F.col("numeric_count") / F.col("analyzed_values") * 100
    return (
        base.join(numbers, "column_name", "left")
        .join(units, "column_name", "left")
        .select(
            "column_name",
            "total_values",
            "analyzed_values",
            "numeric_count",
            F.round(share, 4).alias("numeric_percentage"),
            (share > NUMERIC_SHARE).alias("has_numeric"),
            F.round(F.coalesce("mean_value", F.lit(0.0)), 4).alias("avg_value"),
            F.coalesce("mean_value", F.lit(0.0)).alias("mean_value"),
            F.coalesce("first_numbers", F.array().cast("array<string>")).alias("first_numbers"),
            F.coalesce(
                F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), u["n"].alias("n"))),
                F.array().cast("array<struct<unit:string,n:bigint>>"),
            ).alias("units_found"),
        )
    )


def numeric_columns(profile: DataFrame) -> DataFrame:
    return profile.filter("has_numeric")


def profile_report(profile: DataFrame) -> DataFrame:
    """The profile as text for reading."""
    return profile.select(
        "column_name",
        "total_values",
        "analyzed_values",
        "numeric_count",
        F.concat(fixed_text(F.col("numeric_percentage"), 1), F.lit("%")).alias("numeric_share"),
        F.array_join(F.transform(F.slice("units_found", 1, 3), lambda u: u["unit"]), ", ").alias("units"),
        F.array_join(F.slice("first_numbers", 1, 3), ", ").alias("numbers"),
        F.when(F.col("mean_value") > 0, fixed_text(F.col("mean_value"), 2)).otherwise(F.lit("-")).alias("mean"),
    )


def standardized_name(columns: list[str], name: str) -> str | None:
    """The column itself, or its version whose header carries a unit."""
    if name in columns:
        return name
    return next((c for c in columns if name in c and "(" in c and ")" in c), None)


def value_samples(df: DataFrame, columns: list[str], n: int = 10, order: str = "row_id") -> DataFrame:
    found = {c: standardized_name(df.columns, c) for c in columns}
    present = [v for v in found.values() if v is not None]
    return column_samples(df, present, n, order).select("column_name", "rn", "value")


def extended_profile(df: DataFrame, columns: list[str], n: int = MEASURE_SAMPLE, order: str = "row_id") -> DataFrame:
    """Extraction counts, valid units, top units and dimensions, range of the numbers."""
    samples = stage(column_samples(df, columns, n, order), "samples")
    base = samples.groupBy("column_name").agg(
        F.max("total_values").alias("total_values"), F.count(F.lit(1)).alias("analyzed_values")
    )
    found = stage(
        samples.select("column_name", order, F.posexplode(all_extractions(F.col("value")))).select(
            "column_name", order, "pos", "col.*"
        ),
        "extractions",
    )
    sure = F.col("confidence") >= 0.7
    number = F.when(sure, F.col("number").cast("double"))
    counts = found.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("total_extractions"),
        F.count_if(F.col("method").startswith("quantity")).alias("quantity_extractions"),
        F.count_if(F.col("method").startswith("pattern")).alias("pattern_extractions"),
        F.count_if("is_valid").alias("valid_units"),
        F.count_if(sure).alias("numeric_count"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.round(F.avg(number), 4).alias("mean_value"),
    )

    def top(column: str, k: int, out: str) -> DataFrame:
        ranked = (
            found.filter(sure & (F.col(column) != ""))
            .groupBy("column_name", F.col(column).alias("key"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "pos")).alias("seen"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "seen")))
            .filter(F.col("rank") <= k)
        )
        text = F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "key", "n"))),
            lambda x: F.concat(x["key"], F.lit(":"), x["n"].cast("string")),
        )
        return ranked.groupBy("column_name").agg(F.array_join(text, ", ").alias(out))

    zero = ["total_extractions", "quantity_extractions", "pattern_extractions", "valid_units", "numeric_count"]
    return (
        base.join(counts, "column_name", "left")
        .join(top("unit", 10, "units_found"), "column_name", "left")
        .join(top("dimension", 5, "dimensions_found"), "column_name", "left")
        .na.fill(0, zero)
    )
