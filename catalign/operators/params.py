"""Attribute columns that mean the same thing: statistics, matching, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalign.constants import (
    CONFIRM_COLUMNS,
    CONFLICT_LIMIT,
    MAX_COLUMNS,
    TOKEN_SORT_THRESHOLD,
)
from catalign.operators.linkage import score_pairs
from catalign.operators.schema import quoted
from catalign.runtime import stage

METHOD_ORDER = ["token_sort", "embedding", "jaro_winkler"]


def check_width(columns: list[str], confirmed: bool = True) -> None:
    """Pair search is refused above 1,000 columns and asks first above 30."""
    if len(columns) > MAX_COLUMNS:
        raise ValueError(f"{len(columns)} columns; pair search takes at most {MAX_COLUMNS}")
    if len(columns) > CONFIRM_COLUMNS and not confirmed:
        raise ValueError(f"{len(columns)} columns give {len(columns) * (len(columns) - 1) // 2} pairs; confirm first")


def column_pairs(spark: SparkSession, columns: list[str]) -> DataFrame:
    """Every pair of columns in table order (schema metadata, at most 1,000 names)."""
    check_width(columns)
    names = F.array(*[F.lit(c) for c in columns])
    return (
        spark.range(len(columns))
        .select(F.col("id").cast("int").alias("i"))
        .select("i", F.get(names, F.col("i")).alias("col1"), F.posexplode(names))
        .filter("pos > i")
        .select("col1", F.col("col").alias("col2"))
    )


def _per_source(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Filled cells per source and column, and the row count, from one scan."""
    counts = stage(
        df.groupBy("source_file").agg(
            F.count(F.lit(1)).alias("n_rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)]
        ),
        "per_source",
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])
    long = counts.select("source_file", F.inline(F.filter(cells, lambda x: x["n"] > 0)))
    return long, counts.agg(F.sum("n_rows")).first()[0] or 0


def fill_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null values per column."""
    counts = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(columns)]
    return counts.select(F.inline(F.array(*cells)))


def pair_counts(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows with both columns filled, and those whose values differ.

    Every row lists the pairs of its own filled columns, or the wanted ones among
    them; the counts are pre-aggregated in each task, so a shuffle carries one row
    per pair and task and the table is never joined with itself. Pairs that are
    never filled together do not appear.
    """
    check_width(columns)
    text = [quoted(c).cast("string") for c in columns]
    if pairs is None:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(text)])
        filled = F.filter(cells, lambda x: x["v"].isNotNull())
        in_row = F.flatten(
            F.transform(
                F.col("row"),
                lambda x, k: F.transform(
                    F.slice(F.col("row"), k + 2, F.size("row")),
                    lambda y: F.struct((x["i"] * MAX_COLUMNS + y["i"]).alias("pair"), (x["v"] != y["v"]).alias("differ")),
                ),
            )
        )
    else:
        at = {c: i for i, c in enumerate(columns)}
        wanted = [F.lit(at[a] * MAX_COLUMNS + at[b]) for a, b in pairs]
        filled = F.array(*text)
        of = lambda i: F.get(F.col("row"), i.cast("int"))
        asked = F.filter(
            F.array(*wanted) if wanted else F.array().cast("array<int>"),
            lambda p: of(F.floor(p / MAX_COLUMNS)).isNotNull() & of(p % MAX_COLUMNS).isNotNull(),
        )
        in_row = F.transform(
            asked,
            lambda p: F.struct(p.alias("pair"), (of(F.floor(p / MAX_COLUMNS)) != of(p % MAX_COLUMNS)).alias("differ")),
        )
    names = F.array(*[F.lit(c) for c in columns])
    return (
        df.select(filled.alias("row"))
        .select(F.inline(in_row))
        .groupBy("pair")
        .agg(F.count(F.lit(1)).alias("overlap"), F.count_if("differ").alias("conflicts"))
        .select(
            F.get(names, F.floor(F.col("pair") / MAX_COLUMNS).cast("int")).alias("col1"),
            F.get(names, F.col("pair") % MAX_COLUMNS).alias("col2"),
            "overlap",
            "conflicts",
        )
    )


def compatibility(
    df: DataFrame, columns: list[str], pairs: list[tuple[str, str]] | None = None, smart: bool = True
) -> DataFrame:
    """May two columns be merged? One row per pair.

    Yes if their sources differ (the sets of sources that fill them are not the
    same) or at most 10 % of the rows filled in both hold different values.
    ``smart=False`` accepts every pair without looking at the data.
    """
    spark = df.sparkSession
    every = column_pairs(spark, columns) if pairs is None else spark.createDataFrame(pairs, "col1 string, col2 string")
    if not smart:
        blank = df.agg(F.count(F.lit(1)).alias("total_rows"))
        flags = {"compatible": True, "sources_different": False, "non_conflicting": True}
        counted = every.select(
            "col1", "col2", *[F.lit(0).cast("bigint").alias(c) for c in ("conflicts", "overlap")],
            *[F.lit(v).alias(k) for k, v in flags.items()], F.lit("").alias("reason"),
        )
        return counted.withColumn("total_rows", F.lit(blank.first()[0]).cast("bigint"))
    used = columns if pairs is None else sorted({c for p in pairs for c in p})
    sources, total = _per_source(df, used)
    totals = sources.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("filled")
    )
    # Sources filling both columns: from pair to the (few) sources of its first
    # column, then a keyed check that the second column has the source too.
    first = sources.select(F.col("column_name").alias("col1"), "source_file")
    second = sources.select(F.col("column_name").alias("col2"), "source_file")
    common = (
        every.join(first, "col1").join(second, ["col2", "source_file"]).groupBy("col1", "col2").agg(
            F.count(F.lit(1)).alias("common")
        )
    )
    side = lambda n: totals.select(
        F.col("column_name").alias(f"col{n}"), F.col("n_sources").alias(f"s{n}"), F.col("filled").alias(f"filled{n}")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    joined = (
        every.join(side(1), "col1", "left")
        .join(side(2), "col2", "left")
        .join(common, ["col1", "col2"], "left")
        .join(pair_counts(df, used, pairs), ["col1", "col2"], "left")
        .select("col1", "col2", *[zero(c) for c in ("s1", "s2", "filled1", "filled2", "common", "overlap", "conflicts")])
    )
    differ = (F.col("s1") > 0) & (F.col("s2") > 0) & (F.col("common") < F.greatest("s1", "s2"))
    clash = F.col("conflicts") / F.greatest(F.col("overlap"), F.lit(1)) > CONFLICT_LIMIT
    return joined.select(
        "col1",
        "col2",
        "filled1",
        "filled2",
        "overlap",
        "conflicts",
        differ.alias("sources_different"),
        (~clash).alias("non_conflicting"),
        (differ | ~clash).alias("compatible"),
        F.when(differ | ~clash, F.when(clash, F.lit("many conflicts")).otherwise(F.lit("")))
        .otherwise(F.lit("same sources and conflicting values"))
        .alias("reason"),
        F.lit(total).cast("bigint").alias("total_rows"),
    )


def conflict_pct(pairs: DataFrame) -> DataFrame:
    share = F.col("conflicts") / F.greatest(F.col("overlap"), F.lit(1)) * 100
    return pairs.withColumn("conflict_pct", F.round(share, 1))


def name_scores(
    spark: SparkSession,
    columns: list[str],
    token_sort: float | None = TOKEN_SORT_THRESHOLD,
    embedding: float | None = None,
    jaro_winkler: float | None = None,
    embed=None,
) -> DataFrame:
    """Similar column names by each active method: ``col1, col2, score, method``.

    ``embed`` maps a frame ``(text)`` to ``(text, embedding)``.
    """
    check_width(columns)
    names = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "text string, pos int")
    found = []
    # At most half a million pairs of names, so each is compared: one job without blocking keys.
    every = column_pairs(spark, columns)

    def direct(method: str, threshold: float, text) -> DataFrame:
        pairs = every.select("col1", "col2", text(F.col("col1")).alias("text1"), text(F.col("col2")).alias("text2"))
        return score_pairs(pairs, method, threshold).select(
            F.col("col1").alias("text1"), F.col("col2").alias("text2"), "score", F.lit(method).alias("method")
        )

    if token_sort is not None:
        found.append(direct("token_sort", token_sort, _sorted_name))
    if embedding is not None:
        from catalign.operators.vectors import cosine_pairs

        vectors = embed(names.select("text"))
        # The slack keeps a similarity that is a whole percent from falling below it by rounding.
        reach = 1 - embedding / 100.0 + 1e-9
        pairs = cosine_pairs(vectors.select(F.col("text").alias("id"), "embedding"), reach, collapse=False)
        found.append(
            pairs.select(
                F.col("id1").alias("text1"), F.col("id2").alias("text2"),
                F.floor((1 - F.col("distance")) * 100 + 1e-7).cast("double").alias("score"), F.lit("embedding").alias("method"),
            ).filter(F.col("score") >= embedding)
        )
    if jaro_winkler is not None:
        found.append(direct("jaro_winkler", jaro_winkler, lambda name: name))
    if not found:
        raise ValueError("no matching method is active")
    scored = reduce(DataFrame.unionByName, found)
    at = lambda n: names.select(F.col("text").alias(f"text{n}"), F.col("pos").alias(f"p{n}"))
    forward = F.col("p1") < F.col("p2")
    return (
        scored.join(at(1), "text1").join(at(2), "text2")
        .select(
            F.when(forward, F.col("text1")).otherwise(F.col("text2")).alias("col1"),
            F.when(forward, F.col("text2")).otherwise(F.col("text1")).alias("col2"),
            "score",
            "method",
        )
        .distinct()
    )


def _sorted_name(name: Column) -> Column:
    from catalign.functions.strings import token_sort_text

    return token_sort_text(name)


def first_method(scored: DataFrame) -> DataFrame:
    """A pair found by several methods keeps its score from the first of them."""
    rank = F.array_position(F.array(*[F.lit(m) for m in METHOD_ORDER]), F.col("method"))
    ranked = scored.withColumn(
        "_n", F.row_number().over(Window.partitionBy("col1", "col2").orderBy(rank, F.desc("score")))
    )
    return ranked.filter("_n = 1").drop("_n")


def similar_pairs(df: DataFrame, columns: list[str], smart: bool = True, **methods) -> DataFrame:
    """The report of mergeable columns, best score first.

    Names are scored first (they are schema metadata), so the table is scanned
    once and only for the pairs whose names are similar.
    """
    scored = stage(first_method(name_scores(df.sparkSession, columns, **methods)), "scored")
    pairs = [(r["col1"], r["col2"]) for r in scored.select("col1", "col2").distinct().collect()]
    if not pairs:
        return scored.limit(0)
    facts = compatibility(df, columns, pairs, smart).filter("compatible")
    if not smart:
        filled = stage(fill_counts(df, sorted({c for p in pairs for c in p})), "filled")
        for n in (1, 2):
            facts = facts.join(
                filled.select(F.col("column_name").alias(f"col{n}"), F.col("filled").alias(f"filled{n}")), f"col{n}"
            )
        facts = facts.drop("overlap").join(
            pair_counts(df, columns, pairs).select("col1", "col2", "overlap"), ["col1", "col2"], "left"
        ).withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return (
        scored.join(facts, ["col1", "col2"])
        .select(
            "col1", "col2", "score", "method", "filled1", "filled2", "overlap", "conflicts", "sources_different",
            (F.col("filled1") + F.col("filled2") - F.col("overlap")).alias("potential"),
        )
        .orderBy(F.desc("score"), "col1", "col2")
    )


def merged_name(a: str, b: str) -> str:
    return f"{a}_{b}_merged"


def merge_all(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Add one merged column per pair, skipping names that exist already."""
    new: dict[str, Column] = {}
    for a, b in pairs:
        if merged_name(a, b) not in df.columns:
            new.setdefault(merged_name(a, b), F.coalesce(quoted(a), quoted(b)))
    return df.select("*", *[value.alias(name) for name, value in new.items()])


def merge_pair(
    df: DataFrame, pairs: DataFrame, a: str, b: str, name: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Merge one listed pair under a new name; the pair leaves the list."""
    name = merged_name(a, b) if name is None else name
    if not name or name in df.columns:
        raise ValueError(f"not a usable new column name: {name!r}")
    left = pairs.filter(~((F.col("col1") == a) & (F.col("col2") == b)))
    return df.withColumn(name, F.coalesce(quoted(a), quoted(b))), left


def merge_columns(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """Merge any two columns; the first one wins and an existing name is replaced."""
    return df.withColumn(merged_name(a, b) if name is None else name, F.coalesce(quoted(a), quoted(b)))


def merge_preview(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(
        F.count(quoted(a)).alias("filled1"),
        F.count(quoted(b)).alias("filled2"),
        F.count(F.coalesce(quoted(a), quoted(b))).alias("filled_merged"),
    )


def merge_preview_rows(
    df: DataFrame, a: str, b: str, order: str = "row_id", n: int = 10, n_conflicts: int = 5
) -> DataFrame:
    """The first rows of the table with both columns and the merged value, and the first conflicts."""
    rows = df.select(
        order, quoted(a).cast("string").alias("value1"), quoted(b).cast("string").alias("value2"),
        F.coalesce(quoted(a).cast("string"), quoted(b).cast("string")).alias("merged"),
    )
    first = rows.orderBy(order).limit(n).withColumn("part", F.lit("rows"))
    clash = rows.filter("value1 <> value2").orderBy(order).limit(n_conflicts).withColumn("part", F.lit("conflicts"))
    return first.unionByName(clash)


def conflicts(df: DataFrame, a: str, b: str, ids: list[str]) -> DataFrame:
    """Rows where both columns are filled and differ, with the value a merge would keep."""
    return df.filter(quoted(a).cast("string") != quoted(b).cast("string")).select(
        *ids, quoted(a).alias("value1"), quoted(b).alias("value2"), F.coalesce(quoted(a), quoted(b)).alias("merged")
    )


def attribute_components(spark: SparkSession, columns: list[str], pairs: DataFrame) -> DataFrame:
    """Columns connected by accepted pairs, named by the first of them in the table."""
    from catalign.operators.components import connected_components

    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "id bigint, column_name string")
    ends = pairs.select("col1", "col2").join(
        names.select(F.col("column_name").alias("col1"), F.col("id").alias("src")), "col1"
    ).join(names.select(F.col("column_name").alias("col2"), F.col("id").alias("dst")), "col2")
    found = connected_components(names.select("id"), ends.select("src", "dst"))
    first = names.select(F.col("id").alias("component"), F.col("column_name").alias("attribute"))
    return found.join(names, "id").join(first, "component").select(
        "column_name", "attribute", F.col("id").cast("int").alias("position")
    )


def harmonize_attributes(df: DataFrame, members: DataFrame, ids: list[str]) -> DataFrame:
    """One column per attribute: its members coalesced in table order, in one select."""
    rows = members.orderBy("position").collect()
    groups: dict[str, list[str]] = {}
    for row in rows:
        groups.setdefault(row["attribute"], []).append(row["column_name"])
    return df.select(
        *ids, *[F.coalesce(*[quoted(c) for c in cols]).alias(name) for name, cols in groups.items()]
    )
