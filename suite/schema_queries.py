"""Sources, schema unification, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalign.operators import schema as S
from suite.views import ATTRIBUTES, CATALOG_CTE, LINE_ROWS, NA_LIST, catalog, cte, product_lines, table

Q, SQL = {}, {}


def _source_tables(spark, sf_dir):
    """The four sources with the headers and columns each of them would use."""
    df = catalog(spark, sf_dir)
    part = lambda i: df.filter(F.col("source_file") == f"src{i}")
    return [
        part(0).selectExpr(
            "row_id", "source_file", "product_name AS `Product Name`", "category AS Category", "sku AS SKU",
            "weight_kg AS `Weight (kg)`", "dimensions AS Dimensions",
        ),
        part(1).selectExpr(
            "row_id", "source_file", "product_name AS ` product `", "category AS cat", "sku AS id",
            "weight_kg AS `Weight (kg)`", "power AS Power",
        ),
        part(2).selectExpr(
            "row_id", "source_file", "product_name AS Name", "category AS CATEGORY", "weight AS Weight", "power AS Power"
        ),
        part(3).selectExpr(
            "row_id", "source_file", "product_name", "category", "sku AS Sku", "weight AS Weight", "vendor AS Vendor"
        ),
    ]


def union_by_name(spark, sf_dir):
    tables = [S.unify_schema(t) for t in _source_tables(spark, sf_dir)]
    df = S.with_initial_group(S.stack(tables))
    return df.withColumnsRenamed({"Weight (kg)": "weight_in_kg", "Weight": "weight_text"})


Q["union_by_name"] = union_by_name
SQL["union_by_name"] = cte(CATALOG_CTE) + """
SELECT row_id, source_file, product_name, category,
       CASE WHEN source_file = 'src2' THEN product_name ELSE sku END AS "SKU",
       CASE WHEN source_file IN ('src0', 'src1') THEN weight_kg END AS weight_in_kg,
       CASE WHEN source_file = 'src0' THEN dimensions END AS "Dimensions",
       CASE WHEN source_file IN ('src1', 'src2') THEN power END AS "Power",
       CASE WHEN source_file IN ('src2', 'src3') THEN weight END AS weight_text,
       CASE WHEN source_file = 'src3' THEN vendor END AS "Vendor",
       category AS group_name
FROM catalog"""

Q["na_normalize"] = lambda spark, d: S.normalize_na(catalog(spark, d)).select("row_id", *ATTRIBUTES)
SQL["na_normalize"] = cte(CATALOG_CTE) + "SELECT row_id, " + ", ".join(
    f"CASE WHEN trim({c}) NOT IN ({NA_LIST}) THEN {c} END AS {c}" for c in ATTRIBUTES
) + " FROM catalog"

Q["default_key"] = lambda spark, d: S.default_key(
    catalog(spark, d).drop("sku").select("row_id", "product_name", "category")
)
SQL["default_key"] = cte(CATALOG_CTE) + 'SELECT row_id, product_name, category, product_name AS "SKU" FROM catalog'

Q["initial_group"] = lambda spark, d: S.with_initial_group(product_lines(spark, d).select("row_id", "category"))
SQL["initial_group"] = cte(CATALOG_CTE) + """
SELECT l.row_id, c.category, c.category AS group_name
FROM (""" + LINE_ROWS + ") l JOIN catalog c ON c.row_id = l.part_id"


def provenance(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    named = part.select(
        "p_partkey", F.col("p_name").alias("product_name"), "p_brand", F.col("_metadata.file_name").alias("_file")
    )
    return S.with_provenance(named, F.col("_file")).drop("_file")


Q["provenance"] = provenance
SQL["provenance"] = (
    "SELECT p_partkey, p_name AS product_name, 'part.parquet' AS source_file, p_brand FROM part"
)


def attribute_selection(spark, sf_dir):
    df = catalog(spark, sf_dir).withColumnRenamed("weight_kg", "width")
    params, measures = S.attribute_columns(df.columns), S.measurable_columns(df.columns)
    return df.select("row_id", *[F.col(c).alias(f"param_{c}") for c in params], *measures)


Q["attribute_selection"] = attribute_selection
SQL["attribute_selection"] = cte(CATALOG_CTE) + """
SELECT row_id, category AS param_category, sku AS param_sku, weight AS param_weight, dimensions AS param_dimensions,
       power AS param_power, brand AS param_brand, manufacturer AS param_manufacturer, vendor AS param_vendor,
       weight, dimensions, power, brand, manufacturer, vendor FROM catalog"""


def _fixed(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.concat_ws("/", "p_brand", "p_type").alias("group_name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n % 2 = 0")
    )


def fixed_unfixed_split(spark, sf_dir):
    df = S.with_initial_group(product_lines(spark, sf_dir).select("row_id", "category"))
    fixed, unfixed = S.split_fixed(df, _fixed(spark, sf_dir))
    tag = lambda part, name: part.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "category", "n_rows", F.lit(name).alias("pool")
    )
    return tag(fixed, "fixed").unionByName(tag(unfixed, "unfixed"))


Q["fixed_unfixed_split"] = fixed_unfixed_split
SQL["fixed_unfixed_split"] = cte(
    CATALOG_CTE,
    "sizes AS (SELECT category, count(*) AS n FROM catalog GROUP BY 1)",
    f"lines AS ({LINE_ROWS})",
) + """
SELECT c.category, count(*) AS n_rows, CASE WHEN any_value(s.n) % 2 = 0 THEN 'fixed' ELSE 'unfixed' END AS pool
FROM lines l JOIN catalog c ON c.row_id = l.part_id JOIN sizes s ON s.category = c.category GROUP BY c.category"""

Q["distinct_categories"] = lambda spark, d: S.distinct_categories(product_lines(spark, d))
SQL["distinct_categories"] = cte(CATALOG_CTE) + """
SELECT c.category, min(l.row_id) AS first_row_id FROM (""" + LINE_ROWS + ") l JOIN catalog c ON c.row_id = l.part_id GROUP BY 1"

Q["narrow_projection"] = lambda spark, d: S.narrow(
    S.drop_service_columns(
        S.with_initial_group(catalog(spark, d)).withColumnRenamed("sku", "SKU").withColumn("group_name_x", F.lit("x"))
    )
)
SQL["narrow_projection"] = cte(CATALOG_CTE) + """
SELECT category AS group_name, category, product_name, sku AS "SKU", source_file FROM catalog"""

Q["filled_pairs"] = lambda spark, d: catalog(spark, d).filter(
    F.col("brand").isNotNull() & F.col("manufacturer").isNotNull()
).select("row_id", "brand", "manufacturer")
SQL["filled_pairs"] = cte(CATALOG_CTE) + """
SELECT row_id, brand, manufacturer FROM catalog WHERE brand IS NOT NULL AND manufacturer IS NOT NULL"""

Q["conditional_update"] = lambda spark, d: S.with_initial_group(catalog(spark, d)).select(
    "row_id",
    F.when(F.col("group_name").isin("Brand#1/PROMO", "Brand#2/PROMO"), "promo set")
    .otherwise(F.col("group_name"))
    .alias("group_name"),
)
SQL["conditional_update"] = cte(CATALOG_CTE) + """
SELECT row_id, CASE WHEN category IN ('Brand#1/PROMO', 'Brand#2/PROMO') THEN 'promo set' ELSE category END AS group_name
FROM catalog"""

Q["first_rows_preview"] = lambda spark, d: S.preview(
    product_lines(spark, d).select("row_id", "product_name", "category", "power"), 20
)
SQL["first_rows_preview"] = cte(CATALOG_CTE) + """
SELECT l.row_id, product_name, category, power
FROM (""" + LINE_ROWS + ") l JOIN catalog c ON c.row_id = l.part_id ORDER BY l.row_id LIMIT 20"

Q["filled_cells"] = lambda spark, d: S.unpivot_values(catalog(spark, d), ATTRIBUTES, ["row_id", "source_file"])
SQL["filled_cells"] = cte(CATALOG_CTE) + """
SELECT row_id, source_file, column_name, value FROM
  (UNPIVOT catalog ON weight_kg, weight, dimensions, power, brand, manufacturer, vendor
   INTO NAME column_name VALUE value)"""

Q["table_summary"] = lambda spark, d: S.table_summary(
    product_lines(spark, d).withColumn("brand_vendor_merged", F.coalesce("brand", "vendor"))
)
SQL["table_summary"] = """
SELECT count(*) AS n_rows, CAST(13 AS BIGINT) AS n_columns, CAST(1 AS BIGINT) AS n_merged
FROM lineitem"""
