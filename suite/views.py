"""The product catalogue derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG_SELECT = """
SELECT p_partkey AS row_id,
       'src' || CAST(p_partkey % 4 AS STRING) AS source_file,
       p_name AS product_name,
       p_brand || '/' || p_type AS category,
       'SKU-' || CAST(p_partkey AS STRING) AS sku,
       CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS STRING) END AS weight_kg,
       CASE WHEN p_partkey % 4 >= 2 THEN CAST(p_size AS STRING) || ' kg' END AS weight,
       CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size * 10 AS STRING) || 'x' || CAST(p_size * 20 AS STRING) || 'x' || CAST(p_size * 5 AS STRING)
            WHEN p_partkey % 4 = 1 THEN CAST(p_size * 10 AS STRING) || ' mm' END AS dimensions,
       CASE p_partkey % 5 WHEN 0 THEN CAST(p_size * 100 AS STRING) || 'W'
                          WHEN 1 THEN CAST(p_size AS STRING) || ' kW'
                          WHEN 2 THEN CAST(p_size * 100 AS STRING) END AS power,
       CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand,
       CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 7 = 0 THEN 'N/A' END AS manufacturer,
       CASE WHEN p_partkey % 6 = 0 THEN p_type ELSE p_brand END AS vendor
FROM part
"""

LINES_OF_ORDER = 1_000_000
# Every line of ``lineitem``, in SQL.
LINE_ROWS = """SELECT l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS row_id,
  l_partkey AS part_id FROM lineitem"""

ATTRIBUTES = ["weight_kg", "weight", "dimensions", "power", "brand", "manufacturer", "vendor"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOG_SELECT.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def product_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue row per order line: the large table for row-level jobs.

    Lines are numbered inside their order; lines of one order, number and part are alike.
    """
    part = catalog(spark, sf_dir).withColumnRenamed("row_id", "part_id")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    line_id = F.col("l_orderkey") * LINES_OF_ORDER + F.row_number().over(order)
    lines = table(spark, sf_dir, "lineitem").select(line_id.alias("row_id"), F.col("l_partkey").alias("part_id"))
    return lines.join(part, "part_id").select("row_id", *part.columns[1:])


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


CATALOG_CTE = f"catalog AS ({CATALOG_SELECT})"
NA_LIST = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)
