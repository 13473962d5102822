"""CSV files of several dialects, written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalign.runtime import checkpoint_root
from catalign.sources.files import PLACE, Dialect, bad_rows, load_catalog, read_csv, recode, write_csv
from suite.views import CATALOG_CTE, catalog, cte, table

Q, SQL = {}, {}


def _folder(spark):
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex[:16]}"


def csv_semicolon(spark, d):
    path = _folder(spark)
    catalog(spark, d).write.option("header", True).option("sep", ";").csv(path)
    return read_csv(spark, path).drop(*PLACE).withColumn("row_id", F.col("row_id").cast("bigint"))


Q["csv_semicolon"] = csv_semicolon
SQL["csv_semicolon"] = cte(CATALOG_CTE) + "SELECT * FROM catalog"


def csv_cyrillic(spark, d):
    """A file in a single-byte Cyrillic encoding."""
    path = _folder(spark)
    part = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("код"),
        F.concat(F.lit("деталь "), "p_name").alias("product"),
        F.when(F.col("p_partkey") % 3 == 0, "N/A").otherwise(F.col("p_type")).alias("cat"),
    )
    as_bytes = lambda c: recode(c, "cp1251", back=True)
    head = spark.range(1).select(as_bytes(F.lit("код;product;cat")).alias("value"))
    lines = part.select(as_bytes(F.concat_ws(";", *part.columns)).alias("value"))
    head.unionByName(lines).coalesce(1).select(F.encode("value", "ISO-8859-1").cast("string").alias("value")).write.text(path)
    return read_csv(spark, path).drop(*PLACE)


Q["csv_cyrillic"] = csv_cyrillic
SQL["csv_cyrillic"] = """
SELECT CAST(p_partkey AS VARCHAR) AS "код", 'деталь ' || p_name AS product,
  CASE WHEN p_partkey % 3 = 0 THEN 'N/A' ELSE p_type END AS cat FROM part"""


def csv_long_and_short_rows(spark, d):
    """Rows with a field too many are dropped, rows with one too few are filled."""
    path = _folder(spark)
    key = F.col("p_partkey")
    part = table(spark, d, "part")
    line = F.concat_ws(
        ",",
        key.cast("string"),
        F.concat(F.lit('"'), "p_name", F.lit(' 55"", new"')),
        F.when(key % 4 != 0, F.col("p_type")),
        F.when(key % 5 == 0, F.lit("extra,field")).otherwise(F.when(key % 4 != 0, F.col("p_brand"))),
    )
    head = spark.range(1).select(F.lit(" Part No ,' Product Name ',Category,Brand").alias("value"))
    body = part.select(line.alias("value"))
    head.unionByName(body).coalesce(1).write.text(path)
    return read_csv(spark, path).drop(*PLACE)


Q["csv_long_and_short_rows"] = csv_long_and_short_rows
SQL["csv_long_and_short_rows"] = """
SELECT CAST(p_partkey AS VARCHAR) AS "Part No", p_name || ' 55", new' AS " Product Name ",
  CASE WHEN p_partkey % 4 <> 0 THEN p_type WHEN p_partkey % 5 = 0 THEN 'extra' END AS "Category",
  CASE WHEN p_partkey % 4 <> 0 THEN p_brand WHEN p_partkey % 5 = 0 THEN 'field' END AS "Brand"
FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 4 <> 0)"""


def csv_multi_line_text(spark, d):
    """Free text with quotes, separators and line breaks inside quoted fields."""
    path = _folder(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("text"))
    write_csv(docs, path)
    back = read_csv(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.md5(F.trim("text").cast("binary")).alias("text_md5"))


Q["csv_multi_line_text"] = csv_multi_line_text
SQL["csv_multi_line_text"] = "SELECT doc_id, lang, md5(trim(text)) AS text_md5 FROM documents"


def csv_parallel_quotes(spark, d):
    """One file of free text whose quoted fields span lines, read in many ranges."""
    path = _folder(spark)
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit('"'), "lang", F.lit('";\n'), "text").alias("note"))
    docs.coalesce(1).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    back = read_csv(spark, path, split_bytes=1 << 18)
    digest = lambda c: F.md5(F.trim(c).cast("binary")).alias(f"{c}_md5")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest("text"), digest("note"))


Q["csv_parallel_quotes"] = csv_parallel_quotes
SQL["csv_parallel_quotes"] = """
SELECT doc_id, md5(trim(text)) AS text_md5, md5(trim('"' || lang || '";' || chr(10) || text)) AS note_md5 FROM documents"""


def load_two_files(spark, d):
    """Two files with their own headers as one catalogue."""
    first, second = _folder(spark), _folder(spark)
    df = catalog(spark, d)
    left = df.filter("row_id % 2 = 0").orderBy("row_id").selectExpr(
        "product_name AS `Product Name`", "category AS Category", "manufacturer", "power"
    )
    right = df.filter("row_id % 2 = 1").orderBy("row_id").selectExpr("product_name AS Product", "category AS cat", "sku AS SKU")
    left.coalesce(1).write.option("header", True).csv(first)
    right.coalesce(1).write.option("header", True).option("sep", ";").csv(second)
    return load_catalog(spark, [first, second]).catalog.drop("source_file")


Q["load_two_files"] = load_two_files
SQL["load_two_files"] = cte(CATALOG_CTE) + """
SELECT CAST(row_number() OVER (ORDER BY row_id % 2, row_id) - 1 AS BIGINT) AS row_id, product_name, category,
  CASE WHEN row_id % 2 = 0 THEN nullif(manufacturer, 'N/A') END AS manufacturer,
  CASE WHEN row_id % 2 = 0 THEN power END AS power,
  CASE WHEN row_id % 2 = 0 THEN product_name ELSE sku END AS "SKU", category AS group_name FROM catalog"""


def _broken(spark, d):
    """A file in which every third row has surplus fields, some of them empty, and a raw inch mark elsewhere."""
    path = _folder(spark)
    part = table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, ",,7").when(F.col("p_partkey") % 5 == 0, ",extra").otherwise("")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(','), "p_name", F.lit(' 55",'), "p_type", tail)
    head = spark.range(1).select(F.lit("id,name,kind").alias("value"))
    head.unionByName(part.select(line.alias("value"))).coalesce(1).write.text(path)
    return path


Q["csv_bad_rows"] = lambda spark, d: bad_rows(spark, _broken(spark, d)).select("kept", "dropped")
SQL["csv_bad_rows"] = """
SELECT count(*) FILTER (p_partkey % 3 <> 0 AND p_partkey % 5 <> 0) AS kept,
       count(*) FILTER (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AS dropped FROM part"""

Q["csv_surplus_after_empty"] = lambda spark, d: read_csv(spark, _broken(spark, d)).drop(*PLACE)
SQL["csv_surplus_after_empty"] = """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' 55"' AS name, p_type AS kind
FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0"""


def csv_unquoted(spark, d):
    """Quote marks are text where the dialect has none."""
    path = _folder(spark)
    part = table(spark, d, "part")
    line = F.concat(F.lit('"'), "p_name", F.lit(';"'), "p_type", F.lit(";"), F.col("p_partkey").cast("string"))
    head = spark.range(1).select(F.lit("name;kind;id").alias("value"))
    head.unionByName(part.select(line.alias("value"))).coalesce(1).write.text(path)
    return read_csv(spark, path, Dialect("utf-8", ";", False, False, ("name", "kind", "id"))).drop(*PLACE)


Q["csv_unquoted"] = csv_unquoted
SQL["csv_unquoted"] = """
SELECT '"' || p_name AS name, '"' || p_type AS kind, CAST(p_partkey AS VARCHAR) AS id FROM part"""


def load_folder(spark, d):
    """A folder of several files of different sizes: rows are numbered by file name, then line."""
    path = _folder(spark)
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("SKU"), F.col("p_name").alias("Product Name"))
    key = F.col("SKU").cast("int")
    for i, rows in enumerate((part.filter(key % 10 == 0), part.filter(key % 10 > 3), part.filter((key % 10 > 0) & (key % 10 < 4)))):
        rows.orderBy(F.col("SKU").cast("int")).coalesce(1).write.option("header", True).csv(f"{path}/{i}")
    return load_catalog(spark, [f"{path}/*"]).catalog.select("row_id", "SKU", "product_name")


Q["load_folder"] = load_folder
SQL["load_folder"] = """
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 10 > 3 THEN 1 ELSE 2 END, p_partkey) - 1
  AS BIGINT) AS row_id, CAST(p_partkey AS VARCHAR) AS "SKU", p_name AS product_name FROM part"""
