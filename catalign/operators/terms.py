"""A fitted embedding of names: hashed character n-grams weighted by how few names have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS, SIZE = 256, 3


def gram_buckets(text: Column, dims: int = DIMS, size: int = SIZE) -> Column:
    """The bucket of each character n-gram of the lower-case, padded text, repeats included."""
    padded = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1)))
    code = lambda i: F.conv(F.substring(F.md5(F.substring(padded, i, F.lit(size)).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.transform(starts, lambda i: F.pmod(code(i), F.lit(dims)).cast("int"))


def fit_idf(texts: DataFrame, dims: int = DIMS, size: int = SIZE) -> DataFrame:
    """``(bucket, n_texts, idf, dims, size)``: at most ``dims`` rows, idf = ln((N + 1) / (n_texts + 1)).

    ``texts(text)`` are names, one row each; null ones count as none. This table is the model: it can be written, read
    and applied to names it has not seen.
    """
    names = texts.filter("text is not null")
    total = names.count()
    counts = names.select(F.explode(F.array_distinct(gram_buckets(F.col("text"), dims, size))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n_texts"))
    return counts.select(
        "bucket",
        "n_texts",
        F.log(F.lit(total + 1) / (F.col("n_texts") + 1)).alias("idf"),
        F.lit(dims).alias("dims"),
        F.lit(size).alias("size"),
    )


def save_idf(model: DataFrame, path: str) -> str:
    model.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_idf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def embed_idf(texts: DataFrame, model: DataFrame) -> DataFrame:
    """``(text, embedding)``: counts of n-grams times their weights, scaled to length 1; for ``vectors.dbscan`` and others.

    An n-gram that the model has not seen is weighted like one that a single name had. A null text has a null
    embedding; one whose n-grams all weigh nothing has zeros. The model is a constant of the plan: it has at most ``dims`` rows.
    """
    rows = model.collect()  # at most one row a bucket
    dims, size = (rows[0]["dims"], rows[0]["size"]) if rows else (DIMS, SIZE)
    rare = max((r["idf"] for r in rows), default=0.0)
    known = {r["bucket"]: r["idf"] for r in rows}
    weights = F.array(*[F.lit(float(known.get(b, rare))) for b in range(dims)])
    counted = texts.select("text", F.explode_outer(gram_buckets(F.col("text"), dims, size)).alias("bucket")).groupBy("text", "bucket").agg(F.count("*").alias("tf"))
    weighed = counted.withColumn("w", F.col("tf") * F.get(weights, F.col("bucket")))
    per_text = weighed.groupBy("text").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "w")))).alias("w"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    scaled = lambda b: F.coalesce(F.try_element_at(F.col("w"), b) / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), scaled)
    return per_text.select("text", F.when(F.col("text").isNotNull(), vector).alias("embedding"))
