"""Categories that hold the same products, and scores combined over methods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalign.operators.components import connected_components
from catalign.runtime import global_rank, stage

# Products are ordered by how many categories hold them, in doubling classes
# that a hash cuts further, so that a category's rarest products are found by
# counting per class instead of sorting a whole category in one task.
HASH_CLASSES = 64
# Holders of one product in one array, and pairs of holders that one task counts.
BLOCK_HOLDERS = 1024
TASK_PAIRS = 4_000_000


def _memberships(df: DataFrame, category: str, product: str) -> DataFrame:
    return (
        df.filter(F.col(category).isNotNull() & F.col(product).isNotNull())
        .select(F.col(category).cast("string").alias("category"), F.col(product).cast("string").alias("product"))
        .distinct()
    )


def product_overlap(
    df: DataFrame, threshold: float, category: str = "category", product: str = "product_name", every_copy: bool = False
) -> DataFrame:
    """Pairs of categories whose product sets reach a Jaccard similarity.

    Categories with exactly the same set are represented by the smallest name;
    the others are reported as a pair with it (score 1). With ``every_copy`` nothing is represented:
    all pairs of equal sets and all pairs that their copies make are rows. Among distinct sets the
    search is exact: sets of sizes ``a <= b`` with Jaccard ``t`` share at least
    ``s = t / (1 + t) * (a + b)`` products. Each set is searched by its rarest
    products; it leaves out fewer than ``t`` times its size. A pair shares at least ``s`` less
    what the one that leaves out more leaves out of these, and only pairs that do are compared on
    whole sets. A product found everywhere is no key unless the sets hold little else.
    """
    members = stage(_memberships(df, category, product), "members")
    signature = members.groupBy("category").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("product").cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64("product", F.lit(1)).cast("decimal(38,0)")).alias("h2"),
    )
    same = ["size", "h1", "h2"]
    signature = stage(signature, "signatures")
    heads = stage(signature.groupBy(*same).agg(F.min("category").alias("head")), "heads")
    copies = signature.join(heads, same).filter("category <> head").select(
        F.col("head").alias("category1"), F.col("category").alias("category2"), F.col("size").alias("shared"), F.lit(1.0).alias("jaccard")
    )
    # A set is one long: its size, then its number.
    numbered = global_rank(heads.select(F.col("head").alias("category"), "size"), [F.col("category")], "number")
    numbered = stage(numbered.select("category", F.shiftleft("size", 32).bitwiseOR(F.col("number")).alias("set")), "numbered")
    sets = stage(members.join(numbered, "category").select("set", "product"), "sets")
    candidates = stage(_candidates(sets, threshold), "candidates")
    common = (
        candidates.join(sets.withColumnRenamed("set", "set1"), "set1")
        .join(sets.withColumnRenamed("set", "set2"), ["set2", "product"])
        .groupBy("set1", "set2")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    score = F.col("shared") / (_size("set1") + _size("set2") - F.col("shared"))
    found = common.withColumn("jaccard", score).filter(F.col("jaccard") >= threshold)
    if every_copy:
        copied = signature.join(heads, same).select("category", "head")
        copied = copied.join(numbered.select(F.col("category").alias("head"), "set"), "head").select("category", "set")
        return _with_copies(found.select("set1", "set2", "shared", "jaccard"), copied)
    for n in (1, 2):
        found = found.join(numbered.select(F.col("set").alias(f"set{n}"), F.col("category").alias(f"name{n}")), f"set{n}")
    return found.select(
        F.least("name1", "name2").alias("category1"), F.greatest("name1", "name2").alias("category2"), "shared", "jaccard"
    ).unionByName(copies)


def _with_copies(found: DataFrame, copied: DataFrame) -> DataFrame:
    """``(category1, category2, shared, jaccard)``: each pair of ``found`` sets for each two categories that hold them.

    ``copied(category, set)`` names the categories of a set, any two of which are a pair as well. They are sent as
    arrays of BLOCK_HOLDERS at most by estimate, and pairs are written where two arrays meet.
    """
    held = copied.groupBy("set").agg(F.count(F.lit(1)).alias("held_by"))
    block = F.pmod(F.xxhash64("category"), F.ceil(F.col("held_by") / BLOCK_HOLDERS))
    packs = copied.join(held, "set").groupBy("set", "held_by", block.alias("block"))
    packs = stage(packs.agg(F.collect_list("category").alias("names")), "packs")
    side = lambda n: packs.select(F.col("set").alias(f"set{n}"), F.col("block").alias(f"block{n}"), F.col("names").alias(f"names{n}"))
    own = packs.filter("held_by > 1").select("set", "block", "names")
    own = own.join(side(2).withColumnRenamed("set2", "set"), "set").filter("block <= block2")
    once = (F.col("block") == F.col("block2")).alias("once")
    equal = own.select("names", "names2", once, _size("set").alias("shared"), F.lit(1.0).alias("jaccard"))
    crossed = found.join(side(1), "set1").join(side(2), "set2").select(
        F.col("names1").alias("names"), "names2", F.lit(False).alias("once"), "shared", "jaccard"
    )
    met = stage(crossed.unionByName(equal), "met")
    pairs = met.agg(F.sum(F.size("names").cast("double") * F.size("names2"))).first()[0]
    tasks = max(int(copied.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((pairs or 0) / TASK_PAIRS))
    written = met.repartition(tasks).select(F.explode("names").alias("name1"), "names2", "once", "shared", "jaccard")
    written = written.select("name1", F.explode("names2").alias("name2"), "once", "shared", "jaccard").filter("not once or name1 < name2")
    return written.select(
        F.least("name1", "name2").alias("category1"), F.greatest("name1", "name2").alias("category2"), "shared", "jaccard"
    )


def _size(of: str) -> Column:
    return F.shiftright(of, 32)


def _left_out(of: str, threshold: float) -> Column:
    """How many of a set's most frequent products are no keys: fewer than it shares with any match."""
    least = F.ceil(_size(of) * threshold - 1e-9)
    return F.least(least - 1, F.floor(least - F.least(least, _size(of) - least) / 2))


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """``(set1, set2)`` that share enough of their rarest products, the smaller set first.

    A pair of sets is never a row of a shuffle: each set is sent the sets after it that hold the same product, as
    an array, and pairs are counted where it arrives.
    """
    held = sets.groupBy("product").agg(F.count(F.lit(1)).alias("held_by"))
    rank = F.floor(F.log2("held_by")).cast("int") * HASH_CLASSES + F.pmod(F.xxhash64("product", F.lit(2)), F.lit(HASH_CLASSES)).cast("int")
    ranked = stage(held.select("product", "held_by", rank.alias("rank")), "ranked")
    classed = stage(sets.join(ranked, "product"), "classed")
    # Products before each class, per set: at most a few thousand classes each.
    per_class = classed.groupBy("set", "rank").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("set").orderBy("rank")) - F.col("n")
    last = per_class.withColumn("before", before).filter(F.col("before") < _size("set") - _left_out("set", threshold)).groupBy("set").agg(F.max("rank").alias("last"))
    prefix = classed.join(stage(last, "last_classes"), "set").filter("rank <= last")
    # The holders of a product that many hold are cut into blocks, and each block meets each.
    block = F.pmod(F.xxhash64("set"), F.ceil(F.col("held_by") / BLOCK_HOLDERS))
    holders = stage(prefix.groupBy("product", "held_by", block.alias("block")).agg(F.sort_array(F.collect_list("set")).alias("holders")), "holders")
    other = holders.select("product", F.col("block").alias("block2"), F.col("holders").alias("holders2"))
    pairs = holders.agg(F.sum(F.col("held_by").cast("double") * F.size("holders") / 2)).first()[0]
    later = F.when(F.col("block") == F.col("block2"), F.slice("holders2", F.col("at") + 2, F.size("holders2"))).otherwise(
        F.filter("holders2", lambda x: x > F.col("set1"))
    )
    met = (
        holders.join(other, "product")
        .select("block", "block2", "holders2", F.posexplode("holders").alias("at", "set1"))
        .select("set1", later.alias("partners"))
        .filter(F.size("partners") > 0)
    )
    spark = sets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((pairs or 0) / TASK_PAIRS))
    counted = (
        met.repartition(tasks, "set1")
        .select("set1", F.explode("partners").alias("set2"))
        .filter(_size("set1") >= _size("set2") * threshold - 1e-9)
        .groupBy("set1", "set2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shared = F.ceil((_size("set1") + _size("set2")) * (threshold / (1 + threshold)) - 1e-9)
    return counted.filter(F.col("n") >= shared - F.greatest(_left_out("set1", threshold), _left_out("set2", threshold))).select("set1", "set2")


def hybrid_pairs(
    names: DataFrame, products: DataFrame, name_weight: float = 0.5, threshold: float = 0.5
) -> DataFrame:
    """Weighted mean of a name score (0 to 100) and a product overlap (0 to 1).

    A pair missing from one side counts as 0 there.
    """
    left = names.select(
        F.least("text1", "text2").alias("category1"), F.greatest("text1", "text2").alias("category2"), "score"
    )
    joined = left.join(products.select("category1", "category2", "jaccard"), ["category1", "category2"], "full_outer")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (
        joined.select(
            "category1",
            "category2",
            part("score").alias("name_score"),
            part("jaccard").alias("jaccard"),
            (part("score") / 100 * name_weight + part("jaccard") * (1 - name_weight)).alias("hybrid"),
        )
        .filter(F.col("hybrid") >= threshold)
    )


def pair_clusters(categories: DataFrame, pairs: DataFrame) -> DataFrame:
    """Categories connected by accepted pairs; the first to appear names the group."""
    at = lambda n: categories.select(F.col("category").alias(f"category{n}"), F.col("first_row_id").alias(f"r{n}"))
    edges = pairs.join(at(1), "category1").join(at(2), "category2").select(F.col("r1").alias("src"), F.col("r2").alias("dst"))
    found = connected_components(categories.select(F.col("first_row_id").alias("id")), edges)
    return categories.join(found, categories["first_row_id"] == found["id"]).select(
        F.col("category").alias("original_category"), "first_row_id", F.col("component").alias("cluster")
    )
