"""Embeddings, density clusters and category matching by products."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from catalign.operators import forest as W
from catalign.operators import linkage as L
from catalign.operators import neighbours as H
from catalign.operators import overlap as O
from catalign.operators import params as P
from catalign.operators import rounds as R
from catalign.operators import schema as S
from catalign.operators import sketches as K
from catalign.operators import terms as T
from catalign.operators import vectors as X
from catalign.runtime import checkpoint_root, stage
from suite.category_queries import CATS_CTE, DEEP_CTE, LEVELS_CTE, deep_catalog
from suite.param_queries import BASE as PAIR_BASE
from suite.param_queries import staged_lines
from suite.views import ATTRIBUTES, cte, table

Q, SQL = {}, {}


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


VEC_CTE = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"

Q["cosine_pairs"] = lambda spark, d: X.cosine_pairs(vectors(spark, d), 0.6).select(
    "id1", "id2", F.round("distance", 6).alias("distance")
)
SQL["cosine_pairs"] = cte(VEC_CTE) + """
SELECT a.id AS id1, b.id AS id2, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance
FROM (SELECT e, min(id) AS id FROM v GROUP BY 1) a JOIN (SELECT e, min(id) AS id FROM v GROUP BY 1) b ON a.id < b.id
WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.6"""

Q["cosine_distance"] = lambda spark, d: (
    lambda v: v.join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next")), "id").select(
        "id", F.round(X.cosine_distance(F.col("embedding"), F.col("next")), 6).alias("distance")
    )
)(vectors(spark, d))
SQL["cosine_distance"] = cte(VEC_CTE) + """
SELECT a.id, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON b.id = a.id + 1"""


def dbscan_sql(eps, min_samples, source="v"):
    return f"""near AS (SELECT a.id AS a, b.id AS b FROM {source} a JOIN {source} b
  ON a.id = b.id OR 1 - list_cosine_similarity(a.e, b.e) <= {eps}),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= {min_samples}),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS hop FROM core UNION SELECT reach.id, b FROM reach JOIN links ON a = hop),
comp AS (SELECT id, min(hop) AS component FROM reach GROUP BY 1),
core_labels AS (SELECT id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS INT) AS cluster FROM comp),
labels AS (SELECT * FROM core_labels UNION ALL
  SELECT a, min(cluster) FROM near JOIN core_labels c ON c.id = b WHERE a NOT IN (SELECT id FROM core) GROUP BY 1)"""


Q["dbscan"] = lambda spark, d: X.dbscan(vectors(spark, d), 0.65, 3)
SQL["dbscan"] = "WITH RECURSIVE " + VEC_CTE + ",\n" + dbscan_sql(0.65, 3) + """
SELECT v.id, coalesce(cluster, -1) AS cluster FROM v LEFT JOIN labels USING (id)"""

Q["dbscan_every_vector"] = lambda spark, d: X.dbscan(vectors(spark, d), 0.6, 1)
SQL["dbscan_every_vector"] = "WITH RECURSIVE " + VEC_CTE + ",\n" + dbscan_sql(0.6, 1) + """
SELECT v.id, coalesce(cluster, -1) AS cluster FROM v LEFT JOIN labels USING (id)"""


Q["dbscan_blocked"] = lambda spark, d: X.dbscan(vectors(spark, d), 0.65, 3, block_vectors=40)
SQL["dbscan_blocked"] = SQL["dbscan"]

Q["dbscan_null_vectors"] = lambda spark, d: X.dbscan(
    vectors(spark, d).withColumn("embedding", F.when(F.col("id") % 5 != 0, F.col("embedding"))), 0.65, 3
)
SQL["dbscan_null_vectors"] = "WITH RECURSIVE " + VEC_CTE + ",\nw AS (SELECT * FROM v WHERE id % 5 <> 0),\n" + dbscan_sql(0.65, 3, "w") + """
SELECT v.id, coalesce(cluster, -1) AS cluster FROM v LEFT JOIN labels USING (id)"""


# Nearly all neighbours, by an index with 8 bits and one place of difference


def lsh_recall(spark, d):
    """How many of the exact pairs the index finds, and whether it finds others."""
    v = vectors(spark, d)
    exact = stage(X.cosine_pairs(v, 0.6).select("id1", "id2", "distance"), "exact")
    chance = H.hit_chance(0.6, 8, 1)
    plan = H.Plan(8, 1, math.ceil(math.log(0.05) / math.log(1 - chance)))
    found = stage(H.lsh_pairs(v, 0.6, plan=plan), "found").withColumn("found", F.lit(1))
    both = exact.withColumnRenamed("distance", "d").join(found, ["id1", "id2"], "full")
    return both.agg(
        F.count("d").alias("n_exact"),
        F.count_if(F.col("d").isNull() | (F.abs(F.col("d") - F.col("distance")) > 1e-9)).alias("n_wrong"),
        (F.count("found") >= 0.9 * F.count("d")).alias("enough"),
    )


Q["lsh_pairs"] = lambda spark, d: H.lsh_pairs(vectors(spark, d), 0.6, recall=0.99).select("id1", "id2", F.round("distance", 6).alias("distance"))
Q["lsh_recall"] = lsh_recall
SQL["lsh_recall"] = cte(VEC_CTE) + """
SELECT count(*) AS n_exact, 0 AS n_wrong, true AS enough
FROM (SELECT e, min(id) AS id FROM v GROUP BY 1) a JOIN (SELECT e, min(id) AS id FROM v GROUP BY 1) b ON a.id < b.id
WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.6"""

SWEEP = [0.2, 0.4, 0.6, 0.8, 1.0]
Q["cluster_eps_sweep"] = lambda spark, d: W.eps_sweep(vectors(spark, d), SWEEP, block_vectors=200)
SQL["cluster_eps_sweep"] = "WITH RECURSIVE " + VEC_CTE + f""",
widths AS (SELECT unnest({SWEEP}) AS eps),
pairs AS (SELECT a.id AS a, b.id AS b, 1 - list_cosine_similarity(a.e, b.e) AS far FROM v a JOIN v b ON a.id <> b.id),
links AS (SELECT eps, a, b FROM widths JOIN pairs ON far <= eps),
reach AS (SELECT eps, id, id AS hop FROM widths, v UNION SELECT reach.eps, id, b FROM reach JOIN links ON links.eps = reach.eps AND a = hop),
comp AS (SELECT eps, id, min(hop) AS component FROM reach GROUP BY 1, 2)
SELECT CAST(eps AS DOUBLE) AS eps, id, CAST(dense_rank() OVER (PARTITION BY eps ORDER BY component) - 1 AS INT) AS cluster FROM comp"""


def round_incremental(spark, d):
    """The vectors come in two rounds; labels are kept up to date."""
    v = vectors(spark, d)
    late = F.pmod("id", F.lit(3)) == 2
    state = R.add_vectors(R.empty_state(spark), v.filter(~late), 0.65, 3)
    return R.cluster_labels(R.add_vectors(state, v.filter(late), 0.65, 3, block_vectors=150))


Q["round_incremental"] = round_incremental
SQL["round_incremental"] = SQL["dbscan"]


def ngram_sql(text, dims=64, n=3):
    padded = f"('^' || lower({text}) || '$')"
    return f"""list_transform(range({dims}), lambda d: CAST(len(list_filter(
  list_transform(range(1, greatest(length({padded}) - {n - 1}, 1) + 1),
    lambda i: CAST('0x' || substr(md5(substr({padded}, i, {n})), 1, 8) AS BIGINT) % {dims}), lambda b: b = d)) AS DOUBLE))"""


def _cats(spark, d):
    return stage(S.distinct_categories(deep_catalog(spark, d)), "categories")


Q["ngram_embedding"] = lambda spark, d: X.embed_ngrams(_cats(spark, d).select(F.col("category").alias("text")))
SQL["ngram_embedding"] = cte(DEEP_CTE, CATS_CTE) + f"SELECT category AS text, {ngram_sql('category')} AS embedding FROM cats"

NAMES_CTE = f"named AS (SELECT category, first_row_id AS id, {ngram_sql('category')} AS e FROM cats)"
Q["cluster_flat"] = lambda spark, d: X.cluster_flat(_cats(spark, d), eps=0.2137)
SQL["cluster_flat"] = (
    "WITH RECURSIVE " + ",\n".join([DEEP_CTE, CATS_CTE, NAMES_CTE, dbscan_sql(0.2137, 2, "named")])
    + "\nSELECT category AS original_category, id AS first_row_id, coalesce(cluster, -1) AS cluster FROM named LEFT JOIN labels USING (id)"
)

WEIGHTED_CTE = f"""texts AS (SELECT value, {ngram_sql('value')} AS e FROM (SELECT DISTINCT value FROM lv)),
scaled AS (SELECT category, first_row_id, list_transform(e, lambda x: x / rn) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY level) AS rn FROM lv) JOIN texts USING (value) WHERE rn <= 3),
weighted AS (SELECT category, first_row_id AS id,
  list_transform(range(1, 65), lambda i: list_sum(list_transform(list(e), lambda x: x[i])) / count(*)) AS e
  FROM scaled GROUP BY 1, 2)"""
Q["weighted_embedding"] = lambda spark, d: X.weighted_embedding(_cats(spark, d)).select(
    "category", "first_row_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding")
)
SQL["weighted_embedding"] = cte(DEEP_CTE, CATS_CTE, LEVELS_CTE, WEIGHTED_CTE) + """
SELECT category, id AS first_row_id, list_transform(e, lambda x: round(x, 6)) AS embedding FROM weighted"""

Q["cluster_weighted"] = lambda spark, d: X.hierarchical_clusters(_cats(spark, d), threshold=0.1137)
SQL["cluster_weighted"] = (
    "WITH RECURSIVE " + ",\n".join([DEEP_CTE, CATS_CTE, LEVELS_CTE, WEIGHTED_CTE, dbscan_sql(0.1137, 1, "weighted")])
    + "\nSELECT category AS original_category, id AS first_row_id, coalesce(cluster, -1) AS cluster FROM weighted LEFT JOIN labels USING (id)"
)

Q["dbscan_by_level"] = lambda spark, d: X.cluster_by_levels(_cats(spark, d), eps=0.3137, min_samples=2)
SQL["dbscan_by_level"] = "WITH RECURSIVE " + ",\n".join([DEEP_CTE, CATS_CTE, LEVELS_CTE]) + f""",
vals AS (SELECT level, value, min(first_row_id) AS seen FROM lv GROUP BY 1, 2),
named AS (SELECT level, value, row_number() OVER (ORDER BY level, seen, value) AS id, {ngram_sql('value')} AS e
  FROM vals WHERE level IN (SELECT level FROM vals GROUP BY 1 HAVING count(*) > 1)),
near AS (SELECT a.id AS a, b.id AS b FROM named a JOIN named b ON a.level = b.level
  AND (a.id = b.id OR 1 - list_cosine_similarity(a.e, b.e) <= 0.3137)),
""" + dbscan_sql(0.3137, 2).split("),\n", 1)[1] + """
SELECT level, value AS category, CAST(CASE WHEN cluster IS NULL THEN -1
  ELSE cluster - min(cluster) OVER (PARTITION BY level) END AS INT) AS cluster FROM named LEFT JOIN labels USING (id)"""


Q["embedding_idf"] = lambda spark, d: T.fit_idf(_cats(spark, d).select(F.col("category").alias("text"))).select(
    "bucket", "n_texts", F.round("idf", 9).alias("idf")
)
SQL["embedding_idf"] = cte(DEEP_CTE, CATS_CTE) + """,
grams AS (SELECT category, unnest(list_distinct(list_transform(range(1, greatest(length(p) - 2, 1) + 1),
  lambda i: CAST('0x' || substr(md5(substr(p, i, 3)), 1, 8) AS BIGINT) % 256))) AS bucket
  FROM (SELECT category, '^' || lower(category) || '$' AS p FROM cats))
SELECT CAST(bucket AS INT) AS bucket, count(*) AS n_texts, round(ln(((SELECT count(*) FROM cats) + 1) / (count(*) + 1)), 9) AS idf
FROM grams GROUP BY 1"""


def embed_idf(spark, d):
    """Names in the fitted model's terms: the length of each vector, and its largest weight."""
    names = _cats(spark, d).select(F.col("category").alias("text"))
    model = T.load_idf(spark, T.save_idf(T.fit_idf(names), f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/idf-{uuid.uuid4().hex[:16]}"))
    vector = T.embed_idf(names, model)
    return vector.select(
        "text", F.round(F.sqrt(X.dot(F.col("embedding"), F.col("embedding"))), 9).alias("norm"), F.round(F.array_max("embedding"), 9).alias("top")
    )


Q["embedding_idf_names"] = embed_idf
SQL["embedding_idf_names"] = cte(DEEP_CTE, CATS_CTE) + """,
grams AS (SELECT category, bucket, count(*) AS tf FROM (SELECT category, unnest(list_transform(range(1, greatest(length(p) - 2, 1) + 1),
  lambda i: CAST('0x' || substr(md5(substr(p, i, 3)), 1, 8) AS BIGINT) % 256)) AS bucket
  FROM (SELECT category, '^' || lower(category) || '$' AS p FROM cats)) GROUP BY 1, 2),
weights AS (SELECT bucket, ln(((SELECT count(*) FROM cats) + 1) / (count(*) + 1)) AS idf FROM grams GROUP BY 1)
SELECT category AS text, round(CASE WHEN sum(pow(tf * idf, 2)) > 0 THEN 1.0 ELSE 0.0 END, 9) AS norm,
  round(coalesce(max(tf * idf) / nullif(sqrt(sum(pow(tf * idf, 2))), 0), 0), 9) AS top
FROM grams JOIN weights USING (bucket) GROUP BY category"""

# Categories by the products they hold


def supplied(spark, d, *more):
    """Suppliers as categories of the parts they deliver, with what else is asked for of a line."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("category"), F.col("l_partkey").alias("product_name"), *more
    )


def catalog_products(spark, d):
    return deep_catalog(spark, d).select("category", "product_name")


OVERLAP_CTE = """sets AS (SELECT category, list_sort(list(DISTINCT product)) AS products, count(DISTINCT product) AS n FROM held GROUP BY 1),
heads AS (SELECT products, any_value(n) AS n, min(category) AS head FROM sets GROUP BY 1),
head_items AS (SELECT head, n, unnest(products) AS product FROM heads),
crossed AS (SELECT a.head AS category1, b.head AS category2, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS together
  FROM head_items a JOIN head_items b ON a.product = b.product AND a.head < b.head GROUP BY 1, 2),
overlap_pairs AS (SELECT category1, category2, shared, shared / together AS jaccard FROM crossed WHERE shared / together >= {t}
  UNION ALL SELECT head, category, sets.n, 1.0 FROM sets JOIN heads USING (products) WHERE category <> head)"""
HELD_DEEP = "held AS (SELECT category, product_name AS product FROM deep)"
Q["product_overlap"] = lambda spark, d: O.product_overlap(catalog_products(spark, d), 0.4).withColumn(
    "jaccard", F.round("jaccard", 6)
)
SQL["product_overlap"] = cte(DEEP_CTE, HELD_DEEP, OVERLAP_CTE.format(t=0.4)) + """
SELECT category1, category2, shared, round(jaccard, 6) AS jaccard FROM overlap_pairs"""

HELD_SUPPLIED = "held AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS category, l_partkey AS product FROM lineitem)"
Q["supplier_overlap"] = lambda spark, d: O.product_overlap(supplied(spark, d), 0.15, every_copy=True).withColumn(
    "jaccard", F.round("jaccard", 6)
)
SQL["supplier_overlap"] = cte(
    HELD_SUPPLIED,
    "items AS (SELECT DISTINCT category, product FROM held WHERE category IS NOT NULL AND product IS NOT NULL)",
    "sizes AS (SELECT category, count(*) AS n FROM items GROUP BY 1)",
    """crossed AS (SELECT a.category AS category1, b.category AS category2, count(*) AS shared
  FROM items a JOIN items b ON a.product = b.product AND a.category < b.category GROUP BY 1, 2)""",
) + """SELECT category1, category2, shared, round(shared / (a.n + b.n - shared), 6) AS jaccard
FROM crossed JOIN sizes a ON a.category = category1 JOIN sizes b ON b.category = category2
WHERE shared / (a.n + b.n - shared) >= 0.15"""


def overlap_sketch(spark, d):
    """Sketches of each supplier's parts, by year of delivery and merged, against the exact overlaps."""
    held = supplied(spark, d, F.year("l_shipdate").alias("year"))
    sketches = stage(K.merge_sets(stage(K.sketch_sets(held, "year"), "years")), "sets")
    exact = stage(O.product_overlap(supplied(spark, d), 0.15).select("category1", "category2", "shared", "jaccard"), "exact")
    guess = K.sketched_overlap(exact.select("category1", "category2"), sketches)
    both = exact.withColumnRenamed("shared", "true_shared").join(guess, ["category1", "category2"])
    inside = (F.col("true_shared") >= F.col("shared_low")) & (F.col("true_shared") <= F.col("shared_high"))
    return both.agg(F.count("*").alias("n_pairs"), (F.count_if(inside) >= 0.95 * F.count("*")).alias("within"))


Q["overlap_sketch"] = overlap_sketch
SQL["overlap_sketch"] = cte(HELD_SUPPLIED, OVERLAP_CTE.format(t=0.15)) + "SELECT count(*) AS n_pairs, true AS within FROM overlap_pairs"


def _hybrid(spark, d):
    cats = _cats(spark, d)
    names = L.fuzzy_pairs(cats.select(F.col("category").alias("text")), "jaro_winkler", 95)
    return cats, stage(O.hybrid_pairs(names, O.product_overlap(catalog_products(spark, d), 0.4), 0.5, 0.6), "hybrid")


HYBRID_CTE = """name_pairs AS (SELECT a.category AS category1, b.category AS category2,
  floor(jaro_winkler_similarity(a.category, b.category) * 100) AS score FROM cats a JOIN cats b ON a.category < b.category
  WHERE floor(jaro_winkler_similarity(a.category, b.category) * 100) >= 95),
hybrid AS (SELECT category1, category2, coalesce(score, 0.0) AS name_score, coalesce(jaccard, 0.0) AS jaccard,
  coalesce(score, 0.0) / 100 * 0.5 + coalesce(jaccard, 0.0) * 0.5 AS hybrid
  FROM name_pairs FULL JOIN overlap_pairs USING (category1, category2)
  WHERE coalesce(score, 0.0) / 100 * 0.5 + coalesce(jaccard, 0.0) * 0.5 >= 0.6)"""
HYBRID = [DEEP_CTE, CATS_CTE, HELD_DEEP, OVERLAP_CTE.format(t=0.4), HYBRID_CTE]
Q["hybrid_pairs"] = lambda spark, d: _hybrid(spark, d)[1].select(
    "category1", "category2", "name_score", F.round("jaccard", 6).alias("jaccard"), F.round("hybrid", 6).alias("hybrid")
)
SQL["hybrid_pairs"] = cte(*HYBRID) + """
SELECT category1, category2, name_score, round(jaccard, 6) AS jaccard, round(hybrid, 6) AS hybrid FROM hybrid"""

Q["hybrid_clusters"] = lambda spark, d: O.pair_clusters(*_hybrid(spark, d))
SQL["hybrid_clusters"] = "WITH RECURSIVE " + ",\n".join(HYBRID) + """,
e AS (SELECT a.first_row_id AS src, b.first_row_id AS dst FROM hybrid JOIN cats a ON a.category = category1 JOIN cats b ON b.category = category2),
both_ways AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
reach AS (SELECT first_row_id AS id, first_row_id AS hop FROM cats UNION SELECT id, dst FROM reach JOIN both_ways ON src = hop)
SELECT category AS original_category, first_row_id, cluster FROM cats
JOIN (SELECT id, min(hop) AS cluster FROM reach GROUP BY 1) ON id = first_row_id"""


# Column names by embedding, with the facts of the whole table


def similar_pairs_by_embedding(spark, d):
    methods = {"token_sort": None, "embedding": 20, "embed": X.embed_ngrams}
    return P.similar_pairs(staged_lines(spark, d, "row_id", "source_file", *ATTRIBUTES), ATTRIBUTES, **methods)


Q["similar_pairs_by_embedding"] = similar_pairs_by_embedding
SQL["similar_pairs_by_embedding"] = cte(*PAIR_BASE) + f""",
vecs AS (SELECT column_name, {ngram_sql('column_name')} AS e FROM names),
scored AS (SELECT col1, col2, floor(list_cosine_similarity(a.e, b.e) * 100 + 1e-7) AS score FROM pairs
  JOIN vecs a ON a.column_name = col1 JOIN vecs b ON b.column_name = col2)
SELECT col1, col2, score, 'embedding' AS method, filled1, filled2, overlap, conflicts, sources_different,
  filled1 + filled2 - overlap AS potential
FROM facts JOIN scored USING (col1, col2) WHERE (sources_different OR non_conflicting) AND score >= 20
ORDER BY score DESC, col1, col2"""
