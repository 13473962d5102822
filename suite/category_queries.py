"""Category hierarchy, clusters, group assignments and final tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalign.operators import groups as G
from catalign.operators import hierarchy as H
from catalign.operators import schema as S
from catalign.runtime import global_rank, stage
from suite.views import cte, table

Q, SQL = {}, {}


def deep_catalog(spark, sf_dir):
    """Paths of two or three levels; odd brands come from one source only."""
    part = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return part.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("product_name"),
        F.when(brand % 2 == 1, F.lit("src1"))
        .otherwise(F.concat(F.lit("src"), (F.col("p_partkey") % 4).cast("string")))
        .alias("source_file"),
        F.concat(
            F.col("p_type"),
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/"), "p_name")).otherwise(F.lit("")),
            F.lit(" / "),
            F.col("p_brand"),
        ).alias("category"),
    )


DEEP_CTE = """deep AS (
SELECT p_partkey AS row_id, p_name AS product_name,
       CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 2 = 1 THEN 'src1'
            ELSE 'src' || CAST(p_partkey % 4 AS VARCHAR) END AS source_file,
       p_type || CASE WHEN p_partkey % 3 = 0 THEN '/' || p_name ELSE '' END || ' / ' || p_brand AS category
FROM part)"""
CATS_CTE = "cats AS (SELECT category, min(row_id) AS first_row_id FROM deep GROUP BY 1)"
LEVELS_CTE = """lv AS (
SELECT category, first_row_id, CAST(i AS INT) AS level, trim(parts[i]) AS value
FROM (SELECT *, string_split(category, '/') AS parts FROM cats), unnest(range(1, len(parts) + 1)) t(i)
WHERE trim(parts[i]) <> '')"""
DETAILED_CTE = """pair_ids AS (
SELECT level, value, CAST(row_number() OVER (ORDER BY level DESC, min(first_row_id), value) - 1 AS INT) AS cluster
FROM lv GROUP BY level, value),
deepest AS (SELECT category, first_row_id, max(level) AS level, max_by(value, level) AS value FROM lv GROUP BY 1, 2),
clusters AS (SELECT category AS original_category, first_row_id, cluster FROM deepest JOIN pair_ids USING (level, value)),
reps AS (SELECT cluster, min_by(original_category, first_row_id) AS group_name, count(*) AS n_members
         FROM clusters GROUP BY 1)"""
BASE = [DEEP_CTE, CATS_CTE, LEVELS_CTE, DETAILED_CTE]
AUTO_CTE = """assigned AS (SELECT original_category AS category, group_name, 'auto' AS kind, CAST(1 AS INT) AS round
FROM clusters JOIN reps USING (cluster) WHERE cluster <> -1 AND n_members > 1)"""


def _cats(spark, d):
    return stage(S.distinct_categories(deep_catalog(spark, d)), "categories")


def _clusters(spark, d):
    return stage(H.cluster_detailed_first(_cats(spark, d)), "clusters")


Q["hierarchy_levels"] = lambda spark, d: H.parse_levels(deep_catalog(spark, d).select("row_id", "category"))[0]
SQL["hierarchy_levels"] = cte(DEEP_CTE) + """
SELECT row_id, category, trim(string_split(category, '/')[1]) AS category_level_1,
       coalesce(trim(string_split(category, '/')[2]), '') AS category_level_2,
       coalesce(trim(string_split(category, '/')[3]), '') AS category_level_3 FROM deep"""

Q["hierarchy_long"] = lambda spark, d: H.long_levels(_cats(spark, d))
SQL["hierarchy_long"] = cte(DEEP_CTE, CATS_CTE, LEVELS_CTE) + "SELECT * FROM lv"

Q["cluster_detailed_first"] = _clusters
SQL["cluster_detailed_first"] = cte(*BASE) + "SELECT * FROM clusters"


def _fallback(spark, d):
    return H.cluster_parent_fallback(_short_paths(spark, d))


def _short_paths(spark, d):
    """Paths whose last level is sometimes unique, so parents are needed."""
    part = table(spark, d, "part")
    return S.distinct_categories(
        part.select(
            F.col("p_partkey").alias("row_id"),
            F.concat_ws(
                "/",
                F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("S"), F.col("p_partkey").cast("string"))).otherwise(
                    F.col("p_type")
                ),
                F.col("p_brand"),
                F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("N"), (F.col("p_partkey") % 997).cast("string"))),
                F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("K"), F.col("p_partkey").cast("string"))),
            ).alias("category"),
        )
    )


Q["cluster_parent_fallback"] = _fallback
_LEVEL = """v{n} AS (SELECT category, first_row_id, {n} AS level, trim(string_split(category, '/')[{n}]) AS value FROM pool{n}),
s{n} AS (SELECT value, min(first_row_id) AS seen FROM v{n} WHERE value <> '' GROUP BY 1 HAVING count(*) > 1),
h{n} AS (SELECT category, first_row_id, level, value, seen FROM v{n} JOIN s{n} USING (value)),
pool{m} AS (SELECT * FROM pool{n} WHERE category NOT IN (SELECT category FROM h{n}))"""
SQL["cluster_parent_fallback"] = cte(
    """pool4 AS (SELECT category, min(row_id) AS first_row_id FROM (
SELECT p_partkey AS row_id, CASE WHEN p_partkey % 11 = 0 THEN 'S' || CAST(p_partkey AS VARCHAR) ELSE p_type END || '/' || p_brand
 || CASE WHEN p_partkey % 5 = 0 THEN '/N' || CAST(p_partkey % 997 AS VARCHAR) ELSE '' END
 || CASE WHEN p_partkey % 10 = 0 THEN '/K' || CAST(p_partkey AS VARCHAR) ELSE '' END AS category FROM part) GROUP BY 1)""",
    *[_LEVEL.format(n=n, m=n - 1) for n in (4, 3, 2, 1)],
    "h AS (SELECT * FROM h4 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h1)",
    """ids AS (SELECT level, value, seen, CAST(row_number() OVER (ORDER BY level DESC, seen, value) - 1 AS INT) AS cluster
FROM (SELECT DISTINCT level, value, seen FROM h))""",
) + """
SELECT category AS original_category, first_row_id, cluster FROM h JOIN ids USING (level, value, seen)
UNION ALL SELECT category, first_row_id, -1 FROM pool0"""

Q["cluster_count"] = lambda spark, d: H.number_of_clusters(_fallback(spark, d))
SQL["cluster_count"] = SQL["cluster_parent_fallback"].replace(
    "\nSELECT category AS original_category, first_row_id, cluster FROM h JOIN ids USING (level, value, seen)\n"
    "UNION ALL SELECT category, first_row_id, -1 FROM pool0",
    "\nSELECT count(*) AS n_clusters FROM ids",
)

Q["representatives"] = lambda spark, d: G.representatives(_clusters(spark, d))
SQL["representatives"] = cte(*BASE) + "SELECT * FROM reps"

Q["cluster_listing"] = lambda spark, d: G.cluster_listing(_fallback(spark, d))
SQL["cluster_listing"] = SQL["cluster_parent_fallback"].replace(
    "\nSELECT category AS original_category", ", c AS (SELECT category AS original_category"
) + """),
r AS (SELECT cluster, min_by(original_category, first_row_id) AS representative, count(*) AS n_members FROM c GROUP BY 1)
SELECT cluster, original_category, first_row_id, representative, n_members, cluster = -1 AS is_noise
FROM c JOIN r USING (cluster)"""

Q["auto_assignments"] = lambda spark, d: G.auto_assignments(_clusters(spark, d))
SQL["auto_assignments"] = cte(*BASE, AUTO_CTE) + "SELECT * FROM assigned"


def _grouped(spark, d):
    df = S.with_initial_group(deep_catalog(spark, d))
    clusters = _clusters(spark, d)
    return G.apply_groups(df, G.rename_map(clusters, G.auto_assignments(clusters)))


Q["apply_groups"] = _grouped
GROUPED_CTE = """grouped AS (SELECT d.*, coalesce(a.group_name, d.category) AS group_name
FROM deep d LEFT JOIN assigned a USING (category))"""
SQL["apply_groups"] = cte(*BASE, AUTO_CTE, GROUPED_CTE) + "SELECT * FROM grouped"

FILTERED_CTE = """filtered AS (SELECT grouped.* FROM grouped
JOIN (SELECT group_name, count(DISTINCT source_file) AS n FROM grouped GROUP BY 1) USING (group_name)
WHERE n > 1 OR group_name = category)"""
Q["cross_source_filter"] = lambda spark, d: G.cross_source_filter(_grouped(spark, d))
SQL["cross_source_filter"] = cte(*BASE, AUTO_CTE, GROUPED_CTE, FILTERED_CTE) + "SELECT * FROM filtered"

Q["filter_diagnostics"] = lambda spark, d: G.filter_diagnostics(G.cross_source_filter(_grouped(spark, d)))
SQL["filter_diagnostics"] = cte(*BASE, AUTO_CTE, GROUPED_CTE, FILTERED_CTE) + """
SELECT count(*) FILTER (group_name = category) AS own_name_rows,
       count(*) FILTER (group_name <> category) AS grouped_rows FROM filtered"""


def _joined(spark, d, clusters):
    chosen = clusters.select("cluster").distinct().filter("cluster % 2 = 0")
    return G.join_clusters(clusters, chosen, 1)


Q["join_clusters"] = lambda spark, d: _joined(spark, d, _clusters(spark, d))
JOINED_CTE = """joined AS (SELECT original_category AS category, group_name, 'join' AS kind, CAST(1 AS INT) AS round
FROM clusters JOIN reps USING (cluster) WHERE cluster % 2 = 0)"""
SQL["join_clusters"] = cte(*BASE, JOINED_CTE) + "SELECT * FROM joined"


def _parents(pool):
    """Cluster the pool by its first level only."""
    tops = pool.withColumn("top", F.trim(F.element_at(F.split("category", "/"), 1)))
    firsts = tops.groupBy("top").agg(F.min("first_row_id").alias("seen"))
    ids = global_rank(firsts, [F.col("seen"), F.col("top")], "cluster")
    return tops.join(ids, "top").select(F.col("category").alias("original_category"), "first_row_id", "cluster")


def _rounds(spark, d):
    cats = _cats(spark, d)
    first = _joined(spark, d, H.cluster_detailed_first(cats))
    return G.next_round(cats, first, _parents, 2)


Q["next_round"] = _rounds
ROUNDS_CTE = """pool AS (SELECT * FROM cats WHERE category NOT IN (SELECT category FROM joined)),
second AS (SELECT category, min_by(category, first_row_id) OVER w AS group_name, 'auto' AS kind, CAST(2 AS INT) AS round
           FROM pool WINDOW w AS (PARTITION BY trim(string_split(category, '/')[1]))
           QUALIFY count(*) OVER w > 1),
rounds AS (SELECT * FROM joined UNION ALL SELECT * FROM second)"""
SQL["next_round"] = cte(*BASE, JOINED_CTE, ROUNDS_CTE) + "SELECT * FROM rounds"


def _merged_assignments(spark, d):
    cats = _cats(spark, d)
    first = _joined(spark, d, H.cluster_detailed_first(cats))
    promo = G.unfixed_pool(cats, first).filter(F.col("category").startswith("PROMO"))
    return G.manual_merge(first, promo, "promotions", 2)


Q["manual_merge"] = _merged_assignments
MANUAL_CTE = """merged AS (SELECT * FROM joined UNION ALL
SELECT category, 'promotions', 'manual', CAST(2 AS INT) FROM cats
WHERE category LIKE 'PROMO%' AND category NOT IN (SELECT category FROM joined))"""
SQL["manual_merge"] = cte(*BASE, JOINED_CTE, MANUAL_CTE) + "SELECT * FROM merged"

Q["category_listing"] = lambda spark, d: G.category_listing(_cats(spark, d), _merged_assignments(spark, d))
SQL["category_listing"] = cte(*BASE, JOINED_CTE, MANUAL_CTE) + """
SELECT category, group_name AS assigned_group, group_name IS NULL AS available
FROM cats LEFT JOIN merged USING (category) ORDER BY 1"""

Q["group_members"] = lambda spark, d: G.group_members(_merged_assignments(spark, d), _grouped(spark, d))
SQL["group_members"] = cte(*BASE, AUTO_CTE, GROUPED_CTE, JOINED_CTE, MANUAL_CTE) + """
SELECT group_name, category FROM merged UNION
SELECT group_name, category FROM grouped WHERE group_name IN (SELECT group_name FROM merged)"""


def _exploded(spark, d):
    assignments = _merged_assignments(spark, d)
    df = G.working_table(S.with_initial_group(deep_catalog(spark, d)), assignments)
    names = assignments.select("group_name").distinct().filter("group_name = 'promotions' OR group_name LIKE '%Brand#1%'")
    return G.explode_groups(assignments, df, names)


Q["explode_groups"] = lambda spark, d: _exploded(spark, d)[1]
EXPLODED_CTE = """working AS (SELECT d.*, coalesce(m.group_name, d.category) AS group_name
FROM deep d LEFT JOIN merged m USING (category)),
gone AS (SELECT DISTINCT group_name FROM merged WHERE group_name = 'promotions' OR group_name LIKE '%Brand#1%')"""
SQL["explode_groups"] = cte(*BASE, JOINED_CTE, MANUAL_CTE, EXPLODED_CTE) + """
SELECT row_id, product_name, source_file, category,
       CASE WHEN group_name IN (SELECT group_name FROM gone) THEN category ELSE group_name END AS group_name FROM working"""
Q["assignments_after_explode"] = lambda spark, d: _exploded(spark, d)[0]
SQL["assignments_after_explode"] = cte(*BASE, JOINED_CTE, MANUAL_CTE, EXPLODED_CTE) + """
SELECT * FROM merged WHERE group_name NOT IN (SELECT group_name FROM gone)"""


def reset_groups(spark, d):
    """After a reset every category is open again and groups are the categories."""
    df = S.with_initial_group(deep_catalog(spark, d))
    return G.working_table(df, G.no_assignments(spark))


Q["reset_groups"] = reset_groups
SQL["reset_groups"] = cte(DEEP_CTE) + "SELECT *, category AS group_name FROM deep"


def _final(spark, d):
    df = S.with_initial_group(deep_catalog(spark, d))
    clusters = _clusters(spark, d)
    working = G.cross_source_filter(G.apply_groups(df, G.rename_map(clusters, G.auto_assignments(clusters))))
    return G.final_groups(df, working, _merged_assignments(spark, d))


Q["final_groups"] = _final
FINAL_CTE = """current_group AS (SELECT category, min_by(group_name, row_id) AS cur FROM filtered GROUP BY 1),
final AS (SELECT d.row_id, d.product_name, d.source_file, d.category,
  coalesce(m.group_name, CASE WHEN c.cur <> d.category THEN c.cur END, 'ungrouped') AS group_name
FROM deep d LEFT JOIN merged m USING (category) LEFT JOIN current_group c USING (category))"""
FINAL = [*BASE, AUTO_CTE, GROUPED_CTE, FILTERED_CTE, JOINED_CTE, MANUAL_CTE, FINAL_CTE]
SQL["final_groups"] = cte(*FINAL) + "SELECT * FROM final"

Q["working_table"] = lambda spark, d: G.working_table(
    G.cross_source_filter(_grouped(spark, d)), _merged_assignments(spark, d)
)
SQL["working_table"] = cte(*BASE, AUTO_CTE, GROUPED_CTE, FILTERED_CTE, JOINED_CTE, MANUAL_CTE) + """
SELECT f.row_id, f.product_name, f.source_file, f.category, coalesce(m.group_name, f.group_name) AS group_name
FROM filtered f LEFT JOIN merged m USING (category)"""

Q["group_summary"] = lambda spark, d: G.group_summary(_final(spark, d))
SQL["group_summary"] = cte(*FINAL) + """
SELECT count(DISTINCT category) AS total_categories,
       count(DISTINCT group_name) FILTER (group_name <> 'ungrouped') AS grouped_categories,
       round((1 - count(DISTINCT group_name) FILTER (group_name <> 'ungrouped') / count(DISTINCT category)) * 100, 1)
         AS reduction_pct FROM final"""

Q["top_groups"] = lambda spark, d: G.top_groups(_final(spark, d))
SQL["top_groups"] = cte(*FINAL) + """
SELECT group_name, count(*) AS n_rows FROM final WHERE group_name <> 'ungrouped'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
