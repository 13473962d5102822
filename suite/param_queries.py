"""Attribute-column statistics, matching and merging; fuzzy joins of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalign.functions.strings import token_sort_text
from catalign.operators import assignment as B
from catalign.operators import linkage as L
from catalign.operators import params as P
from catalign.operators import record_linkage as R
from catalign.operators import schema as S
from catalign.runtime import global_rank, stage
from suite.views import ATTRIBUTES, CATALOG_CTE, LINE_ROWS, NA_LIST, catalog, cte, product_lines, table

Q, SQL = {}, {}

LINES_CTE = "lines AS (" + LINE_ROWS + """),
product AS (SELECT l.row_id, c.* EXCLUDE (row_id) FROM lines l JOIN catalog c ON c.row_id = l.part_id),
clean AS (SELECT row_id, source_file, category, product_name, """ + ", ".join(
    f"CASE WHEN trim({c}) NOT IN ({NA_LIST}) THEN {c} END AS {c}" for c in ATTRIBUTES
) + " FROM product)"
CELLS_CTE = f"""cells AS (SELECT row_id, source_file, column_name, value,
       list_position([{", ".join(f"'{c}'" for c in ATTRIBUTES)}], column_name) AS pos
FROM (UNPIVOT clean ON {", ".join(ATTRIBUTES)} INTO NAME column_name VALUE value))"""
PAIRS_CTE = f"""names AS (SELECT unnest([{", ".join(f"'{c}'" for c in ATTRIBUTES)}]) AS column_name,
  unnest(range({len(ATTRIBUTES)})) AS pos),
pairs AS (SELECT a.column_name AS col1, b.column_name AS col2 FROM names a JOIN names b ON a.pos < b.pos),
fills AS (SELECT column_name, count(*) AS filled, count(DISTINCT source_file) AS n_sources FROM cells GROUP BY 1),
overlapped AS (SELECT a.column_name AS col1, b.column_name AS col2, count(*) AS overlap,
       count(*) FILTER (a.value <> b.value) AS conflicts
FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.pos < b.pos GROUP BY 1, 2),
commons AS (SELECT a.column_name AS col1, b.column_name AS col2, count(*) AS common
FROM (SELECT DISTINCT column_name, source_file FROM cells) a
JOIN (SELECT DISTINCT column_name, source_file FROM cells) b USING (source_file) GROUP BY 1, 2),
facts AS (SELECT col1, col2, coalesce(f1.filled, 0) AS filled1, coalesce(f2.filled, 0) AS filled2,
       coalesce(overlap, 0) AS overlap, coalesce(conflicts, 0) AS conflicts,
       coalesce(f1.n_sources, 0) > 0 AND coalesce(f2.n_sources, 0) > 0
         AND coalesce(common, 0) < greatest(f1.n_sources, f2.n_sources) AS sources_different,
       coalesce(conflicts, 0) <= 0.1 * coalesce(overlap, 0) AS non_conflicting
FROM pairs LEFT JOIN overlapped USING (col1, col2) LEFT JOIN commons USING (col1, col2)
LEFT JOIN fills f1 ON f1.column_name = col1 LEFT JOIN fills f2 ON f2.column_name = col2)"""
BASE = [CATALOG_CTE, LINES_CTE, CELLS_CTE, PAIRS_CTE]


def clean_lines(spark, d):
    """The large catalogue without null tokens; only the columns a query uses are computed."""
    return S.normalize_na(product_lines(spark, d), ATTRIBUTES)


def staged_lines(spark, d, *columns):
    """The same, written once, for queries that read it several times."""
    return stage(clean_lines(spark, d).select(*columns), "catalog")


Q["fill_counts"] = lambda spark, d: P.fill_counts(clean_lines(spark, d), ATTRIBUTES)
SQL["fill_counts"] = cte(*BASE) + "SELECT column_name, filled FROM fills"

Q["pair_overlap"] = lambda spark, d: P.pair_counts(clean_lines(spark, d), ATTRIBUTES)
SQL["pair_overlap"] = cte(*BASE) + "SELECT * FROM overlapped"

Q["pair_compatibility"] = lambda spark, d: P.compatibility(staged_lines(spark, d, "row_id", "source_file", *ATTRIBUTES), ATTRIBUTES)
SQL["pair_compatibility"] = cte(*BASE) + """
SELECT *, sources_different OR non_conflicting AS compatible,
       CASE WHEN sources_different OR non_conflicting
            THEN CASE WHEN non_conflicting THEN '' ELSE 'many conflicts' END
            ELSE 'same sources and conflicting values' END AS reason,
       (SELECT count(*) FROM product) AS total_rows FROM facts"""

Q["conflict_pct"] = lambda spark, d: P.conflict_pct(P.pair_counts(clean_lines(spark, d), ATTRIBUTES))
SQL["conflict_pct"] = cte(*BASE) + """
SELECT *, round(conflicts / greatest(overlap, 1) * 100, 1) AS conflict_pct FROM overlapped"""

Q["column_pairs_filled"] = lambda spark, d: P.column_pairs(spark, ATTRIBUTES).join(
    P.fill_counts(clean_lines(spark, d), ATTRIBUTES).withColumnRenamed("column_name", "col1"), "col1"
)
SQL["column_pairs_filled"] = cte(*BASE) + """
SELECT col1, col2, filled FROM pairs JOIN fills ON column_name = col1"""

MERGES = [("weight_kg", "weight"), ("brand", "vendor"), ("brand", "manufacturer"), ("weight_kg", "weight")]
Q["merge_all_pairs"] = lambda spark, d: P.merge_all(
    clean_lines(spark, d).select("row_id", "weight_kg", "weight", "brand", "vendor", "manufacturer"), MERGES
)
SQL["merge_all_pairs"] = cte(CATALOG_CTE, LINES_CTE) + """
SELECT row_id, weight_kg, weight, brand, vendor, manufacturer, coalesce(weight_kg, weight) AS weight_kg_weight_merged,
       coalesce(brand, vendor) AS brand_vendor_merged, coalesce(brand, manufacturer) AS brand_manufacturer_merged FROM clean"""

Q["merge_two_columns"] = lambda spark, d: P.merge_columns(
    clean_lines(spark, d).select("row_id", "manufacturer", "vendor"), "manufacturer", "vendor", "vendor"
)
SQL["merge_two_columns"] = cte(CATALOG_CTE, LINES_CTE) + """
SELECT row_id, manufacturer, coalesce(manufacturer, vendor) AS vendor FROM clean"""

Q["merge_preview"] = lambda spark, d: P.merge_preview(clean_lines(spark, d), "brand", "manufacturer")
SQL["merge_preview"] = cte(CATALOG_CTE, LINES_CTE) + """
SELECT count(brand) AS filled1, count(manufacturer) AS filled2, count(coalesce(brand, manufacturer)) AS filled_merged
FROM clean"""

Q["merge_conflicts"] = lambda spark, d: P.conflicts(clean_lines(spark, d), "brand", "vendor", ["row_id"])
SQL["merge_conflicts"] = cte(CATALOG_CTE, LINES_CTE) + """
SELECT row_id, brand AS value1, vendor AS value2, brand AS merged FROM clean WHERE brand <> vendor"""

REPORT = {"token_sort": 50, "jaro_winkler": 60}
Q["similar_pairs_report"] = lambda spark, d: P.similar_pairs(
    staged_lines(spark, d, "row_id", "source_file", *ATTRIBUTES), ATTRIBUTES, **REPORT
)
# Names with their words sorted, and the longest common subsequence of each two, letter by letter.
TOKEN_SORT_SQL = """worded AS (SELECT col1, col2, array_to_string(list_sort(string_split(col1, ' ')), ' ') AS n1,
  array_to_string(list_sort(string_split(col2, ' ')), ' ') AS n2 FROM pairs),
steps AS (SELECT col1, col2, n1, n2, 0 AS i, list_transform(range(len(n2) + 1), lambda x: 0) AS best FROM worded
UNION ALL
SELECT col1, col2, n1, n2, i + 1, list_reduce(range(1, len(n2) + 1), lambda acc, j: list_append(acc,
  CASE WHEN n1[i + 1] = n2[j] THEN best[j] + 1 ELSE greatest(best[j + 1], acc[-1]) END), [0]) FROM steps WHERE i < len(n1)),
token AS (SELECT col1, col2, 200.0 * best[-1] / (len(n1) + len(n2)) AS ts FROM steps
  WHERE i = len(n1) AND 200.0 * best[-1] / (len(n1) + len(n2)) >= 50)"""
SQL["similar_pairs_report"] = "WITH RECURSIVE " + ",\n".join(BASE) + f""",
scored AS (SELECT col1, col2, floor(jaro_winkler_similarity(col1, col2) * 100) AS jw FROM pairs),
{TOKEN_SORT_SQL}
SELECT col1, col2, CAST(coalesce(ts, jw) AS DOUBLE) AS score,
       CASE WHEN ts IS NULL THEN 'jaro_winkler' ELSE 'token_sort' END AS method,
       filled1, filled2, overlap, conflicts, sources_different, filled1 + filled2 - overlap AS potential
FROM facts JOIN scored USING (col1, col2) LEFT JOIN token USING (col1, col2)
WHERE (sources_different OR non_conflicting) AND (ts IS NOT NULL OR jw >= 60) ORDER BY score DESC, col1, col2"""


def _selected_merge(spark, d):
    df = staged_lines(spark, d, "row_id", "source_file", *ATTRIBUTES)
    pairs = P.similar_pairs(df, ATTRIBUTES, token_sort=70)
    return P.merge_pair(df, pairs, "weight_kg", "weight", "weight_any")


Q["merge_chosen_pair"] = lambda spark, d: _selected_merge(spark, d)[0]
SQL["merge_chosen_pair"] = cte(CATALOG_CTE, LINES_CTE) + """
SELECT row_id, source_file, """ + ", ".join(ATTRIBUTES) + ", coalesce(weight_kg, weight) AS weight_any FROM clean"


def _harmonized(spark, d):
    df = staged_lines(spark, d, "row_id", "source_file", *ATTRIBUTES)
    members = P.attribute_components(spark, ATTRIBUTES, P.similar_pairs(df, ATTRIBUTES, **REPORT))
    return df, members


# Accepted similar pairs, as in the report, and what they connect.
ACCEPTED_CTE = f"""scored AS (SELECT col1, col2, floor(jaro_winkler_similarity(col1, col2) * 100) AS jw FROM pairs),
{TOKEN_SORT_SQL},
accepted AS (SELECT col1, col2 FROM facts JOIN scored USING (col1, col2) LEFT JOIN token USING (col1, col2)
  WHERE (sources_different OR non_conflicting) AND (ts IS NOT NULL OR jw >= 60)),
e AS (SELECT a.pos AS src, b.pos AS dst FROM accepted JOIN names a ON a.column_name = col1 JOIN names b ON b.column_name = col2),
both_ways AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
reach AS (SELECT pos AS id, pos AS hop FROM names UNION SELECT id, dst FROM reach JOIN both_ways ON src = hop),
comp AS (SELECT id, min(hop) AS component FROM reach GROUP BY 1),
members AS (SELECT n.column_name, f.column_name AS attribute, n.pos FROM comp JOIN names n ON n.pos = id JOIN names f ON f.pos = component)"""

Q["attribute_components"] = lambda spark, d: _harmonized(spark, d)[1]
SQL["attribute_components"] = "WITH RECURSIVE " + ",\n".join([*BASE, ACCEPTED_CTE]) + """
SELECT column_name, attribute, CAST(pos AS INT) AS position FROM members"""


def harmonize_attributes(spark, d):
    """The attributes in long form: their names are part of the result."""
    df, members = _harmonized(spark, d)
    merged = P.harmonize_attributes(df, members, ["row_id"])
    return S.unpivot_values(merged, [c for c in merged.columns if c != "row_id"], ["row_id"])


Q["harmonize_attributes"] = harmonize_attributes
SQL["harmonize_attributes"] = "WITH RECURSIVE " + ",\n".join([*BASE, ACCEPTED_CTE]) + """
SELECT row_id, attribute AS column_name, value FROM cells JOIN members USING (column_name)
QUALIFY row_number() OVER (PARTITION BY row_id, attribute ORDER BY members.pos) = 1"""

def _assigned(spark, d):
    df = staged_lines(spark, d, "row_id", "source_file", *ATTRIBUTES)
    names = spark.createDataFrame([(c,) for c in ATTRIBUTES], "text string")
    return B.assign_attributes(spark, ATTRIBUTES, L.fuzzy_pairs(names, "jaro_winkler", 50), P.compatibility(df, ATTRIBUTES))


Q["attribute_assignment"] = _assigned
# All partitions of the columns: each column joins a part that there is, or begins the next one.
SQL["attribute_assignment"] = "WITH RECURSIVE " + ",\n".join(BASE) + f""",
grow AS (SELECT [0] AS labels, 0 AS top UNION ALL
  SELECT list_append(labels, l), greatest(top, l) FROM grow, unnest(range(top + 2)) AS t(l) WHERE len(labels) < {len(ATTRIBUTES)}),
placed AS (SELECT column_name, row_number() OVER (ORDER BY pos) AS place FROM names),
near AS (SELECT a.place AS i, b.place AS j, floor(jaro_winkler_similarity(a.column_name, b.column_name) * 100) AS score
  FROM placed a JOIN placed b ON a.place < b.place WHERE floor(jaro_winkler_similarity(a.column_name, b.column_name) * 100) >= 50),
bad AS (SELECT a.place AS i, b.place AS j FROM facts JOIN placed a ON a.column_name = col1 JOIN placed b ON b.column_name = col2 WHERE NOT non_conflicting),
kept AS (SELECT labels, top FROM grow WHERE len(labels) = {len(ATTRIBUTES)} AND NOT EXISTS (SELECT 1 FROM bad WHERE labels[i] = labels[j])),
best AS (SELECT labels FROM kept ORDER BY coalesce((SELECT sum(score) FROM near WHERE labels[i] = labels[j]), 0) DESC, top DESC, labels LIMIT 1)
SELECT p.column_name, (SELECT min_by(q.column_name, q.place) FROM placed q WHERE labels[q.place] = labels[p.place]) AS attribute,
  CAST(p.place - 1 AS INT) AS position FROM placed p, best"""

Q["merge_preview_rows"] = lambda spark, d: P.merge_preview_rows(clean_lines(spark, d), "brand", "vendor")
SQL["merge_preview_rows"] = cte(CATALOG_CTE, LINES_CTE) + """,
shown AS (SELECT row_id, brand AS value1, vendor AS value2, coalesce(brand, vendor) AS merged FROM clean)
(SELECT *, 'rows' AS part FROM shown ORDER BY row_id LIMIT 10)
UNION ALL (SELECT *, 'conflicts' AS part FROM shown WHERE value1 <> value2 ORDER BY row_id LIMIT 5)"""


# Fuzzy joins of values


def titles(spark, d):
    """Distinct product titles of the whole part table."""
    part = table(spark, d, "part")
    return part.select(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("text")).distinct()


TITLES_CTE = "titles AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) AS text FROM part)"

Q["jaro_winkler_pairs"] = lambda spark, d: L.fuzzy_pairs(titles(spark, d), "jaro_winkler", 94)
SQL["jaro_winkler_pairs"] = cte(TITLES_CTE) + """
SELECT a.text AS text1, b.text AS text2, floor(jaro_winkler_similarity(a.text, b.text) * 100) AS score
FROM titles a JOIN titles b ON a.text < b.text WHERE floor(jaro_winkler_similarity(a.text, b.text) * 100) >= 94"""


def token_sort_pairs(spark, d):
    return L.fuzzy_pairs(titles(spark, d).select(token_sort_text(F.col("text")).alias("text")), "token_sort", 92)


Q["token_sort_pairs"] = token_sort_pairs
SORTED_CTE = """sorted AS (SELECT DISTINCT array_to_string(list_sort(string_split(text, ' ')), ' ') AS text FROM titles),
lettered AS (SELECT text, string_split(text, '') AS chars, len(text) AS n,
  list_transform(range(1, len(text) + 1), lambda i: text[i] || CAST(len(list_filter(string_split(text[1:i], ''), lambda c: c = text[i])) AS VARCHAR)) AS bag
  FROM sorted),
near AS (SELECT a.text AS text1, b.text AS text2, a.chars AS chars1, b.chars AS chars2, a.n AS n1, b.n AS n2
FROM lettered a JOIN lettered b ON a.text < b.text AND a.n * 2 >= 0.92 * (a.n + b.n) AND b.n * 2 >= 0.92 * (a.n + b.n)
WHERE len(list_intersect(a.bag, b.bag)) * 2 >= 0.92 * (a.n + b.n)),
walked AS (SELECT text1, text2, n1, n2, 0 AS i, list_transform(range(n2 + 1), lambda x: 0) AS best, chars1, chars2 FROM near
UNION ALL
SELECT text1, text2, n1, n2, i + 1,
  list_reduce(range(1, n2 + 1), lambda acc, j: list_append(acc,
    CASE WHEN chars1[i + 1] = chars2[j] THEN best[j] + 1 ELSE greatest(best[j + 1], acc[-1]) END), [0]),
  chars1, chars2 FROM walked WHERE i < n1)"""
SQL["token_sort_pairs"] = "WITH RECURSIVE " + ",\n".join([TITLES_CTE, SORTED_CTE]) + """
SELECT text1, text2, 200.0 * best[-1] / (n1 + n2) AS score FROM walked
WHERE i = n1 AND 200.0 * best[-1] / (n1 + n2) >= 92"""


def fuzzy_value_groups(spark, d):
    values = titles(spark, d)
    return L.link_values(values, L.fuzzy_pairs(values, "jaro_winkler", 97))


Q["fuzzy_value_groups"] = fuzzy_value_groups
SQL["fuzzy_value_groups"] = "WITH RECURSIVE " + TITLES_CTE + """,
e AS (SELECT a.text AS src, b.text AS dst FROM titles a JOIN titles b ON a.text <> b.text
      WHERE floor(jaro_winkler_similarity(a.text, b.text) * 100) >= 97),
reach AS (SELECT text AS id, text AS hop FROM titles UNION SELECT id, dst FROM reach JOIN e ON src = hop)
SELECT id AS text, min(hop) AS linked_to FROM reach GROUP BY 1"""

# Probabilistic linkage of parts with similar titles

LINK_FIELDS, LINK_LEVELS = ["title", "brand", "size", "price"], [3, 2, 2, 3]


def _compared(spark, d):
    part = table(spark, d, "part")
    title = F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))
    first = F.min(F.struct("p_partkey", "p_brand", "p_size", "p_retailprice")).alias("r")
    records = stage(part.groupBy(title.alias("text")).agg(first).select("text", "r.p_brand", "r.p_size", "r.p_retailprice"), "records")
    pairs = L.fuzzy_pairs(records.select("text"), "jaro_winkler", 90)
    ratio = F.least("a_p_retailprice", "b_p_retailprice") / F.greatest("a_p_retailprice", "b_p_retailprice")
    levels = {
        "title": R.banded_level(F.col("score"), [94, 97]),
        "brand": R.equal_level(F.col("a_p_brand"), F.col("b_p_brand")),
        "size": R.equal_level(F.col("a_p_size"), F.col("b_p_size")),
        "price": R.banded_level(ratio, [0.8, 0.95]),
    }
    return stage(R.compare_records(pairs, records, "text", levels), "compared")


LINKED_CTE = """records AS (SELECT text, r.p_brand, r.p_size, r.p_retailprice FROM (
  SELECT p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) AS text, min_by(part, p_partkey) AS r FROM part GROUP BY 1)),
linked AS (SELECT a.text AS text1, b.text AS text2, floor(jaro_winkler_similarity(a.text, b.text) * 100) AS score,
  CAST(a.p_brand = b.p_brand AS INT) AS brand, CAST(a.p_size = b.p_size AS INT) AS size,
  least(a.p_retailprice, b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) AS ratio
  FROM records a JOIN records b ON a.text < b.text WHERE floor(jaro_winkler_similarity(a.text, b.text) * 100) >= 90),
compared AS (SELECT text1, text2, CAST(score >= 94 AS INT) + CAST(score >= 97 AS INT) AS title, brand, size,
  CAST(ratio >= 0.8 AS INT) + CAST(ratio >= 0.95 AS INT) AS price FROM linked)"""
Q["linkage_weights"] = lambda spark, d: R.pattern_counts(_compared(spark, d), LINK_FIELDS)
SQL["linkage_weights"] = cte(LINKED_CTE) + "SELECT title, brand, size, price, count(*) AS n_pairs FROM compared GROUP BY ALL"


def linkage_matches(spark, d):
    found, _ = R.match_records(_compared(spark, d), LINK_FIELDS, LINK_LEVELS, least=0.8)
    return found.select("text1", "text2", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


Q["linkage_matches"] = linkage_matches

# The same by the routes that only large inputs take otherwise.
Q["fuzzy_blocked"] = lambda spark, d: L.fuzzy_pairs(titles(spark, d), "jaro_winkler", 94, block_rows=8)
SQL["fuzzy_blocked"] = SQL["jaro_winkler_pairs"]


def components_distributed(spark, d):
    from catalign.operators.components import connected_components

    part = table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").alias("id"))
    edges = part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("bigint").alias("dst")).filter("src % 7 <> 0 and dst > 0")
    return connected_components(nodes, edges, single_task_edges=0)


Q["components_distributed"] = components_distributed
SQL["components_distributed"] = """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey % 7 <> 0 AND p_partkey // 2 > 0),
nodes AS (SELECT p_partkey AS id FROM part UNION SELECT dst FROM e),
climb AS (SELECT id, id AS top FROM nodes UNION ALL SELECT id, dst FROM climb JOIN e ON src = top)
SELECT id, min(top) AS component FROM climb WHERE id IN (SELECT p_partkey FROM part) GROUP BY 1"""

Q["rank_distributed"] = lambda spark, d: global_rank(
    table(spark, d, "part").select("p_partkey", "p_name"), [F.col("p_name").desc(), F.col("p_partkey")], "nth", single_task_rows=50
)
SQL["rank_distributed"] = """
SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_name DESC, p_partkey) - 1 AS BIGINT) AS nth FROM part"""
