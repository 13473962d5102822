"""Numeric profiles, units of measure and standardized values."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalign.functions import measures as M
from catalign.operators import profile as N
from catalign.operators import schema as S
from catalign.operators import sketches as K
from catalign.operators import standardize as V
from catalign.operators import unit_expressions as X
from catalign.operators import units as U
from catalign.runtime import stage
from suite.param_queries import LINES_CTE, staged_lines
from suite.unit_sql import UNITS_CTE, cleaned, context_sql, known, rule_sql, validity_cte
from suite.views import ATTRIBUTES, CATALOG_CTE, cte, table

Q, SQL = {}, {}

MEASURED = ["weight_kg", "weight", "dimensions", "power"]


def grouped_lines(spark, d):
    """The large catalogue with groups; every 17th row has no category."""
    df = staged_lines(spark, d, "row_id", "product_name", "category", *ATTRIBUTES)
    return df.select("*", F.when(F.col("row_id") % 17 != 0, F.col("category")).alias("group_name"))


GROUPED_CTE = "grouped AS (SELECT *, CASE WHEN row_id % 17 <> 0 THEN category END AS group_name FROM clean)"
LINES = [CATALOG_CTE, LINES_CTE, GROUPED_CTE]


def quoted_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def cells_cte(columns):
    return f"""cells AS (SELECT row_id, group_name, product_name, column_name, value FROM
  (UNPIVOT (SELECT row_id, group_name, product_name, {", ".join(columns)} FROM grouped) ON {", ".join(columns)}
   INTO NAME column_name VALUE value))"""


LETTERS = "[a-zA-Zа-яё°\"''\\s]"
NUM = "[0-9]+\\.?[0-9]*"
VALUE_RE = f"({NUM})\\s*({LETTERS}*)"


SPACE = r"(?:  |\x{A0}\x{A0})"


def amount_re(space=SPACE):
    """Amounts; ``space`` is what stands between groups of thousands, and before a fraction."""
    return (
        f"[-+−]?(?:(?:[0-9]+{space})?[0-9]+/[0-9]+|[1-9][0-9]{{0,2}}(?:{space}[0-9]{{3}})+(?:[.,][0-9]+)?"
        "|[1-9][0-9]{0,2}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[1-9][0-9]{0,2}(?:\\.[0-9]{3})+,[0-9]+"
        "|[1-9][0-9]{0,2}(?:\\.[0-9]{3}){2,}|[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    )


UNIT_WORD = "[a-zA-Zа-яА-ЯёЁ°µΩ%\"'']+(?:[²³]|\\^?-?[1-9])?"
UNIT_RE = f"{UNIT_WORD}(?:[/·*]{UNIT_WORD})*"
BEFORE = "(?:^|[^\\p{L}\\p{N}_.,/+\\-–—−\\x{E000}])"
AFTER = "(?:$|[^\\p{L}\\p{N}_²³/^·*])"
SINGLE = "a-zа-яё°\"''"


def doubled(text):
    """This engine can't look around a match. So characters that may end one quantity and begin the next are written
    twice, and a dash before a space in a range becomes a mark that nothing may follow."""
    marked = text
    for _ in range(2):
        marked = f"regexp_replace({marked}, '([0-9])\\s?[-–—]\\s([0-9])', '\\1\ue000\\2', 'g')"
    return f"""regexp_replace({marked}, '([^\\p{{L}}\\p{{N}}_.,/+\\-–—−\\x{{E000}}²³^·*°µΩ%"''])', '\\1\\1', 'g')"""


def single(text):
    out = text
    for c in ("' '", "chr(160)", "chr(10)", "chr(9)", "chr(13)", "chr(12)"):
        out = f"replace({out}, {c} || {c}, {c})"
    return out


def number_sql(n):
    """An amount as a plain number."""
    fraction = "'^([-+]?)(?:([0-9]+) )?([0-9]+)/([0-9]+)$'"
    part = lambda i: f"regexp_extract({n}, {fraction}, {i})"
    value = f"(CASE WHEN {part(1)} = '-' THEN -1 ELSE 1 END) * (coalesce(TRY_CAST({part(2)} AS DOUBLE), 0) + TRY_CAST({part(3)} AS DOUBLE) / nullif(TRY_CAST({part(4)} AS DOUBLE), 0))"
    return f"""ltrim(CASE WHEN contains({n}, '/') THEN regexp_replace(CAST({value} AS VARCHAR), '\\.0$', '')
  WHEN contains({n}, ' ') THEN replace(replace({n}, ' ', ''), ',', '.')
  WHEN regexp_matches({n}, '^[-+]?[1-9][0-9]{{0,2}}(,[0-9]{{3}})+(\\.[0-9]+)?$') THEN replace({n}, ',', '')
  WHEN regexp_matches({n}, '^[-+]?[1-9][0-9]{{0,2}}((\\.[0-9]{{3}})+,[0-9]+|(\\.[0-9]{{3}}){{2,}})$') THEN replace(replace({n}, '.', ''), ',', '.')
  ELSE replace({n}, ',', '.') END, '+')"""


def extraction_ctes(source, key, value):
    """``found``: all extractions of a text column, quantities before patterns."""
    word = f"{BEFORE}({amount_re()})(\\s+|-|)({UNIT_RE}){AFTER}"
    pattern = f"{BEFORE}({amount_re()})\\s*([{SINGLE}](?:[{SINGLE}\\s]*[{SINGLE}])?){AFTER}"
    tidy = lambda n: f"replace(replace({single(n)}, chr(160), ' '), '−', '-')"
    return f"""raw_q AS (SELECT {key}, k, {number_sql("n")} AS number, raw FROM (
  SELECT {key}, i AS k, {tidy("number")} AS n, raw FROM (
  SELECT {key}, unnest(regexp_extract_all(t, '{word}', 1)) AS number, unnest(regexp_extract_all(t, '{word}', 2)) AS sep,
         unnest(regexp_extract_all(t, '{word}', 3)) AS raw, generate_subscripts(regexp_extract_all(t, '{word}', 1), 1) AS i
  FROM (SELECT {key}, {doubled(value)} AS t FROM {source}))
  WHERE NOT (sep = '' AND regexp_matches(raw, '^[Kb]([^\\p{{L}}]|$)')) AND NOT regexp_matches(raw, '^x[0-9]'))
  WHERE CAST({number_sql("n")} AS DOUBLE) <> 0),
raw_p AS (SELECT {key}, k, {number_sql("n")} AS number, raw FROM (
  SELECT {key}, i AS k, {tidy("number")} AS n, trim({single("raw")}) AS raw FROM (
  SELECT {key}, unnest(regexp_extract_all(t, '{pattern}', 1)) AS number, unnest(regexp_extract_all(t, '{pattern}', 2)) AS raw,
         generate_subscripts(regexp_extract_all(t, '{pattern}', 1), 1) AS i FROM (SELECT {key}, {doubled(f"lower({value})")} AS t FROM {source})))
  WHERE length(raw) BETWEEN 1 AND 19 AND {number_sql("n")} IS NOT NULL),
raws AS (SELECT raw FROM raw_q UNION SELECT raw FROM raw_p),
{validity_cte("raws")},
found AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY part, k) - 1 AS INT) AS pos, number,
  raw AS raw_unit, coalesce(canonical, raw) AS unit,
  coalesce(dimension, CASE part WHEN 0 THEN '' ELSE 'unknown' END) AS dimension,
  CAST(CASE WHEN part = 0 THEN CASE WHEN how = 'exact' THEN 0.95 ELSE 0.8 END
       WHEN how = 'exact' THEN 0.9 WHEN how = 'fuzzy' THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence,
  CASE part WHEN 0 THEN 'quantity' ELSE 'pattern' END || CASE WHEN how IS NULL THEN '' ELSE '_known' END AS method,
  how IS NOT NULL AS is_valid
FROM (SELECT *, 0 AS part FROM raw_q UNION ALL SELECT *, 1 AS part FROM raw_p) LEFT JOIN valid USING (raw))"""


# Profiles


def _text_profile(profile):
    return profile.select(
        "column_name", "total_values", "analyzed_values", "numeric_count", "numeric_percentage", "has_numeric", "avg_value",
        F.array_join("first_numbers", " ").alias("first_numbers"),
        F.array_join(
            F.transform("units_found", lambda u: F.concat(u["unit"], F.lit(":"), u["n"].cast("string"))), ", "
        ).alias("units_found"),
    )


def sample_cte(columns, n):
    limit = f"QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY row_id) <= {n}" if n else ""
    return cells_cte(columns) + f""",
totals AS (SELECT column_name, count(*) AS total_values FROM cells GROUP BY 1),
samples AS (SELECT * FROM cells {limit}),
pairs AS (SELECT column_name, row_id, i AS k, number, trim(unit) AS unit FROM (
  SELECT column_name, row_id, unnest(regexp_extract_all(trim(value), '{VALUE_RE}', 1)) AS number,
         unnest(regexp_extract_all(trim(value), '{VALUE_RE}', 2)) AS unit,
         generate_subscripts(regexp_extract_all(trim(value), '{VALUE_RE}', 1), 1) AS i FROM samples)),
unit_counts AS (SELECT column_name, unit, count(*) AS n,
  row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, min(row_id * 1000 + k)) AS rank
  FROM pairs WHERE unit <> '' AND length(unit) < 15 AND lower(unit) NOT IN ('x', '-', ':')
    AND regexp_matches(unit, '[a-zA-Zа-яё]') GROUP BY 1, 2),
profile AS (SELECT s.column_name, any_value(total_values) AS total_values, count(*) AS analyzed_values,
  count(*) FILTER (regexp_matches(trim(value), '{NUM}')) AS numeric_count FROM samples s JOIN totals USING (column_name) GROUP BY 1)"""


PROFILE_SELECT = """
SELECT p.*, round(numeric_count / analyzed_values * 100, 4) AS numeric_percentage,
  numeric_count / analyzed_values * 100 > 20 AS has_numeric,
  coalesce((SELECT round(avg(CAST(number AS DOUBLE)), 4) FROM pairs q WHERE q.column_name = p.column_name), 0.0) AS avg_value,
  coalesce((SELECT string_agg(number, ' ' ORDER BY row_id, k) FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY row_id, k) AS rn
     FROM pairs) q WHERE q.column_name = p.column_name AND rn <= 10), '') AS first_numbers,
  coalesce((SELECT string_agg(unit || ':' || n, ', ' ORDER BY rank) FROM unit_counts u
     WHERE u.column_name = p.column_name AND rank <= 5), '') AS units_found
FROM profile p"""

Q["numeric_profile"] = lambda spark, d: _text_profile(N.numeric_profile(grouped_lines(spark, d), ATTRIBUTES))
SQL["numeric_profile"] = cte(*LINES, sample_cte(ATTRIBUTES, 50)) + PROFILE_SELECT

Q["numeric_profile_all_rows"] = lambda spark, d: _text_profile(
    N.numeric_profile(grouped_lines(spark, d), MEASURED, n=None)
)
SQL["numeric_profile_all_rows"] = cte(*LINES, sample_cte(MEASURED, None)) + PROFILE_SELECT

Q["numeric_columns"] = lambda spark, d: _text_profile(
    N.numeric_columns(N.numeric_profile(grouped_lines(spark, d), ATTRIBUTES))
).select("column_name", "numeric_count")
SQL["numeric_columns"] = cte(*LINES, sample_cte(ATTRIBUTES, 50)) + """
SELECT column_name, numeric_count FROM profile WHERE numeric_count / analyzed_values * 100 > 20"""

Q["unit_topk"] = lambda spark, d: N.top_units(
    N.extracted_pairs(N.column_samples(grouped_lines(spark, d), MEASURED, None)), 5
)
SQL["unit_topk"] = cte(*LINES, sample_cte(MEASURED, None)) + """
SELECT column_name, unit, n, CAST(rank AS INT) AS rank FROM unit_counts WHERE rank <= 5"""

Q["number_unit_pairs"] = lambda spark, d: N.extracted_pairs(
    table(spark, d, "documents").select(
        F.lit("text").alias("column_name"), F.col("doc_id").alias("row_id"), F.col("text").alias("value")
    )
)
SQL["number_unit_pairs"] = f"""
SELECT 'text' AS column_name, doc_id AS row_id, CAST(i - 1 AS INT) AS pos, number,
  CASE WHEN trim(unit) <> '' AND length(trim(unit)) < 15 AND lower(trim(unit)) NOT IN ('x', '-', ':')
        AND regexp_matches(trim(unit), '[a-zA-Zа-яё]') THEN trim(unit) END AS unit
FROM (SELECT doc_id, unnest(regexp_extract_all(trim(text), '{VALUE_RE}', 1)) AS number,
  unnest(regexp_extract_all(trim(text), '{VALUE_RE}', 2)) AS unit,
  generate_subscripts(regexp_extract_all(trim(text), '{VALUE_RE}', 1), 1) AS i FROM documents)"""

Q["profile_report"] = lambda spark, d: N.profile_report(N.numeric_profile(grouped_lines(spark, d), ATTRIBUTES))
SQL["profile_report"] = cte(*LINES, sample_cte(ATTRIBUTES, 50)) + f""", full_profile AS ({PROFILE_SELECT})
SELECT column_name, total_values, analyzed_values, numeric_count,
  printf('%.1f%%', numeric_percentage) AS numeric_share,
  coalesce((SELECT string_agg(unit, ', ' ORDER BY rank) FROM unit_counts u WHERE u.column_name = f.column_name AND rank <= 3), '') AS units,
  array_to_string(list_filter(string_split(first_numbers, ' ')[1:3], lambda x: x <> ''), ', ') AS numbers,
  coalesce((SELECT CASE WHEN avg(CAST(number AS DOUBLE)) > 0 THEN printf('%.2f', avg(CAST(number AS DOUBLE))) END FROM pairs q
    WHERE q.column_name = f.column_name), '-') AS mean FROM full_profile f"""

def profile_sketches(spark, d):
    """Quantile sketches of each source's numbers, merged, against the exact ranks of the whole columns."""
    lines = staged_lines(spark, d, "row_id", "source_file", *MEASURED)
    numbers = stage(K.column_numbers(lines, MEASURED), "numbers")
    merged = stage(K.merge_profiles(stage(K.sketch_profiles(numbers), "sketches"), [0.25, 0.5, 0.75]), "merged")
    cuts = merged.select("column_name", "n", "n_sources", F.posexplode("quantiles")).withColumn("rank", (F.col("pos") + 1) / 4)
    # Equal numbers share a range of ranks; the wanted one must be within the error of it.
    at = numbers.join(F.broadcast(cuts.select("column_name", F.col("col").alias("cut"), "rank")), "column_name").groupBy("column_name", "rank").agg(
        (F.count_if(F.col("number") < F.col("cut")) / F.count("*")).alias("low"), (F.count_if(F.col("number") <= F.col("cut")) / F.count("*")).alias("high")
    )
    near = (F.col("low") - K.rank_error() <= F.col("rank")) & (F.col("rank") <= F.col("high") + K.rank_error())
    ok = at.groupBy("column_name").agg(F.bool_and(near).alias("within"))
    return merged.join(ok, "column_name").select("column_name", "n", "n_sources", "min_value", "max_value", F.round("mean_value", 6).alias("mean_value"), "within")


Q["profile_sketches"] = profile_sketches
SQL["profile_sketches"] = cte(*LINES) + f""",
cells AS (SELECT source_file, column_name, value FROM (UNPIVOT (SELECT source_file, {", ".join(MEASURED)} FROM clean)
  ON {", ".join(MEASURED)} INTO NAME column_name VALUE value)),
numbers AS (SELECT source_file, column_name, CAST(unnest(regexp_extract_all(trim(value), '{NUM}')) AS DOUBLE) AS number FROM cells)
SELECT column_name, count(*) AS n, count(DISTINCT source_file) AS n_sources, min(number) AS min_value, max(number) AS max_value,
  round(avg(number), 6) AS mean_value, true AS within FROM numbers GROUP BY 1"""

Q["value_samples"] = lambda spark, d: N.value_samples(
    grouped_lines(spark, d).withColumnRenamed("power", "power (W)"), ["weight", "power", "vendor"]
)
SQL["value_samples"] = cte(*LINES, cells_cte(["weight", "power", "vendor"])) + """
SELECT CASE column_name WHEN 'power' THEN 'power (W)' ELSE column_name END AS column_name,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY row_id) AS INT) AS rn, value FROM cells
QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY row_id) <= 10"""

Q["extended_profile"] = lambda spark, d: N.extended_profile(grouped_lines(spark, d), ATTRIBUTES)


def tops_sql(column, k):
    return f"""(SELECT string_agg(key || ':' || n, ', ' ORDER BY n DESC, seen) FROM (
  SELECT column_name, {column} AS key, count(*) AS n, min(row_id * 1000 + pos) AS seen,
    row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, min(row_id * 1000 + pos)) AS rank
  FROM found WHERE confidence >= 0.7 AND {column} <> '' GROUP BY 1, 2) t WHERE t.column_name = s.column_name AND rank <= {k})"""


SQL["extended_profile"] = cte(
    *LINES, UNITS_CTE, sample_cte(ATTRIBUTES, 20), extraction_ctes("samples", "column_name, row_id", "value")
) + f"""
SELECT s.column_name, any_value(total_values) AS total_values, any_value(n) AS analyzed_values,
  count(f.row_id) AS total_extractions, count(*) FILTER (method LIKE 'quantity%') AS quantity_extractions,
  count(*) FILTER (method LIKE 'pattern%') AS pattern_extractions, count(*) FILTER (is_valid) AS valid_units,
  count(*) FILTER (confidence >= 0.7) AS numeric_count,
  min(CAST(number AS DOUBLE)) FILTER (confidence >= 0.7) AS min_value,
  max(CAST(number AS DOUBLE)) FILTER (confidence >= 0.7) AS max_value,
  round(avg(CAST(number AS DOUBLE)) FILTER (confidence >= 0.7), 4) AS mean_value,
  {tops_sql("unit", 10)} AS units_found, {tops_sql("dimension", 5)} AS dimensions_found
FROM (SELECT column_name, count(*) AS n, any_value(total_values) AS total_values FROM samples JOIN totals USING (column_name) GROUP BY 1) s
LEFT JOIN found f USING (column_name) GROUP BY s.column_name"""

# Units


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


Q["quantity_extract"] = lambda spark, d: U.extraction_rows(_documents(spark, d), "text", ["doc_id"])
SQL["quantity_extract"] = cte(UNITS_CTE, extraction_ctes("documents", "doc_id", "text")) + "SELECT * FROM found"

Q["quantity_extract_patterns_only"] = lambda spark, d: U.extraction_rows(
    _documents(spark, d), "text", ["doc_id"], quantities=False
).drop("pos")
SQL["quantity_extract_patterns_only"] = (
    cte(UNITS_CTE, extraction_ctes("documents", "doc_id", "text"))
    + "SELECT * EXCLUDE (pos) FROM found WHERE method LIKE 'pattern%'"
)

Q["confident_extractions"] = lambda spark, d: (
    _documents(spark, d)
    .select("doc_id", F.explode(M.confident(M.all_extractions(F.col("text")))).alias("e"))
    .select("doc_id", "e.number", "e.unit", "e.dimension", "e.confidence")
)
SQL["confident_extractions"] = cte(UNITS_CTE, extraction_ctes("documents", "doc_id", "text")) + """
SELECT doc_id, number, unit, dimension, confidence FROM found WHERE confidence >= 0.7"""

Q["unit_tokens"] = lambda spark, d: U.unit_tokens(table(spark, d, "documents"), "text")
SQL["unit_tokens"] = cte(
    UNITS_CTE,
    f"""tokens AS (SELECT trim(u) AS raw, count(*) AS n_rows FROM (
  SELECT unnest(regexp_extract_all(lower(text), '{NUM}\\s*({LETTERS}+)', 1)) AS u FROM documents) WHERE trim(u) <> '' GROUP BY 1)""",
    validity_cte("tokens"),
) + """
SELECT raw AS unit, n_rows, canonical, dimension, coalesce(how, 'none') AS how FROM tokens LEFT JOIN valid USING (raw)"""

Q["unit_validate"] = lambda spark, d: (
    N.extracted_pairs(N.column_samples(grouped_lines(spark, d), MEASURED, None))
    .filter("unit IS NOT NULL")
    .withColumn("u", M.find_unit(M.clean_unit(F.col("unit"))))
    .groupBy("column_name", "unit", "u.canonical", "u.dimension", "u.factor")
    .agg(F.count(F.lit(1)).alias("n"))
)
SQL["unit_validate"] = cte(*LINES, UNITS_CTE, sample_cte(MEASURED, None)) + """
SELECT column_name, unit, coalesce(u.canonical, l.canonical) AS canonical, coalesce(u.dimension, l.dimension) AS dimension,
  coalesce(u.factor, l.factor) AS factor, count(*) AS n
FROM pairs LEFT JOIN units u ON u.alias = """ + cleaned("unit") + " LEFT JOIN lowered l ON l.alias = lower(" + cleaned("unit") + """)
WHERE unit <> '' AND length(unit) < 15 AND lower(unit) NOT IN ('x', '-', ':') AND regexp_matches(unit, '[a-zA-Zа-яё]')
GROUP BY 1, 2, 3, 4, 5"""

# Units as written, and what they are: case decides, and an unknown word stays what it is.
KNOWN_UNITS = [
    ("mAh", "milliampere_hour", "charge"), ("GHz", "gigahertz", "frequency"), ("MB", "megabyte", "information"),
    ("Mb", "megabit", "information"), ("TB", "terabyte", "information"), ("rpm", "revolution_per_minute", "rotation"),
    ("lbs", "pound", "mass"), ("oz", "ounce", "mass"), ("ml", "milliliter", "volume"), ("cl", "centiliter", "volume"),
    ("MP", "megapixel", "pixel"), ("mW", "milliwatt", "power"), ("MW", "megawatt", "power"), ("KG", "kilogram", "mass"),
    ("°C", "degree_Celsius", "temperature"), ("%", "percent", "dimensionless"), ("кг", "kilogram", "mass"),
    ("Вт", "watt", "power"), ("мм", "millimeter", "length"), ("ft", "foot", "length"), ("min", "minute", "time"),
    ("hours", "hour", "time"), ("ms", "millisecond", "time"),
]
UNKNOWN_UNITS = ["items", "example", "e", "b c", "bed", "minor", "format", "rated", "USB", "x", "gb-lan cable"]


def _unit_texts(spark, d, texts):
    """Every part with its size in one of these units."""
    picked = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts)).cast("int"))
    return table(spark, d, "part").select("p_partkey", "p_size", picked.alias("unit_text"))


Q["unit_lookup_exact"] = lambda spark, d: (
    _unit_texts(spark, d, [u for u, _, _ in KNOWN_UNITS])
    .withColumn("v", M.validate_unit(F.col("unit_text")))
    .select("p_partkey", "unit_text", "v.canonical", "v.dimension", "v.how")
)
SQL["unit_lookup_exact"] = f"""
SELECT p_partkey, {quoted_list(u for u, _, _ in KNOWN_UNITS)}[p_partkey % {len(KNOWN_UNITS)} + 1] AS unit_text,
  {quoted_list(c for _, c, _ in KNOWN_UNITS)}[p_partkey % {len(KNOWN_UNITS)} + 1] AS canonical,
  {quoted_list(m for _, _, m in KNOWN_UNITS)}[p_partkey % {len(KNOWN_UNITS)} + 1] AS dimension, 'exact' AS how FROM part"""

Q["unit_lookup_unknown"] = lambda spark, d: (
    _unit_texts(spark, d, UNKNOWN_UNITS)
    .withColumn("v", M.validate_unit(F.col("unit_text")))
    .select("p_partkey", "unit_text", F.col("v").isNotNull().alias("known"))
)
SQL["unit_lookup_unknown"] = f"""
SELECT p_partkey, {quoted_list(UNKNOWN_UNITS)}[p_partkey % {len(UNKNOWN_UNITS)} + 1] AS unit_text, false AS known FROM part"""

BEST_UNITS = [
    (" mAh", " milliampere_hour"), (".4 GHz", ".4 gigahertz"), (" MB", " megabyte"), (" rpm", " revolution_per_minute"),
    (" lbs", " pound"), ("00 ml", "00 milliliter"), (" items", " items"), (" MP", " megapixel"), (",5 kg", ".5 kilogram"),
    (",500 kg", "500 kilogram"), ("  W", " watt"),
]


def standardize_best_units(spark, d):
    texts = _unit_texts(spark, d, [t for t, _ in BEST_UNITS]).withColumn("v", F.concat(F.col("p_size").cast("string"), "unit_text"))
    none = F.lit(None).cast("string")
    return texts.select("p_partkey", F.col("v").alias("value"), M.standardize_best(F.col("v"), none).alias("standard"))


Q["standardize_best_units"] = standardize_best_units
SQL["standardize_best_units"] = f"""
SELECT p_partkey, p_size || {quoted_list(t for t, _ in BEST_UNITS)}[p_partkey % {len(BEST_UNITS)} + 1] AS value,
  p_size || {quoted_list(t for _, t in BEST_UNITS)}[p_partkey % {len(BEST_UNITS)} + 1] AS standard FROM part"""

Q["extract_without_validation"] = lambda spark, d: (
    _documents(spark, d)
    .select("doc_id", F.posexplode(M.all_extractions(F.col("text"), validate=False)))
    .select("doc_id", "pos", "col.number", "col.unit", "col.confidence", "col.method", "col.is_valid")
)
SQL["extract_without_validation"] = cte(UNITS_CTE, extraction_ctes("documents", "doc_id", "text")) + """
SELECT doc_id, pos, number, raw_unit AS unit, CASE WHEN method LIKE 'quantity%' THEN 0.8 ELSE 0.4 END::DOUBLE AS confidence,
  string_split(method, '_')[1] AS method, false AS is_valid FROM found"""

# What becomes of values that are easily misread, worked out by hand: (value, amounts and units found, standard form).
READINGS = [
    ("1,234.5 kg", "1234.5 kilogram", "1234.5 kilogram"), ("1.234,5 kg", "1234.5 kilogram", "1234.5 kilogram"),
    ("10 000 mm", "10000 millimeter", "10000 millimeter"), ("1 1/2 in", "1.5 inch", "1.5 inch"), ("3/4 in", "0.75 inch", "0.75 inch"),
    ("1e3 W", "1e3 watt", "1e3 watt"), ("-5 °C", "-5 degree_Celsius", "-5 degree_Celsius"), ("1.2.3 kg", "", "1.2.3 kg"),
    ("100 km/h", "100 km/h", "100 km/h"), ("12 m²", "12 m²", "12 m²"), ("5 g/cm3", "5 g/cm3", "5 g/cm3"),
    ("30 Nm", "30 newton_meter", "30 newton_meter"), ("802.11b", "", "802.11b"), ("7 in 1", "7 inch", "7 in 1"), ("4K", "", "4K"),
    ("50-60 Hz", "", "50-60 Hz"), ("50 - 60 Hz", "", "50 - 60 Hz"), ("15-inch", "15 inch", "15 inch"), ("2x4 cm", "", "2x4 cm"),
    ("0,500 kg", "0.500 kilogram", "0.500 kilogram"), ("1,500 kg", "1500 kilogram", "1500 kilogram"), ("1.500 kg", "1.500 kilogram", "1.500 kilogram"),
    ("1.234.567 g", "1234567 gram", "1234567 gram"), ("5 kg, 3 W", "5 kilogram; 3 watt", "5 kg, 3 W"), ("3/0 kg", "", "3/0 kg"),
    ("4 K", "4 kelvin", "4 kelvin"), ("1 234,5 kg", "1234.5 kilogram", "1234.5 kilogram"), ("kg", "", "kg"), ("5 kg.", "5 kilogram", "5 kilogram"),
    ("+12 V", "12 volt", "12 volt"), ("5 кг", "5 kilogram", "5 kilogram"), ("7", "", "7 pcs"), ("1/2", "", "0.5 pcs"), ("12,5", "", "12.5 pcs"),
]


def quantity_values(spark, d):
    rows = _unit_texts(spark, d, [v for v, _, _ in READINGS])
    found = F.transform(M.quantity_extractions(F.col("unit_text")), lambda e: F.concat_ws(" ", e["number"], e["unit"]))
    return rows.select(
        "p_partkey",
        F.col("unit_text").alias("value"),
        F.array_join(found, "; ").alias("found"),
        M.standardize_best(F.col("unit_text"), F.lit("pcs")).alias("standard"),
    )


Q["quantity_values"] = quantity_values
SQL["quantity_values"] = "SELECT p_partkey, " + ", ".join(
    f"{quoted_list(r[i] for r in READINGS)}[p_partkey % {len(READINGS)} + 1] AS {c}" for i, c in enumerate(("value", "found", "standard"))
) + " FROM part"

# Unit texts with canonical form, dimension, and what one of them is in base units, worked out by hand.
EXPRESSIONS = [
    ("km/h", "kilometer / hour", "[length] / [time]", 1000 / 3600, "meter / second"),
    ("m/s", "meter / second", "[length] / [time]", 1.0, "meter / second"),
    ("m²", "meter ** 2", "[length] ** 2", 1.0, "meter ** 2"),
    ("cm^3", "centimeter ** 3", "volume", 1e-6, "meter ** 3"),
    ("W/m2", "watt / meter ** 2", "[mass] / [time] ** 3", 1.0, "kilogram / second ** 3"),
    ("g/cm3", "gram / centimeter ** 3", "[mass] / [length] ** 3", 1000.0, "kilogram / meter ** 3"),
    ("Nm", "newton_meter", "energy", 1.0, "kilogram * meter ** 2 / second ** 2"),
    ("N*m", "meter * newton", "energy", 1.0, "kilogram * meter ** 2 / second ** 2"),
    ("cd/m2", "candela / meter ** 2", "[luminosity] / [length] ** 2", 1.0, "candela / meter ** 2"),
    ("W/(m*K)", "watt / kelvin / meter", "[length] * [mass] / [temperature] / [time] ** 3", 1.0, "kilogram * meter / kelvin / second ** 3"),
    ("l/100km", "liter / kilometer", "[length] ** 2", 1e-8, "meter ** 2"),
    ("kWh/day", "kilowatt_hour / day", "power", 3.6e6 / 86400, "kilogram * meter ** 2 / second ** 3"),
    ("kg m s^-2", "kilogram * meter / second ** 2", "force", 1.0, "kilogram * meter / second ** 2"),
    ("miles per hour", "mile / hour", "[length] / [time]", 1609.344 / 3600, "meter / second"),
    ("MB/s", "megabyte / second", "[information] / [time]", 1e-3, "gigabyte / second"),
    ("m/m", "dimensionless", "dimensionless", 1.0, "one"),
    ("mW", "milliwatt", "power", 1e-3, "kilogram * meter ** 2 / second ** 3"),
    ("кг/л", "kilogram / liter", "[mass] / [length] ** 3", 1000.0, "kilogram / meter ** 3"),
]
NO_EXPRESSIONS = ["foo/bar", "m//s", "kg/", "100", "m^", "km/parsec"]


def _expression_rows(spark, d):
    return _unit_texts(spark, d, [e[0] for e in EXPRESSIONS] + NO_EXPRESSIONS)


def unit_expressions(spark, d):
    known = X.unit_expressions(_expression_rows(spark, d), "unit_text")
    return _expression_rows(spark, d).groupBy("unit_text").count().join(known, "unit_text").select(
        "unit_text", F.col("count").alias("n_rows"), "canonical", "dimension", F.round("factor", 12).alias("factor"), "base_unit"
    )


def expressions_cte():
    texts = [e[0] for e in EXPRESSIONS] + NO_EXPRESSIONS
    rows = ", ".join(f"('{t}', '{c}', '{m}', CAST({f!r} AS DOUBLE), '{b}')" for t, c, m, f, b in EXPRESSIONS)
    return f"""texts AS (SELECT p_partkey, p_size, {quoted_list(texts)}[p_partkey % {len(texts)} + 1] AS unit_text FROM part),
expressions AS (SELECT * FROM (VALUES {rows}) t(unit_text, canonical, dimension, factor, base_unit))"""


Q["unit_expressions"] = unit_expressions
SQL["unit_expressions"] = cte(expressions_cte()) + """
SELECT unit_text, count(*) AS n_rows, canonical, dimension, round(factor, 12) AS factor, base_unit
FROM texts JOIN expressions USING (unit_text) GROUP BY ALL"""


def unit_convert_compound(spark, d):
    rows = _expression_rows(spark, d)
    rows = rows.select("p_partkey", F.concat_ws(" ", F.col("p_size").cast("string"), "unit_text").alias("measured"))
    return X.convert_measured(rows, ["measured"], ["p_partkey"]).withColumn("amount", F.round("amount", 9))


Q["unit_convert_compound"] = unit_convert_compound
SQL["unit_convert_compound"] = cte(expressions_cte()) + """
SELECT p_partkey, 'measured' AS column_name, p_size || ' ' || unit_text AS value, round(p_size * factor, 9) AS amount, base_unit, dimension
FROM texts LEFT JOIN expressions USING (unit_text)"""

HEADERS = [
    "Dimensions", "Screen Size (in)", "Screen Resolution", "Weight (kg)", "RAM Size", "max power - kWatt", "Length",
    "photo 1920x1080", "Engine power", "Storage Capacity", "Вес", "Display Type", "Width", "Color", "Noise Level (dB)",
    "Price (USD)",
]


def _headed(spark, d):
    """Documents as product descriptions, each under one of the catalogue's headers."""
    names = F.array(*[F.lit(h) for h in HEADERS])
    return table(spark, d, "documents").select(
        "doc_id", "text", "source", F.get(names, (F.col("doc_id") % len(HEADERS)).cast("int")).alias("header")
    )


HEADED_CTE = f"""headed AS (SELECT doc_id, {quoted_list(HEADERS)}[doc_id % {len(HEADERS)} + 1] AS header,
  lower({quoted_list(HEADERS)}[doc_id % {len(HEADERS)} + 1] || ' ' || text || ' ' || source) AS ctx FROM documents)"""

Q["unit_rules"] = lambda spark, d: _headed(spark, d).select(
    "doc_id", "header", M.rule_unit(F.col("header"), F.col("text"), F.col("source")).alias("unit")
)
SQL["unit_rules"] = cte(HEADED_CTE) + f"SELECT doc_id, header, {rule_sql('header', 'ctx')} AS unit FROM headed"

Q["unit_rules_whole_word"] = lambda spark, d: _headed(spark, d).select(
    "doc_id",
    "header",
    M.rule_unit(F.col("header"), F.col("text"), F.col("source"), whole_word=True).alias("unit"),
)


SQL["unit_rules_whole_word"] = cte(HEADED_CTE) + (
    f"SELECT doc_id, header, {rule_sql('header', 'ctx', whole_word=True)} AS unit FROM headed"
)

Q["context_unit"] = lambda spark, d: _headed(spark, d).select(
    "doc_id", "header", M.context_unit(F.col("header"), F.col("text"), F.col("source")).alias("unit")
)
SQL["context_unit"] = cte(UNITS_CTE, HEADED_CTE) + (
    f"SELECT doc_id, header, {context_sql('header', rule_sql('header', 'ctx'), 'ctx')} AS unit FROM headed"
)


def _measured(spark, d):
    df = grouped_lines(spark, d).withColumnsRenamed({"weight_kg": "Weight (kg)", "dimensions": "box"})
    return U.measurement_types(df, ["Weight (kg)", "weight", "box", "power", "brand"])


Q["measurement_type"] = lambda spark, d: _measured(spark, d).select(
    "column_name", "primary_dimension", F.round("confidence", 4).alias("confidence"),
    F.array_join("common_units", ", ").alias("common_units"), "method", "context_unit",
)
NAMED_CELLS = """cells AS (SELECT row_id, column_name, value FROM (UNPIVOT (
  SELECT row_id, weight_kg AS "Weight (kg)", weight, dimensions AS box, power, brand FROM grouped)
  ON "Weight (kg)", weight, box, power, brand INTO NAME column_name VALUE value)),
samples AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY row_id) <= 20)"""
MEASURE_CTE = f"""named AS (SELECT column_name, count(*) AS n, count(*) FILTER (regexp_matches(value, '{NUM}')) AS n_num,
  {context_sql("column_name", rule_sql("column_name", "lower(column_name)"), "lower(column_name)")} AS context_unit
  FROM samples GROUP BY 1),
context_valid AS (SELECT column_name, coalesce(u.canonical, l.canonical) AS canonical, coalesce(u.dimension, l.dimension) AS dimension
  FROM named LEFT JOIN units u ON u.alias = {cleaned("context_unit")} LEFT JOIN lowered l ON l.alias = lower({cleaned("context_unit")})
  WHERE u.alias IS NOT NULL OR l.alias IS NOT NULL),
flagged AS (SELECT named.*, canonical, dimension, canonical IS NOT NULL AND n_num / n > 0.5 AS by_name
  FROM named LEFT JOIN context_valid USING (column_name)),
votes AS (
  SELECT column_name, 'dimension' AS kind, found.dimension AS key, CASE WHEN is_valid THEN 3 ELSE 1 END AS points, row_id * 1000 + pos AS seen
  FROM found JOIN flagged f USING (column_name) WHERE confidence >= 0.7 AND NOT by_name AND found.dimension NOT IN ('unknown', '')
  UNION ALL SELECT column_name, 'unit', unit, 1, row_id * 1000 + pos FROM found JOIN flagged USING (column_name)
  WHERE confidence >= 0.7 AND NOT by_name AND unit <> ''
  UNION ALL SELECT column_name, 'dimension', dimension, n, -1 FROM flagged WHERE canonical IS NOT NULL
  UNION ALL SELECT column_name, 'unit', canonical, n, -1 FROM flagged WHERE canonical IS NOT NULL),
tally AS (SELECT column_name, kind, key, sum(points) AS points,
  row_number() OVER (PARTITION BY column_name, kind ORDER BY sum(points) DESC, min(seen), key) AS rank FROM votes GROUP BY 1, 2, 3),
measured AS (SELECT f.column_name, coalesce(t.key, 'unknown') AS primary_dimension,
  CAST(CASE WHEN by_name THEN 0.95 ELSE coalesce(t.points / f.n, 0) END AS DOUBLE) AS raw_confidence,
  coalesce((SELECT string_agg(key, ', ' ORDER BY rank) FROM tally u WHERE u.kind = 'unit' AND u.rank <= 3
     AND u.column_name = f.column_name), '') AS common_units,
  CASE WHEN by_name THEN 'context' ELSE 'mixed' END AS method, context_unit
FROM flagged f LEFT JOIN tally t ON t.column_name = f.column_name AND t.kind = 'dimension' AND t.rank = 1)"""
MEASURE = [
    *LINES, UNITS_CTE, NAMED_CELLS, extraction_ctes("samples", "column_name, row_id", "value"), MEASURE_CTE,
]
SQL["measurement_type"] = cte(*MEASURE) + """
SELECT column_name, primary_dimension, round(raw_confidence, 4) AS confidence, common_units, method, context_unit FROM measured"""

Q["detection_success"] = lambda spark, d: U.success_rate(_measured(spark, d))
SQL["detection_success"] = cte(*MEASURE) + """
SELECT count(*) FILTER (raw_confidence > 0) AS successful, count(*) AS total,
  round(count(*) FILTER (raw_confidence > 0) / count(*) * 100, 1) AS success_pct FROM measured"""

Q["low_confidence_columns"] = lambda spark, d: U.low_confidence(_measured(spark, d))
SQL["low_confidence_columns"] = cte(*MEASURE) + """
SELECT column_name, raw_confidence AS confidence FROM measured WHERE raw_confidence < 0.3"""

Q["measurement_report"] = lambda spark, d: U.measurement_report(_measured(spark, d))
SQL["measurement_report"] = cte(*MEASURE) + """
SELECT column_name, primary_dimension AS dimension, printf('%.2f', raw_confidence) AS confidence, common_units AS units,
  (SELECT string_agg(value, ', ' ORDER BY row_id) FROM (SELECT * FROM samples
     QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY row_id) <= 3) s WHERE s.column_name = m.column_name) AS samples,
  method, coalesce(context_unit, 'none') AS context_unit FROM measured m"""

Q["measurement_counts"] = lambda spark, d: U.measurement_counts(_measured(spark, d))
SQL["measurement_counts"] = cte(*MEASURE) + """
SELECT column_name, kind, key, CAST(points AS BIGINT) AS points FROM tally"""

Q["category_units"] = lambda spark, d: U.category_units(grouped_lines(spark, d), MEASURED)
CATEGORY_CTE = f"""heads AS (SELECT group_name, product_name, row_number() OVER (PARTITION BY group_name ORDER BY row_id) AS rn
  FROM grouped WHERE group_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY row_id) <= 3),
head_rows AS (SELECT *, lower(column_name || ' ' || product_name || ' ' || group_name) AS ctx
  FROM heads, (SELECT unnest({quoted_list(MEASURED)}) AS column_name)),
ruled AS (SELECT *, {rule_sql("column_name", "ctx")} AS rule FROM head_rows),
by_rule AS (SELECT group_name, column_name, rule AS unit FROM ruled WHERE rule IS NOT NULL GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY group_name, column_name ORDER BY count(*) DESC, min(rn)) = 1),
by_value AS (SELECT group_name, column_name, unit FROM (
  SELECT group_name, column_name, row_id, trim(regexp_extract(trim(value), '{NUM}\\s*({LETTERS}+)', 1)) AS unit FROM cells
  WHERE group_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_name, column_name ORDER BY row_id) <= 3)
  WHERE unit <> '' AND length(unit) < 10 AND {known("unit")}
  QUALIFY row_number() OVER (PARTITION BY group_name, column_name ORDER BY row_id) = 1),
by_context AS (SELECT group_name, column_name, {context_sql("column_name", "rule", "ctx")} AS unit FROM ruled WHERE rn = 1),
category_units AS (SELECT group_name AS category, column_name, coalesce(r.unit, v.unit, c.unit) AS unit
  FROM by_context c LEFT JOIN by_rule r USING (group_name, column_name) LEFT JOIN by_value v USING (group_name, column_name)
  WHERE coalesce(r.unit, v.unit, c.unit) IS NOT NULL)"""
CATEGORY = [*LINES, UNITS_CTE, cells_cte(MEASURED), CATEGORY_CTE]
SQL["category_units"] = cte(*CATEGORY) + "SELECT * FROM category_units"

Q["default_units"] = lambda spark, d: U.category_units(
    grouped_lines(spark, d).drop("group_name", "category"), ["weight", "power"]
)
SQL["default_units"] = cte(*LINES, UNITS_CTE) + f"""
SELECT 'default' AS category, column_name, unit FROM (
  SELECT column_name, {context_sql("column_name", rule_sql("column_name", "ctx"), "ctx")} AS unit FROM (
    SELECT column_name, lower(column_name || ' ' || product_name) AS ctx
    FROM (SELECT product_name FROM grouped ORDER BY row_id LIMIT 1), (SELECT unnest(['weight', 'power']) AS column_name)))
WHERE unit IS NOT NULL"""

# Standardized values


def _standard(spark, d, mode, fmt="number_unit"):
    return V.standardize_columns(grouped_lines(spark, d), MEASURED, mode=mode, fmt=fmt).select(
        "row_id", "group_name", *MEASURED
    )


def fallback_sql(column):
    context = f"lower('{column} ' || product_name || ' ' || coalesce(group_name, ''))"
    literal = f"'{column}'"
    return f"coalesce(unit_{column}, {context_sql(literal, rule_sql(literal, context), context)})"


def simple_sql(column, fmt="number_unit"):
    number = f"regexp_extract(trim({column}), '{VALUE_RE}', 1)"
    own = f"nullif(trim(regexp_extract(trim({column}), '{VALUE_RE}', 2)), '')"
    unit = f"coalesce({own}, {fallback_sql(column)})"
    text = f"{number} || ' ' || {unit}" if fmt == "number_unit" else f"{unit} || ' ' || {number}"
    return f"""CASE WHEN group_name IS NULL OR {number} = '' OR {unit} IS NULL THEN {column} ELSE {text} END AS {column}"""


WIDE_CTE = "wide_units AS (SELECT category AS group_name, " + ", ".join(
    f"max(unit) FILTER (column_name = '{c}') AS unit_{c}" for c in MEASURED
) + " FROM category_units GROUP BY 1)"

Q["standardize_simple"] = lambda spark, d: _standard(spark, d, "simple")
SQL["standardize_simple"] = cte(*CATEGORY, WIDE_CTE) + "SELECT row_id, group_name, " + ",\n".join(
    simple_sql(c) for c in MEASURED
) + " FROM grouped LEFT JOIN wide_units USING (group_name)"

Q["standardize_unit_first"] = lambda spark, d: _standard(spark, d, "simple", "unit_number")
SQL["standardize_unit_first"] = cte(*CATEGORY, WIDE_CTE) + "SELECT row_id, group_name, " + ",\n".join(
    simple_sql(c, "unit_number") for c in MEASURED
) + " FROM grouped LEFT JOIN wide_units USING (group_name)"



def standardize_without_units(spark, d):
    """No units by category: the rules and the context of each row decide."""
    none = spark.createDataFrame([], "category string, column_name string, unit string")
    return V.standardize_columns(grouped_lines(spark, d), MEASURED, none).select("row_id", "group_name", *MEASURED)


Q["standardize_without_units"] = standardize_without_units
SQL["standardize_without_units"] = cte(*LINES, UNITS_CTE) + "SELECT row_id, group_name, " + ",\n".join(
    simple_sql(c).replace(f"unit_{c}", "NULL") for c in MEASURED
) + " FROM grouped"

Q["standardize_best"] = lambda spark, d: _standard(spark, d, "best")
ONE = r"[ \x{A0}]"
WHOLE = f"^({amount_re(ONE)})(\\s+|-|)({UNIT_RE})(?:[^\\p{{L}}\\p{{N}}_²³/^·*][^0-9]*)?$"
BEST_CTES = f"""split AS (SELECT value, replace(replace(regexp_extract(trim(value), '{WHOLE}', 1), chr(160), ' '), '−', '-') AS n,
  regexp_extract(trim(value), '{WHOLE}', 3) AS raw FROM texts WHERE regexp_matches(trim(value), '{WHOLE}')
  AND NOT (regexp_extract(trim(value), '{WHOLE}', 2) = '' AND regexp_matches(regexp_extract(trim(value), '{WHOLE}', 3), '^[Kb]([^\\p{{L}}]|$)'))),
{validity_cte("split")},
best AS (SELECT value, {number_sql("n")} || ' ' || canonical AS text FROM split JOIN valid USING (raw) WHERE CAST({number_sql("n")} AS DOUBLE) <> 0)"""
SQL["standardize_best"] = cte(*CATEGORY, WIDE_CTE, "texts AS (SELECT DISTINCT value FROM cells)", BEST_CTES) + "SELECT row_id, group_name, " + ",\n".join(
    f"""CASE WHEN group_name IS NULL THEN {c} WHEN regexp_matches(trim({c}), '^{amount_re(ONE)}$')
  THEN coalesce({number_sql(f"trim({c})")} || ' ' || {fallback_sql(c)}, {c})
  ELSE coalesce((SELECT text FROM best b WHERE b.value = {c}), {c}) END AS {c}"""
    for c in MEASURED
) + " FROM grouped LEFT JOIN wide_units USING (group_name)"

HEADER_CTE = f"""first_units AS (SELECT column_name, min_by(unit, category) AS unit FROM category_units GROUP BY 1),
headers AS (SELECT n.column_name, unit, CASE WHEN unit IS NULL OR contains(n.column_name, '(' || unit || ')') THEN n.column_name
  ELSE n.column_name || ' (' || unit || ')' END AS new_name
  FROM (SELECT unnest({quoted_list(MEASURED)}) AS column_name) n LEFT JOIN first_units USING (column_name))"""
Q["header_units"] = lambda spark, d: V.header_units(MEASURED, U.category_units(grouped_lines(spark, d), MEASURED))
SQL["header_units"] = cte(*CATEGORY, HEADER_CTE) + "SELECT * FROM headers"


def header_units_measured(spark, d):
    df = grouped_lines(spark, d).withColumnsRenamed({"weight_kg": "Weight (kg)", "dimensions": "box"})
    columns = ["Weight (kg)", "weight", "box", "power", "brand"]
    return V.header_units(columns, U.category_units(df, columns), U.measurement_types(df, columns)).select(
        "column_name", "new_name"
    )


Q["header_units_measured"] = header_units_measured
SQL["header_units_measured"] = cte(*MEASURE) + """
SELECT column_name, CASE WHEN common_units = '' THEN column_name
  ELSE column_name || ' (' || string_split(common_units, ', ')[1] || ')' END AS new_name FROM measured"""


def _swapped(spark, d):
    df = grouped_lines(spark, d).select("row_id", "product_name", "group_name", *MEASURED)
    units = stage(U.category_units(df, MEASURED), "units")
    headers = V.header_units(MEASURED, units)
    return df, V.standardize_columns(df, MEASURED, units), headers, units


def standardized_table(spark, d):
    _, after, headers, _ = _swapped(spark, d)
    return V.rename_headers(after, headers)


Q["standardized_table"] = standardized_table
SQL["standardized_table"] = cte(*CATEGORY, WIDE_CTE) + """
SELECT row_id, product_name, group_name, weight_kg AS "weight_kg (kg)", weight AS "weight (kg)",
  dimensions AS "dimensions (m)", power AS "power (W)" FROM (SELECT row_id, product_name, group_name, """ + ",\n".join(
    simple_sql(c) for c in MEASURED
) + " FROM grouped LEFT JOIN wide_units USING (group_name))"


def _preview(spark, d):
    df, _, _, units = _swapped(spark, d)
    return V.standardize_preview(df.withColumn("empty", F.lit(None).cast("string")), [*MEASURED, "empty"], units)


PREVIEW_CTE = """standard AS (SELECT row_id, group_name, """ + ",\n".join(
    simple_sql(c).rsplit(" AS ", 1)[0].replace("group_name IS NULL OR ", "") + f" AS {c}" for c in MEASURED
) + """ FROM grouped LEFT JOIN wide_units USING (group_name)),
after_cells AS (SELECT row_id, column_name, value AS after FROM (UNPIVOT standard ON weight_kg, weight, dimensions, power
  INTO NAME column_name VALUE value)),
preview AS (SELECT column_name, value AS before, after, CASE WHEN value = after THEN 'unchanged' ELSE 'changed' END AS state
  FROM cells JOIN after_cells USING (row_id, column_name) WHERE trim(value) <> ''
  QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY row_id) = 1
  UNION ALL SELECT 'empty', NULL, NULL, 'no data')"""
Q["standardize_preview"] = _preview
SQL["standardize_preview"] = cte(*CATEGORY, WIDE_CTE, PREVIEW_CTE) + "SELECT * FROM preview"
Q["standardize_preview_counts"] = lambda spark, d: V.preview_counts(_preview(spark, d))
SQL["standardize_preview_counts"] = cte(*CATEGORY, WIDE_CTE, PREVIEW_CTE) + """
SELECT count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'unchanged') AS unchanged,
       count(*) FILTER (state = 'no data') AS no_data FROM preview"""


def replacement_report(spark, d):
    before, after, headers, _ = _swapped(spark, d)
    return V.replacement_report(before, after, headers, MEASURED)


Q["replacement_report"] = replacement_report
SQL["replacement_report"] = cte(
    *CATEGORY, WIDE_CTE, HEADER_CTE,
    "standard AS (SELECT row_id, " + ",\n".join(simple_sql(c) for c in MEASURED)
    + " FROM grouped LEFT JOIN wide_units USING (group_name))",
    """after_cells AS (SELECT row_id, column_name, value AS standardized FROM (UNPIVOT standard
      ON weight_kg, weight, dimensions, power INTO NAME column_name VALUE value))""",
) + """
SELECT column_name, new_name, CAST(rn AS INT) AS rn, value AS original, standardized FROM (
  SELECT column_name, row_id, value, row_number() OVER (PARTITION BY column_name ORDER BY row_id) AS rn FROM cells) c
JOIN after_cells USING (row_id, column_name) JOIN headers USING (column_name) WHERE rn <= 3"""

Q["unit_convert"] = lambda spark, d: V.convert_units(grouped_lines(spark, d), ["weight", "dimensions", "power"], ["row_id"])
SQL["unit_convert"] = cte(*LINES, UNITS_CTE, cells_cte(["weight", "dimensions", "power"])) + f"""
SELECT row_id, column_name, value, CAST(number AS DOUBLE) * coalesce(u.factor, l.factor) + coalesce(u.off, l.off) AS amount,
  CASE coalesce(u.dimension, l.dimension) WHEN 'mass' THEN 'kilogram' WHEN 'length' THEN 'meter' WHEN 'power' THEN 'watt' END AS base_unit,
  coalesce(u.dimension, l.dimension) AS dimension
FROM (SELECT row_id, column_name, value, regexp_extract(trim(value), '{VALUE_RE}', 1) AS number,
        {cleaned(f"regexp_extract(trim(value), '{VALUE_RE}', 2)")} AS unit FROM cells)
LEFT JOIN units u ON u.alias = unit LEFT JOIN lowered l ON l.alias = lower(unit)
WHERE number <> '' AND (u.alias IS NOT NULL OR l.alias IS NOT NULL)"""
