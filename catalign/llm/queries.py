"""The registered queries of the pipeline operators and the SQL they must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from catalign.llm import (
    backoff_lm,
    bpe,
    centroids,
    decontaminate,
    edit_embedding,
    exact_dedup,
    langid,
    line_dedup,
    minhash,
    resample,
    token_store,
    tool_calls,
    url_filter,
)
from catalign.llm.common import table
from catalign.runtime import checkpoint_root

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "after": ("string", False)},
    "fetch": {"query": ("string", True), "limit": ("number", False), "after": ("string", False)},
}


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds every address that a tracking link of the corpus leads to."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host_path(F.col("url"))
    tracked = pages.filter(F.col("url").contains("?utm_") | F.col("url").contains("&utm_"))
    return url_filter.judge_urls(pages, tracked.select(F.concat(host, path).alias("key")), RULES)


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.compare_and_group(table(spark, sf_dir, "documents"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("log10_score", 6).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


def tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are read as calls whose query is their whole text, user turns as the results of the turn before.

    Every turn gives a row: a user turn with no call before it (as the first one) and system turns are results
    without a call.
    """
    turns = table(spark, sf_dir, "conversations")
    size = F.length("text")
    # {"q":"…"} without its first five characters and the last one.
    quoted = F.expr("coalesce(regexp_extract(to_json(named_struct('q', text)), '(?s)^.{5}(.*).$', 1), 'null')")
    calls = turns.filter("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("call_id"),
        F.element_at(F.array(F.lit("search"), F.lit("fetch"), F.lit("translate")), F.when(size % 11 == 0, 3).otherwise(size % 2 + 1)).alias("name"),
        F.concat(
            F.lit('{"query" : '),
            quoted,
            F.when(size % 5 == 0, F.concat(F.lit(', "limit": "'), size, F.lit('"'))).otherwise(F.concat(F.lit(', "limit": '), size)),
            F.when(size % 3 == 0, F.concat(F.lit(', "after":"$c'), "conv_id", F.lit("_"), F.col("turn") - 2, F.lit('"'))).otherwise(F.lit("")),
            F.when(size % 7 == 0, F.lit(', "debug":true }')).otherwise(F.lit(" }")),
        ).alias("arguments"),
    )
    before = F.when(F.col("role") == "system", F.lit("s")).otherwise((F.col("turn") - 1).cast("string"))
    results = turns.filter("role <> 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), "conv_id", F.lit("_"), before).alias("call_id"), F.col("text").alias("content")
    )
    return tool_calls.link_tool_calls(calls, results, TOOLS).withColumn("level", F.coalesce("level", F.lit(-1)))


def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), "n_chars", F.sha2("text", 256).alias("text_sha256")
    )


def token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex[:16]}"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (langid.fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = F.array(*[F.lit(centroids.centroid_digest(c)) for c in found]).cast("array<string>")
    return placed.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


Q = {
    "op1_url_filter": url_filters,
    "op2_minhash_near_dedup": minhash_near_dedup,
    "op3_decontamination": decontamination,
    "op4_edit_embedding": fingerprints,
    "op5_backoff_scores": lm_scores,
    "op6_tool_call_links": tool_links,
    "op7_fuzzy_line_dedup": fuzzy_lines,
    "op8_token_planes": token_planes,
    "op9_byte_bpe": byte_bpe,
    "op10_language_id": language_id,
    "op11_importance_resampling": importance_resampling,
    "op12_exact_dedup": exact_copies,
    "op13_centroid_clusters": centroid_clusters,
    "pipeline": pipeline,
}

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOWER = FOLD.format("coalesce(text, '')")
BLANK_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
LETTER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _centroid_sql(k: int, rounds: int) -> str:
    """The rounds written out; ``c0``, ``c1``, ... are the centroids, ``a0``, ``a1``, ... the assignments to them."""
    parts = [
        """kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS number, x AS c
  FROM (SELECT x, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT vec_id, any_value(x) AS x, min({{'d': d, 'number': number}}) AS best
  FROM (SELECT vec_id, x, number, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
        FROM kept, c{r}) GROUP BY vec_id
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS (
  SELECT c{r}.number, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT number, list(v ORDER BY i) AS m FROM (
      SELECT best.number AS number, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS v
      FROM a{r}, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY number) u ON c{r}.number = u.number
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, number AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON number = best.number"""


SQL = {
    "op13_centroid_clusters": _centroid_sql(16, 3),
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_importance_resampling": f"""
WITH RECURSIVE crc_bits AS (
  SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS c, 0 AS n FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM crc_bits WHERE n < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE n = 8
), texts AS (
  SELECT doc_id, 0 AS target, {LETTER_WORDS} AS w FROM documents UNION ALL SELECT item_id, 1, {LETTER_WORDS} FROM benchmark
), features AS (
  SELECT doc_id, target, array_to_string(w[i : i + n - 1], ' ') AS f
  FROM (SELECT doc_id, target, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, range(1, 4) AS r(n))
), counted AS (
  SELECT doc_id, target, f, count(*) AS n FROM features GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2),
           lambda i: 16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table
), per_bucket AS (
  SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
           / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM per_bucket
), weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket)
  WHERE target = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) >= 20 AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (doc_id) WHERE target = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, 5 * count(*) FILTER (able) OVER () // 100 AS wanted FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= wanted THEN place END AS rank FROM ranked""",
    "op1_url_filter": rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, {FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), listed AS (
  SELECT DISTINCT host || path AS key FROM parts WHERE contains(url, '?utm_') OR contains(url, '&utm_')
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op2_minhash_near_dedup": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {BLANK_WORDS} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 2 THEN w
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), items AS (
  SELECT doc_id, unnest(s) AS item FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM items x JOIN items y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (len(x.s) + len(y.s) - shared)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON doc_id = a""",
    "op3_decontamination": f"""
WITH doc_words AS (
  SELECT doc_id, {LETTER_WORDS} AS w FROM documents
), item_words AS (
  SELECT item_id, {LETTER_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, item_id, p.size, i FROM places p JOIN windows q ON p.size = q.size AND p.win = q.win
), per_word AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM hits) GROUP BY doc_id
), per_item AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)""",
    "op5_backoff_scores": f"""
WITH words AS (
  SELECT doc_id, {BLANK_WORDS} AS w FROM documents
), tokens AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), ones AS (
  SELECT word, count(*) AS c FROM tokens GROUP BY word
), twos AS (
  SELECT prev, word, count(*) AS c FROM tokens WHERE prev IS NOT NULL GROUP BY ALL
), scored AS (
  SELECT doc_id, CASE WHEN t.prev IS NULL THEN log10(o.c / (SELECT count(*) FROM tokens))
                      WHEN b.c >= 2 THEN log10(b.c / p.c)
                      ELSE log10(0.4) + log10(o.c / (SELECT count(*) FROM tokens)) END AS s
  FROM tokens t JOIN ones o ON t.word = o.word LEFT JOIN twos b ON t.prev = b.prev AND t.word = b.word
  LEFT JOIN ones p ON p.word = t.prev
), sums AS (
  SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(s, 0), 6) AS log10_score,
       CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_log10
FROM words LEFT JOIN sums USING (doc_id)""",
    "op6_tool_call_links": """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'c' || conv_id || '_' || turn AS call_id, length(text) AS n, to_json(text) AS digest,
         CASE WHEN length(text) % 11 = 0 THEN 'translate' WHEN length(text) % 2 = 0 THEN 'search' ELSE 'fetch' END AS name
  FROM conversations WHERE role = 'assistant'
), results AS (
  SELECT conv_id, turn, 'c' || conv_id || '_' || CASE role WHEN 'system' THEN 's' ELSE CAST(turn - 1 AS VARCHAR) END AS call_id,
         to_json(text) AS content
  FROM conversations WHERE role <> 'assistant'
), refs AS (
  SELECT c.*, n % 3 = 0 AS refers, EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2) AS found FROM calls c
), levels AS (
  SELECT conv_id, turn, 0 AS level FROM refs WHERE NOT (refers AND found)
  UNION ALL
  SELECT r.conv_id, r.turn, l.level + 1 FROM refs r JOIN levels l ON r.conv_id = l.conv_id AND r.turn = l.turn + 2 WHERE r.refers AND r.found
), linked AS (
  SELECT r.conv_id, r.call_id, r.turn, r.name, l.level, CASE WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    array_to_string(list_filter(list_concat(
      CASE WHEN r.name = 'translate' THEN ['tool'] ELSE [CASE WHEN n % 5 = 0 THEN 'type:limit' END, CASE WHEN n % 7 = 0 THEN 'unknown:debug' END] END,
      [CASE WHEN refers AND NOT found THEN 'reference:c' || r.conv_id || '_' || (r.turn - 2) END]), lambda x: x IS NOT NULL), ',') AS errors,
    '{"arguments":{' || CASE WHEN refers THEN '"after":"$c' || r.conv_id || '_' || (r.turn - 2) || '",' ELSE '' END
      || CASE WHEN n % 7 = 0 THEN '"debug":true,' ELSE '' END
      || '"limit":' || CASE WHEN n % 5 = 0 THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END || ',"query":' || digest || '},"id":"' || r.call_id
      || '","name":"' || r.name || '"' || CASE WHEN a.call_id IS NULL THEN '' ELSE ',"result":' || content END || '}' AS record
  FROM refs r JOIN levels l USING (conv_id, turn) LEFT JOIN results a ON a.conv_id = r.conv_id AND a.call_id = r.call_id
), orphans AS (
  SELECT conv_id, call_id, turn, NULL AS name, -1 AS level, 'orphan' AS status, NULL AS errors,
         '{"id":"' || call_id || '","result":' || content || '}' AS record
  FROM results a WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = a.conv_id AND c.call_id = a.call_id)
)
SELECT conv_id, call_id, turn, name, CAST(level AS INTEGER) AS level, status, errors, CAST(0 AS BIGINT) AS copies, record FROM linked
UNION ALL SELECT conv_id, call_id, turn, name, CAST(level AS INTEGER), status, errors, CAST(0 AS BIGINT), record FROM orphans""",
}
