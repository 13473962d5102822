"""Exact copies: frequent digests found by Misra-Gries go by broadcast, the others by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalign.llm.common import free_name
from catalign.runtime import stage

# A digest of more than this share of all rows is a heavy hitter; 1 / SUPPORT counters find them all.
SUPPORT = 0.001


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _heavy_hitters(digests: DataFrame, support: float) -> DataFrame:
    """``(digest, n, best)`` of the digests that more than ``support`` of the rows have, 1 / ``support`` rows at most.

    ``freqItems`` is the Misra-Gries summary (Karp, Schenker and Papadimitriou's form): it misses no
    such digest but may name others, so its candidates are counted exactly.
    """
    named = digests.select(F.hex("digest").alias("name")).stat.freqItems(["name"], support)
    candidates = stage(named.select(F.explode("name_freqItems").alias("name")).select(F.unhex("name").alias("digest")), "candidates")
    counted = digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*_winner())
    return stage(counted.filter(F.col("n") > F.lit(support) * digests.count()), "heavy")


def _winner() -> list[Column]:
    return [F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best")]


def _marked(digests: DataFrame, support: float) -> DataFrame:
    """``digests(row, doc_id, digest)`` plus what became of each row."""
    heavy = _heavy_hitters(digests, support)
    settled = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    # Counts are combined before the shuffle; only digests that occur again come back to their rows.
    repeated = stage(rest.groupBy("digest").agg(*_winner()).filter("n > 1"), "repeated")
    both = settled.unionByName(rest.join(repeated, "digest", "left"))
    own = F.coalesce(F.col("best"), F.struct("doc_id", "row"))
    return both.select(
        "row",
        "doc_id",
        own["doc_id"].alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (own["row"] == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of each row of ``docs(doc_id, text)``.

    Texts are equal when all their characters are; null counts as empty. Of equal texts the row of the largest id
    stays, its id is ``keep_id``; of repeated rows with that id one stays. Null ids lose to others; if
    all are null, one row stays and ``keep_id`` is null. An empty table gives no rows, other columns of ``docs`` play no
    part, and a long text costs no more than its digest.
    """
    digests = docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
    # Rows are numbered while they are written, so the numbers stay.
    digests = stage(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    return _marked(digests, support).drop("row")


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns."""
    row = free_name(docs, "row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    digests = rows.select(F.col(row).alias("row"), "doc_id", text_digest(F.col("text")).alias("digest"))
    gone = _marked(stage(digests, "digests"), support).filter("not kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
