"""From raw documents to encoded ones: language, lines, near duplicates, benchmark passages, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalign.llm import bpe, decontaminate, langid, line_dedup, minhash
from catalign.llm.common import DOC_ROWS, table
from catalign.runtime import arrow_rows, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the identifier, trained on ``docs`` itself, doesn't reject; their columns as they are.

    Null, empty and letterless texts are rejected. Rows are judged one by one, repeated ones alike; an empty table
    stays empty. A null id or language only keeps a row out of the training sample.
    """
    return langid.drop_rejected(docs, langid.train(docs))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing but repeated lines is left goes with them.

    Of equal or similar lines the one of the smallest id and line number stays. Null and empty texts stay as they are; rows that
    share an id are told apart by their text.
    """
    return line_dedup.drop_repeated_lines(docs, drop_emptied=True)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Rows without words or without an id stay; rows that repeat an id go only if none of them is the one that stays.
    """
    return minhash.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and empty texts have none; a document id goes with all its rows; with an empty benchmark all stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and whether they decode to its text.

    Null and empty texts have no ids. Columns already called ``ids`` or ``round_trip`` are replaced, all others stay.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_documents(docs, path, pattern, out="ids", check="round_trip")



STAGES = [
    ("language id", identify_language),
    ("line dedup", deduplicate_lines),
    ("near dedup", deduplicate_documents),
    ("decontamination", remove_benchmark),
    ("byte-level bpe", encode),
]

# The language model, SimHash and merges have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    # Whole documents go through Python in every stage.
    with arrow_rows(spark, DOC_ROWS):
        for name, function in STAGES:
            docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
