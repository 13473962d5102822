"""Benchmark passages in documents, found by Wu-Manber search over words."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalign.llm.common import free_name, texts_of

WINDOW = 10
# Bytes of benchmark text whose tables a task holds at once.
WAVE_BYTES = 16 << 20
# 0-9 and bytes of non-ASCII letters stay, A-Z become a-z, the rest separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Searcher:
    """Wu-Manber tables for patterns of one length, with words as letters and blocks of two.

    ``shift`` tells how far the search may jump after the block that ends at a word: the
    distance from the block's last place in any pattern to the pattern's end, or past the
    whole block if no pattern has it. Blocks that end a pattern lead to the patterns with
    that suffix, by first word; those are compared word by word.
    """

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            self.buckets.setdefault(words[-self.block :], {}).setdefault(words[0], []).append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of each occurrence."""
        size, block, jump, shift = self.length, self.block, self.jump, self.shift.get
        end = size
        while end <= len(words):
            key = tuple(words[end - block : end])
            step = shift(key, jump)
            if step:
                end += step
                continue
            start = end - size
            for pattern, items in self.buckets[key].get(words[start], ()):
                if words[start:end] == list(pattern):
                    yield start, items
            end += 1


def build_searchers(items: list[tuple[str, bytes | None]], window: int) -> list[Searcher]:
    """One table set for each pattern length; an item of fewer words is one window."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        if size:
            for start in range(len(words) - size + 1):
                by_length.setdefault(size, {}).setdefault(tuple(words[start : start + size]), set()).add(item)
    return [Searcher(size, patterns) for size, patterns in sorted(by_length.items())]


def covered(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(starts):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


# The tables of the wave a worker used last.
_tables: dict[str, list[Searcher]] = {}


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids, spans)`` for each row of ``docs(doc_id, text)``.

    ``spans`` are half-open word ranges inside occurrences of windows of ``benchmark(item_id,
    text)``, ``n_hit`` the words in them, ``item_ids`` the items found, sorted as strings. Null
    and empty texts have no words and no hits; items without words find nothing; an item with
    a null id is named ''. Rows with the same id are searched one by one; other columns are
    ignored. The documents are scanned once and not shuffled. The benchmark is broadcast in
    waves of ``wave_bytes`` by its measured size, and a task holds one wave's tables at a time.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    waves = max(1, math.ceil(size / wave_bytes))
    wave = F.pmod(F.xxhash64("item_id", "text"), F.lit(waves))
    shared = {
        uuid.uuid4().hex: docs.sparkSession.sparkContext.broadcast(
            [(r.item_id, r.text.encode() if r.text is not None else None) for r in items.filter(wave == i).collect()]
        )
        for i in range(waves)
    }

    def search(batches):
        import pyarrow as pa

        names = ["doc_id", "n_words", "n_hit", "item_ids", "spans"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = texts_of(batch.column(1))
            found: list[tuple[set[str], list[tuple[int, int]]]] = [(set(), []) for _ in texts]
            counts = [0] * len(texts)
            for part, rows in shared.items():
                if part not in _tables:
                    _tables.clear()
                    _tables[part] = build_searchers(rows.value, window)
                for k, text in enumerate(texts):
                    words = words_of(text)
                    counts[k] = len(words)
                    for table in _tables[part]:
                        for start, names_found in table.search(words):
                            found[k][0].update(names_found)
                            found[k][1].append((start, start + table.length))
            spans = [covered(s) for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                    pa.array([sorted(i) for i, _ in found], pa.list_(pa.string())),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span),
                ],
                names=names,
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("item_ids", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(search, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs.

    A row goes if any row of its id is hit. Rows without an id are judged one by one, by their text.
    """
    text = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), text.alias("text")).alias("doc_id"), "text")
    one, two = free_name(docs, "_hit"), free_name(docs, "_hit_text")
    hit = find_contamination(keyed, benchmark, window).filter("n_hit > 0")
    hit = hit.select(F.col("doc_id.id").alias(one), F.col("doc_id.text").alias(two)).distinct()
    same = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).eqNullSafe(hit[two])
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[one]) & same, "left_anti")
