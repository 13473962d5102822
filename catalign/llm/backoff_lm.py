"""Stupid-backoff scores of documents from n-gram counts of the whole corpus."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalign.llm.common import mix64, texts_of
from catalign.runtime import stage

ORDER = 2
ALPHA = 0.4
MIN_COUNT = 2
# Text of one block of documents, and text whose n-grams of one order one count table holds.
BLOCK_BYTES = 8 << 20
TABLE_BYTES = 16 << 20


def token_hashes(text: bytes | None) -> np.ndarray:
    import xxhash

    words = text.lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each token the hash of the n-gram that ends at it; 0 where its document has too few."""
    code = mix64(words + np.uint64(order))
    for back in range(1, order):
        shifted = np.concatenate([np.zeros(min(back, len(words)), np.uint64), words[:-back]])[: len(words)]
        code = mix64(code ^ (shifted + np.uint64(back)) * np.uint64(0x9E3779B97F4A7C15))
    code[code == 0] = 1
    code[np.arange(len(words)) - starts < order - 1] = 0
    return code


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as zstandard-compressed byte planes; planes of zeros cost next to nothing."""
    import zstandard

    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(octets).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    octets = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(octets.T).view("<u8").ravel()


def _blocks(batches, block_bytes: int):
    """Runs of documents of about ``block_bytes``, each with a key made of its content."""
    import xxhash

    def made(ids, texts):
        whole = xxhash.xxh3_128(repr(ids).encode())
        for text in texts:
            whole.update(b"\0" if text is None else b"\1" + text)
        words = [token_hashes(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = [int(np.uint64(x).view(np.int64)) for x in (whole.intdigest() >> 64, whole.intdigest() & (2**64 - 1))]
        return key, ids, lengths, starts, np.concatenate(words)

    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            ids.append(key)
            texts.append(text)
            size += len(text or b"")
            if size >= block_bytes:
                yield made(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield made(ids, texts)


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    alpha: float = ALPHA,
    min_count: int = MIN_COUNT,
    block_bytes: int = BLOCK_BYTES,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """``(doc_id, n_tokens, log10_score, mean_log10)`` for each row of ``docs(doc_id, text)``.

    Tokens are words between ASCII white space, A-Z lower-cased. The counts are those of all
    n-grams up to ``order`` inside documents, over all rows. A token's score is
    c(n-gram) / c(its first n - 1 words) for the longest n-gram ending at it that occurs at least
    ``min_count`` times, times ``alpha`` for each longer one that fits the document; a single word
    scores c(word) / (all tokens). A document's score is the sum of its tokens' log10. Null, empty and
    blank texts have 0 tokens, score 0 and a null mean. Repeated rows count and are scored
    each; other columns are ignored.

    Blocks of documents send each distinct n-gram once, with its count, to the table that its
    hash falls into; tables add up and send the totals back to the blocks, which sum over their
    tokens. No word or n-gram is a key of its own, so frequent ones don't gather in a task. The
    blocks are made twice, so ``docs`` must give the same rows each time, as files do; a block
    that finds no totals stops the job.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tables = max(1, math.ceil(size / table_bytes))

    def send(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["n", "t", "b1", "b2", "grams", "counts"]
        for batch in batches:
            for key, _, _, starts, words in _blocks([batch], block_bytes):
                for n in range(1, order + 1):
                    grams, counts = np.unique(gram_hashes(words, starts, n), return_counts=True)
                    table = ((grams >> np.uint64(32)) * np.uint64(tables)) >> np.uint64(32)
                    cuts = np.searchsorted(table, np.arange(tables + 1, dtype=np.uint64))
                    for t in range(tables):
                        own = slice(cuts[t], cuts[t + 1])
                        if cuts[t] < cuts[t + 1]:
                            row = [n, t, *key, grams[own].astype("<u8").tobytes(), _pack(counts[own])]
                            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    def add_up(group):
        import pandas as pd

        grams = [np.frombuffer(g, "<u8") for g in group["grams"]]
        distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.zeros(len(distinct), np.uint64)
        np.add.at(totals, at, np.concatenate([_unpack(c) for c in group["counts"]]))
        ends = np.cumsum([len(g) for g in grams])
        found = [_pack(totals[at[e - len(g) : e]]) for g, e in zip(grams, ends)]
        return pd.DataFrame(group[["n", "t", "b1", "b2"]]).assign(totals=found).drop_duplicates(["b1", "b2"])

    sent = rows.mapInArrow(send, "n int, t int, b1 bigint, b2 bigint, grams binary, counts binary")
    totals = sent.groupBy("n", "t").applyInPandas(add_up, "n int, t int, b1 bigint, b2 bigint, totals binary")

    def lay_out(batches):
        import pyarrow as pa

        names = ["b1", "b2", "doc_ids", "lengths", "places"]
        for batch in batches:
            for key, ids, lengths, starts, words in _blocks([batch], block_bytes):
                places = [_pack(np.unique(gram_hashes(words, starts, n), return_inverse=True)[1]) for n in range(1, order + 1)]
                columns = [pa.array([k], pa.int64()) for k in key]
                columns += [pa.array([ids], pa.list_(batch.schema.field(0).type)), pa.array([lengths.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([places], pa.list_(pa.binary()))], names=names)

    layout = rows.mapInArrow(lay_out, f"b1 bigint, b2 bigint, doc_ids array<{kind}>, lengths array<bigint>, places array<binary>")

    def score(blocks, found):
        import pandas as pd

        parts = []
        for block in blocks.itertuples(index=False):
            lengths = np.array(block.lengths, np.int64)
            ends = np.cumsum(lengths)
            count = int(ends[-1]) if len(ends) else 0
            counts = []
            for n, place in enumerate(block.places, 1):
                own = found[found["n"] == n].sort_values("t")["totals"]
                if count and not len(own):
                    raise RuntimeError("the documents changed while they were read")
                counts.append(np.concatenate([_unpack(x) for x in own])[_unpack(place)].astype(np.float64) if count else np.empty(0))
            inside = np.arange(count) - np.repeat(ends - lengths, lengths)
            logs, single = np.zeros(count), np.ones(count, bool)
            for n in range(order, 1, -1):
                fits = single & (inside >= n - 1)
                seen = fits & (counts[n - 1] >= min_count)
                context = np.concatenate([[1], counts[n - 2][:-1]]) if count else np.empty(0)
                logs[seen] += np.log10(counts[n - 1][seen] / context[seen])
                single &= ~seen
                logs[fits & ~seen] += math.log10(alpha)
            logs[single] += np.log10(counts[0][single])
            singles = np.concatenate([[0], np.cumsum(single)])
            parts.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(list(block.doc_ids), dtype="Int64") if kind in ("bigint", "int") else list(block.doc_ids),
                        "n_tokens": lengths,
                        "logs": [math.fsum(logs[e - k : e]) for e, k in zip(ends, lengths)],
                        "singles": singles[ends] - singles[ends - lengths],
                    }
                )
            )
        if not parts:
            raise RuntimeError("the documents changed while they were read")
        return pd.concat(parts)

    by = ["b1", "b2"]
    scored = layout.groupBy(*by).cogroup(totals.groupBy(*by)).applyInPandas(
        score, f"doc_id {kind}, n_tokens bigint, logs double, singles bigint"
    )
    scored = stage(scored, "scores")
    everything = scored.agg(F.sum("n_tokens")).first()[0] or 1
    total = F.col("logs") - F.col("singles") * math.log10(everything)
    return scored.select(
        "doc_id", "n_tokens", total.alias("log10_score"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log10")
    )
