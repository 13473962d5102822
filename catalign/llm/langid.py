"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalign.llm.common import mix64, text_slices, texts_of

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
DIM = 16
# The documented bound of the training sample: rows of each language, whole texts.
ROWS_PER_LANGUAGE = 400
MAX_LANGUAGES = 200
UNKNOWN = "und"
# Bytes of text that are judged at once; a longer text stands alone.
SLICE_BYTES = 2 << 20
RUN_BYTES = 1 << 17
# ASCII letters become lower case, bytes of other letters stay, the rest separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    folded = text.translate(FOLD).strip()
    return any(97 <= c <= 122 for c in folded[:64]) or any(ch.isalpha() for ch in text.decode("utf-8", "replace"))


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte 2-, 3- and 4-grams of the texts, and where each text's begin.

    Words are parted by one space, which is part of the n-grams, so prefixes and suffixes differ
    from inner parts. Each text gets at least one feature.
    """
    folded = [b" " + b" ".join((t or b"").translate(FOLD).split()) + b" " for t in texts]
    out, counts = [], []
    for one in folded:
        own = np.frombuffer(one.ljust(max(GRAMS), b" "), np.uint8).astype(np.uint32)
        code, parts = np.zeros(len(own), np.uint32), []
        for n in range(1, max(GRAMS) + 1):
            code = code[: len(own) - n + 1] * np.uint32(257) + own[n - 1 :] + np.uint32(1)
            if n in GRAMS:
                parts.append((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15))
        out.append(np.concatenate(parts))
        counts.append(len(out[-1]))
    starts = np.cumsum([0, *counts[:-1]]) if counts else np.empty(0, np.int64)
    return (np.concatenate(out) if out else np.empty(0, np.uint32)), starts


@dataclass
class Model:
    """``table`` is embeddings times output weights: the mean of its rows plus ``bias`` is a text's logits."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.empty((len(texts), len(self.languages)))
        # Some 128 KB of text at once, whose features take a few dozen MB; a longer text stands alone.
        runs = np.cumsum([len(t or b"") for t in texts], dtype=np.int64) // RUN_BYTES
        edges = np.append(np.flatnonzero(np.diff(runs, prepend=-1)), len(texts))
        for start, end in zip(edges, edges[1:]):
            buckets, starts = features(texts[start:end])
            sums = np.add.reduceat(self.table[buckets], starts, axis=0, dtype=np.float64)
            sizes = np.diff(np.append(starts, len(buckets)))
            out[start:end] = softmax((sums / sizes[:, None] + self.bias) / self.temperature)
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def rejection_limit(score: np.ndarray, right: np.ndarray) -> float:
    """The lowest score from which on an answer is as likely right as wrong.

    The chance of being right at a score is the best fit that rises with the score (isotonic
    regression), so what lies under the limit is wrong for the most part, however many rows there
    are and whatever is wrong above. 0 (no limit) if the wrong ones under it are not so many more than
    the right ones that chance hardly explains it (two standard deviations), or if the fit stays
    under one half everywhere, as then no score tells.
    """
    levels, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # first score, rows, right ones
    for level, rows, hits in zip(levels, np.bincount(at), np.bincount(at, weights=right)):
        blocks.append([float(level), int(rows), float(hits)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, rows, hits = blocks.pop()
            blocks[-1][1] += rows
            blocks[-1][2] += hits
    nth = next((i for i, (_, rows, hits) in enumerate(blocks) if 2 * hits >= rows), 0)
    rows, hits = (sum(b[i] for b in blocks[:nth]) for i in (1, 2))
    return blocks[nth][0] if rows and rows - 2 * hits >= 2 * rows**0.5 else 0.0


def fit(rows: list[tuple[str, bytes, bytes, bool]], epochs: int = 12, rate: float = 0.5, seed: int = 5) -> Model:
    """Train on ``(language, buckets, counts, validation)`` rows by stochastic gradient descent.

    Rows of the validation part only set the temperature, by least log loss, and the score under
    which a prediction is rejected (``rejection_limit``).
    """
    languages = sorted({r[0] for r in rows}) or [UNKNOWN]
    at = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    inputs = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    data = []
    for name, buckets, counts, held in sorted(rows):
        size = np.frombuffer(counts, "<f4")
        data.append((at[name], np.frombuffer(buckets, "<u4"), size / size.sum(), held))
    train = [d for d in data if not d[3]]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(train)):
            label, buckets, shares, _ = train[i]
            hidden = shares @ inputs[buckets]
            error = softmax((hidden @ weights + bias)[None, :])[0]
            error[label] -= 1
            back = weights @ error
            weights -= step * np.outer(hidden, error)
            bias -= step * 0.1 * error
            inputs[buckets] -= (step * BUCKETS**0.5 * 0.1) * np.outer(shares, back)
    model = Model(languages, (inputs @ weights).astype(np.float32), bias, 1.0, 0.0)
    checked = [d for d in data if d[3]]
    if checked:
        logits = np.array([s @ model.table[b] + bias for _, b, s, _ in checked])
        labels = np.array([d[0] for d in checked])
        heats = np.geomspace(0.1, 10, 41)
        loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in heats]
        model.temperature = float(heats[int(np.argmin(loss))])
        chance = softmax(logits / model.temperature)
        score, right = chance.max(axis=1), chance.argmax(axis=1) == labels
        model.least_score = rejection_limit(score, right)
    return model


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. Rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from ``text`` and ``lang`` of rows that aren't held out, have a language and letters.

    The sample holds at most ``rows_per_language`` whole texts of each of the MAX_LANGUAGES most
    frequent languages, those with the lowest hash of the id. A limit on the hash, set from the
    language's row count, leaves a few times that many rows before they are sorted. Each text also
    gives two spans of a few words from random places, so that short texts are learned too.
    Executors turn texts into bucket counts, of which the driver gets at most BUCKETS a text.
    """
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(
        (fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    spread = 1 << 40
    known = known.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(spread))).withColumn("h", F.xxhash64("text"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    limits = [F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, 4 * rows_per_language / r["count"]) * spread))]
    limit = F.try_element_at(F.create_map(*limits), "lang") if limits else F.lit(0)
    near = known.filter(F.col("u") < limit).dropDuplicates(["lang", "doc_id", "h"])
    order = Window.partitionBy("lang").orderBy("u", "doc_id", "h")
    rows = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows_per_language)

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            names = ["lang", "buckets", "counts", "held"]
            out = {n: [] for n in names}
            for lang, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                words = text.translate(FOLD).split()
                spans = [text]
                held = int(mix64(np.array([int(key) & (2**64 - 1)], np.uint64))[0] % np.uint64(5)) == 0
                # Scores are calibrated on whole texts, which is what is judged.
                for i, size in enumerate(() if held else (3, 8)):
                    salt = np.array([(int(key) * 2 + i) & (2**64 - 1)], np.uint64)
                    place = int(mix64(salt)[0] % np.uint64(max(1, len(words) - size)))
                    spans.append(b" ".join(words[place : place + size]))
                for span in spans:
                    found, sizes = np.unique(features([span])[0], return_counts=True)
                    out["lang"].append(lang)
                    out["buckets"].append(found.astype("<u4").tobytes())
                    out["counts"].append(sizes.astype("<f4").tobytes())
                    out["held"].append(held)
            yield pa.RecordBatch.from_pydict(out)

    schema = "lang string, buckets binary, counts binary, held boolean"
    sample = rows.select("lang", F.xxhash64("doc_id").alias("key"), "text").mapInArrow(counted, schema).collect()
    return fit([(r.lang, bytes(r.buckets), bytes(r.counts), r.held) for r in sample])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for each row of ``docs(doc_id, text)``.

    Whole texts are read, and nothing but the text. ``lang_pred`` is the likeliest learned language
    and ``score`` its calibrated probability. Texts that are null or have no letter get ``und`` and
    0. ``rejected`` marks those and every score under the model's calibrated limit. Repeated rows are
    judged one by one; other columns are ignored. The model is a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        import pyarrow as pa

        own = shared.value
        for batch in (part for whole in batches for part in text_slices(whole, 1, SLICE_BYTES)):
            texts = texts_of(batch.column(1))
            chance = own.probabilities(texts)
            best = chance.argmax(axis=1)
            letters = [has_letter(t) for t in texts]
            score = np.where(letters, chance.max(axis=1, initial=0.0), 0.0)
            names = [own.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            rejected = [not ok or s < own.least_score for s, ok in zip(score, letters)]
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(judged, schema)


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    text = docs.columns.index("text")

    def accepted(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, text, SLICE_BYTES):
                raw = texts_of(part.column(text))
                score = shared.value.probabilities(raw).max(axis=1, initial=0.0)
                yield part.filter(pa.array([has_letter(t) and s >= shared.value.least_score for t, s in zip(raw, score)], pa.bool_()))

    return docs.mapInArrow(accepted, docs.schema)
