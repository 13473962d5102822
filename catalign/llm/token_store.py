"""Token ids on disk: blocks of ids as compressed bit or byte planes, with a chunk index."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalign.llm.common import range_bounds, text_slices, texts_of

CHUNK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
PART_BYTES = 16 << 20
CACHED_CHUNKS = 400_000
# Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20
# A-Z as a-z, line ends as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))
LINE_ENDS = bytes(32 if c == 10 else c for c in range(256))
# After a plain letter and before a space each of these is a token of its own.
MARKS = np.isin(np.arange(256), list(b",.;:!?"))
# A capital and a mark may be composed to one letter, or only the small letter and the mark; the
# tokenizer composes before it folds.
MARKED = re.compile(rb"[A-Z][\x80-\xff]")

# One row of the files is a segment: whole documents in order, about SEGMENT_IDS ids. Its chunks
# hold CHUNK_IDS ids each (the last one fewer) and can be read alone: chunk_ids and chunk_bytes
# are the index into ``planes``.
FORMAT = (
    "part int, segment int, doc_ids array<{id}>, lengths array<bigint>, n_ids bigint, plane string, "
    "chunk_ids array<int>, chunk_bytes array<array<int>>, planes binary"
)


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """Transpose a block of unsigned 32-bit ids: 4 byte planes or 32 bit planes, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:count] for p in planes]
        octets = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


def pack_chunk(ids: np.ndarray, plane: str, level: int = 3) -> list[bytes]:
    import zstandard

    return [zstandard.ZstdCompressor(level=level).compress(p) for p in to_planes(ids, plane)]


def unpack_chunk(packed: list[bytes], count: int) -> np.ndarray:
    import zstandard

    return from_planes([zstandard.ZstdDecompressor().decompress(p) for p in packed], count)


_tokenizers: dict[str, tuple] = {}


def _load(content: bytes):
    import hashlib
    import os

    # Spark gives each task one core; threads of the library would only wait for each other.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hashlib.md5(content).hexdigest()
    if key not in _tokenizers:
        tokenizer = Tokenizer.from_str(content.decode())
        _tokenizers.clear()
        _tokenizers[key] = (tokenizer, Memory(tokenizer))
    return _tokenizers[key]


def _folded(text: bytes) -> bytes:
    """The text with spaces as line ends, and A-Z as a-z in all chunks where that changes no id."""
    out = text.translate(FOLD)
    if text.isascii() or not MARKED.search(text):
        return out
    kept, whole = bytearray(out), text.translate(LINE_ENDS)
    for found in MARKED.finditer(text):
        start, end = out.rfind(b" ", 0, found.start()) + 1, out.find(b" ", found.start())
        end = end if end >= 0 else len(out)
        kept[start:end] = whole[start:end]
    return bytes(kept)


class Memory(dict):
    """Ids of chunks in two generations: when one is full it becomes the older one, from which chunks that are
    asked for again come back."""

    def __init__(self, tokenizer):
        self.names, self.last, self.older = _named(tokenizer), _word_ends(tokenizer), {}

    def look_up(self, chunks: list[bytes]) -> list[bytes | None]:
        """The ids of each chunk, None if neither generation has them."""
        found = list(map(self.get, chunks))
        if self.older:
            open_chunks = [i for i, ids in enumerate(found) if ids is None]
            for i, ids in zip(open_chunks, map(self.older.get, [chunks[i] for i in open_chunks])):
                if ids is not None:
                    self[chunks[i]] = found[i] = ids
        return found

    def learn(self, new: dict[bytes, bytes]) -> None:
        if len(self) + len(new) > CACHED_CHUNKS:
            self.older = dict(self)
            self.clear()
        self.update(new)


def _named(tokenizer) -> re.Pattern | None:
    """Names of the tokenizer's added tokens, in any case."""
    names = [re.escape(t.content.encode()) for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile(b"|".join(names), re.IGNORECASE) if names else None


def _word_ends(tokenizer) -> np.ndarray:
    """Whether each id ends a word; no id does if the tokenizer doesn't mark that."""
    suffix, ids = getattr(tokenizer.model, "end_of_word_suffix", None), tokenizer.get_vocab()
    out = np.zeros(max(ids.values()) + 1, bool)
    out[[i for token, i in ids.items() if suffix and token.endswith(suffix)]] = True
    return out


def encode_texts(texts: list[str | bytes | None], tokenizer, known: Memory, splits: bool = True) -> list[np.ndarray]:
    """Ids of each whole text, without special tokens.

    ``splits`` says that no token of this tokenizer reaches over a space, a line end or the place between a plain
    letter and one of MARKS before a space, and that it takes A-Z as a-z, except before a letter's mark. Then a text's
    ids are those of the chunks between these; each distinct chunk of the list is looked up once, and encoded if the
    memory doesn't know it. A text with a name of an added token (as ``<|endoftext|>``) goes to the library in one
    piece, which decides what it is.
    """
    if not splits:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch([(t or b"").decode() if not isinstance(t, str) else t for t in texts], add_special_tokens=False)]
    raw = [text if isinstance(text, bytes) else (text or "").encode() for text in texts]
    whole = {i for i, text in enumerate(raw) if known.names and b"<" in text and known.names.search(text)}
    out = _of_chunks([b"" if i in whole else text for i, text in enumerate(raw)], tokenizer, known)
    for i in whole:
        out[i] = np.array(tokenizer.encode(raw[i].decode(), add_special_tokens=False).ids, np.uint32)
    return out


def _of_chunks(texts: list[bytes], tokenizer, known: Memory) -> list[np.ndarray]:
    """Ids of each text, put together from those of its chunks. A chunk ends with its space."""
    import pyarrow as pa

    if not texts:
        return []
    letters = np.frombuffer(_folded(b" ".join(texts) + b" "), np.uint8)
    # A mark between a plain letter and a space is a token of its own, so it may as well stand alone.
    marks = np.flatnonzero(MARKS[letters[1:-1]] & (letters[2:] == 32) & (letters[:-2] >= 97) & (letters[:-2] <= 122)) + 1
    stops = np.cumsum([len(text) + 1 for text in texts])
    stops = stops + np.searchsorted(marks, stops)
    letters = np.insert(letters, marks, 32)
    ends = np.flatnonzero(letters == 32) + 1
    offsets = np.append(0, ends).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = column.dictionary_encode()
    which, ids = coded.indices.to_numpy(), _ids_of(coded.dictionary.to_pylist(), tokenizer, known)
    flat = np.frombuffer(b"".join(ids), np.uint32)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    counts = sizes[which]
    done = np.append(0, np.cumsum(counts))
    # Where the ids of each chunk stand in ``flat``, less where they go.
    shifts = (np.cumsum(sizes) - sizes)[which] - done[:-1]
    every = flat[np.repeat(shifts, counts) + np.arange(done[-1])]
    return np.split(every, done[np.searchsorted(ends, stops[:-1], side="right")])


def _ids_of(chunks: list[bytes], tokenizer, known: Memory) -> list[bytes]:
    """The ids of distinct chunks as bytes; the library encodes those that the memory doesn't know."""
    found = known.look_up(chunks)
    fresh = [i for i, ids in enumerate(found) if ids is None]
    texts = [chunks[i].decode() for i in fresh]
    # Words of letters are one token each before they are merged; many of them are encoded as one text.
    words = [n for n, text in enumerate(texts) if text[:-1].isalpha()]
    new: list[bytes | None] = [None] * len(fresh)
    for start in range(0, len(words), 1000):
        some = words[start : start + 1000]
        for n, ids in zip(some, _ids_of_words([texts[n] for n in some], tokenizer, known.last)):
            new[n] = ids
    rest = [n for n, ids in enumerate(new) if ids is None]
    for n, encoded in zip(rest, tokenizer.encode_batch_fast([texts[n] for n in rest], add_special_tokens=False)):
        new[n] = array("I", encoded.ids).tobytes()
    for i, ids in zip(fresh, new):
        found[i] = ids
    known.learn({chunks[i]: found[i] for i in fresh})
    return found


def _ids_of_words(words: list[str], tokenizer, last: np.ndarray) -> list[bytes] | list[None]:
    """The ids of each word, encoded together and cut where a word ends; nothing is known if that isn't once in each."""
    ids = np.array(tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
    ends = np.flatnonzero(last[ids]) + 1
    if len(ends) != len(words) or ends[-1] != len(ids):
        return [None] * len(words)
    blob, ends = ids.tobytes(), (ends * 4).tolist()
    return [blob[start:end] for start, end in zip([0, *ends], ends)]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    plane: str = "byte",
    chunk_ids: int = CHUNK_IDS,
    segment_ids: int = SEGMENT_IDS,
    part_bytes: int = PART_BYTES,
    splits: bool = True,
) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids to ``path`` in ascending order of doc_id.

    Each text (null: empty) is encoded whole and gets ``end_id`` appended. Rows without an id
    come first; rows of the same id are ordered by their ids. Only ids are shuffled: into
    ranges of doc_id, each sorted and written by one task as a stream, a segment at a time.
    A range is bounded by approximate quantiles; repeats of one id share a range.
    """
    spark = docs.sparkSession
    bounds = np.array(range_bounds(docs, "doc_id", part_bytes), np.int64)
    with open(tokenizer_path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa

        tokenizer, known = _load(content.value)
        for batch in batches:
            for piece in text_slices(batch, 1, SLICE_BYTES):
                keys = piece.column(0).to_pylist()
                ids = encode_texts(texts_of(piece.column(1)), tokenizer, known, splits)
                part = [0 if k is None else int(np.searchsorted(bounds, k, side="right")) for k in keys]
                blobs = [np.append(x, end_id).astype("<u4") for x in ids]
                # Most vocabularies fit 16 bits, which halves what is shuffled.
                blobs = [(b"\2" + x.astype("<u2").tobytes()) if x.max() < 65536 else (b"\4" + x.tobytes()) for x in blobs]
                columns = [pa.array(part, pa.int32()), piece.column(0), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "blob"])

    def pack(batches):
        import pyarrow as pa

        at = {"part": None, "segment": 0, "docs": [], "ids": [], "count": 0}

        def flush():
            ids = np.concatenate(at["ids"])
            chunks = [ids[i : i + chunk_ids] for i in range(0, len(ids), chunk_ids)]
            packed = [pack_chunk(c, plane) for c in chunks]
            row = {
                "part": at["part"],
                "segment": at["segment"],
                "doc_ids": at["docs"],
                "lengths": [len(x) for x in at["ids"]],
                "n_ids": len(ids),
                "plane": plane,
                "chunk_ids": [len(c) for c in chunks],
                "chunk_bytes": [[len(p) for p in c] for c in packed],
                "planes": b"".join(p for c in packed for p in c),
            }
            at.update(segment=at["segment"] + 1, docs=[], ids=[], count=0)
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        import pyarrow.types  # noqa: F401
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(layout)
        for batch in batches:
            for part, key, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at["docs"] and (part != at["part"] or at["count"] >= segment_ids):
                    yield flush()
                if part != at["part"]:
                    at.update(part=part, segment=0)
                ids = np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1).astype(np.uint32)
                at["docs"].append(key)
                at["ids"].append(ids)
                at["count"] += len(ids)
        if at["docs"]:
            yield flush()

    from pyspark.sql.types import StructType

    layout = StructType.fromDDL(FORMAT.format(id=kind))
    encoded = docs.select("doc_id", "text").mapInArrow(encode, f"part int, doc_id {kind}, blob binary")
    ranged = encoded.repartitionById(len(bounds) + 1, F.col("part"))
    ordered = ranged.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "blob")
    ordered.mapInArrow(pack, layout).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(part, segment, doc_id, start, ids)`` of files that write_tokens wrote, ``ids`` as array<bigint>."""
    return _read(spark, path, "ids array<bigint>", lambda ids: ids.tolist())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(part, segment, doc_id, start, n_tokens, ids_crc32)`` of each document, read from the files."""
    return _read(spark, path, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                parts, at = [], 0
                for count, sizes in zip(row.chunk_ids, row.chunk_bytes):
                    packed = []
                    for size in sizes:
                        packed.append(row.planes[at : at + size])
                        at += size
                    parts.append(unpack_chunk(packed, count))
                ids = np.concatenate(parts)
                ends = np.cumsum(row.lengths)
                starts = ends - row.lengths
                yield pd.DataFrame(
                    {
                        "part": row.part,
                        "segment": row.segment,
                        "doc_id": pd.array(list(row.doc_ids), dtype="Int64") if kind in ("bigint", "int") else list(row.doc_ids),
                        "inside": starts,
                        "n_tokens": row.lengths,
                        column.split()[0]: [value(ids[s:e]) for s, e in zip(starts, ends)],
                    }
                )

    rows = files.mapInPandas(unpack, f"part int, segment int, doc_id {kind}, inside bigint, n_tokens bigint, {column}")
    # Ids before each segment: sums inside a part, then over the (few) parts.
    sizes = files.select("part", "segment", "n_ids")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("parts_before"))
    starts = sizes.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before"))
    starts = starts.join(parts, "part").select("part", "segment", (F.col("before") + F.col("parts_before")).alias("before"))
    return rows.join(starts, ["part", "segment"]).select(
        "part", "segment", "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", column.split()[0]
    )
