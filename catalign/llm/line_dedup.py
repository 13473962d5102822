"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one line of each group."""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalign.llm.common import DOC_ROWS, KeptTexts, KeyFilter, first_common, free_name, linked_groups, mix64, texts_of, with_row_ids
from catalign.runtime import arrow_rows, stage

# Largest number of differing SimHash bits, and the blocks the 64 bits are cut into. At distance
# D at least BLOCKS - D blocks agree, so lines share one of the keys made of that many blocks.
DISTANCE, BLOCKS = 3, 5
PERCENT = 90
MIN_CHARS = 20
# Up to so many edits are looked for along diagonals, whose work grows with their square.
DIAGONAL_EDITS = 40
# ASCII letters become lower case, digits 0, other ASCII characters separators.
FOLD = bytes(
    48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)
)


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.translate(FOLD).split())


def simhashes(lines: list[list[bytes]]) -> np.ndarray:
    """SimHash of each line's distinct words (at least one each): the majority bit of their 64-bit hashes.

    Repeats don't count, else the few most frequent words of a language would decide for long lines.
    """
    import xxhash

    lines = [set(words) for words in lines]
    counts = np.array([len(w) for w in lines], np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lines)), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    # Runs of at most 255 words of a line: their bits are added as bytes, eight in a number.
    runs = -(-counts // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(ends - counts, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    sums = np.empty((len(starts), 64), np.uint8)
    at = 0
    while at < len(starts):
        # About 200,000 words at once: their bits take 13 MB.
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + 200_000)))
        last = starts[stop] if stop < len(starts) else len(hashes)
        bits = np.unpackbits(hashes[starts[at] : last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[at:stop] = np.add.reduceat(bits.view(np.uint64), starts[at:stop] - starts[at], axis=0).view(np.uint8)
        at = stop
    ones = np.add.reduceat(sums, first, axis=0, dtype=np.int32) if len(lines) else sums
    majority = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()


def edit_similar(a: str, b: str, percent: int) -> bool:
    """Whether edit distance * 100 <= (100 - percent) * the longer length, by a banded table."""
    return edit_within(a, b, max(len(a), len(b)) * (100 - percent) // 100)


def edit_within(a: str, b: str, most: int, least: int = 0) -> bool:
    """Whether the edit distance is at most ``most``: few edits by diagonals, many by bits of long integers.

    ``least`` edits are known to be needed: if these are many, diagonals aren't tried.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = _slide(a, b, 0, 0)  # common ends cost nothing
    a, b = a[n:], b[n:]
    n = _slide(a[::-1], b[::-1], 0, 0)
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if DIAGONAL_EDITS < least <= most:
        return _bit_distance(a, b, most) <= most
    # furthest[k]: how far in ``a`` the diagonal k is reached with so many edits.
    furthest = {0: _slide(a, b, 0, 0)}
    if furthest[0] == len(a) == len(b):
        return True
    for edits in range(1, min(most, DIAGONAL_EDITS) + 1):
        new = {}
        for k in range(-edits, edits + 1):
            at = max(furthest.get(k, -9) + 1, furthest.get(k - 1, -9) + 1, furthest.get(k + 1, -9))
            at = min(at, len(a), len(b) + k)
            if at >= 0 and at - k >= 0:
                new[k] = _slide(a, b, at, at - k)
        if new.get(len(a) - len(b), -1) >= len(a):
            return True
        furthest = new
    return most > DIAGONAL_EDITS and _bit_distance(a, b, most) <= most


def _bit_distance(a: str, b: str, most: int) -> int:
    """The edit distance by bit-parallel columns (Myers, Hyyrö); some number over ``most`` if it is larger."""
    points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {c: int.from_bytes(np.packbits(points == ord(c), bitorder="little").tobytes(), "little") for c in set(a)}
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for left, c in enumerate(b, 1 - len(b)):
        same = places.get(c, 0)
        flat = same | down
        step = (((same & up) + up) ^ up) | same
        more, less = down | (~(step | up) & mask), up & step
        score += bool(more & top) - bool(less & top)
        if score + left > most:
            return score + left
        more = (more << 1 | 1) & mask
        up, down = (less << 1 & mask) | (~(flat | more) & mask), more & flat
    return score


def slices(batches, rows: int):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _slide(a: str, b: str, i: int, j: int) -> int:
    """Where in ``a`` the letters from i on stop to be those of ``b`` from j on; longer and longer slices are compared."""
    step, end = 1, min(len(a), len(b) - j + i)
    while i < end and a[i : i + step] == b[j : j + step]:
        i, j, step = i + step, j + step, 2 * step
    while step > 1:
        step //= 2
        if i < end and a[i : i + step] == b[j : j + step]:
            i, j = i + step, j + step
    return min(i, end)


def block_edges(blocks: int) -> list[int]:
    """Where the blocks of a SimHash begin, and the last one ends."""
    return np.linspace(0, 64, blocks + 1).astype(int).tolist()


def block_keys(sims: np.ndarray, distance: int, blocks: int) -> np.ndarray:
    """For each SimHash a 64-bit key per choice of blocks - distance blocks."""
    edges = block_edges(blocks)
    parts = [
        (sims >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])
    ]
    keys = []
    for nth, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = np.full(len(sims), nth + 1, np.uint64)
        for c in chosen:
            key = mix64(key) + parts[c]
        keys.append(mix64(key))
    return np.stack(keys, axis=1)


def repeated_lines(
    docs: DataFrame,
    percent: int = PERCENT,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``(doc_id, line)``: the line numbers (from 0) of ``docs(doc_id, text)`` that repeat an earlier line.

    Lines are compared in normal form: A-Z lower-cased, digits 0, other ASCII characters as
    separators. Two lines are linked if their normal forms are equal, or their SimHashes differ in
    at most ``distance`` bits and their edit similarity is ``percent`` or more. Of each connected
    group the first occurrence, by doc_id and line number, stays. Lines whose normal form is under
    ``min_chars`` bytes are left alone: headings and single words recur in unrelated texts. Null
    and empty texts have no such lines. Rows that share an id (or have none) are judged one by
    one; only rows of one id and one text can't be told apart and are treated alike.
    """
    return _repeated(docs, percent, distance, blocks, min_chars).select("doc_id", "line")


def _repeated(
    docs: DataFrame,
    percent: int = PERCENT,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``repeated_lines`` plus ``row``, a hash of the row's whole text: rows of one id and text are judged alike."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_in = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).filter("text is not null")

    def hashed(batches):
        import pyarrow as pa
        import xxhash

        longs = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
        empty = lambda: ([], [], [], [], [], [])

        def made(ids, owner, number, words, h1, h2, _):
            own = pa.array(owner)
            columns = [ids[0].take(own), ids[1].take(own), pa.array(number, pa.int32())]
            columns += [longs(simhashes(words)), longs(h1), longs(h2)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "line", "sim", "h1", "h2"])

        for batch in batches:
            rows = empty()
            owner, number, words, h1, h2, sizes = rows
            for row in range(batch.num_rows):
                for nth, line in enumerate(texts_of(batch.column(1).slice(row, 1))[0].split(b"\n")):
                    own = line.translate(FOLD).split()
                    whole = b" ".join(own)
                    if own and len(whole) >= min_chars:
                        owner.append(row)
                        number.append(nth)
                        words.append(own)
                        key = xxhash.xxh3_128_intdigest(whole)
                        h1.append(key >> 64)
                        h2.append(key & (2**64 - 1))
                        sizes.append(len(own))
                # The words of a few thousand lines are in memory at once.
                if len(sizes) >= 4000 or sum(sizes[-200:]) >= 200_000:
                    yield made((batch.column(0), batch.column(2)), *rows)
                    rows = empty()
                    owner, number, words, h1, h2, sizes = rows
            if owner:
                yield made((batch.column(0), batch.column(2)), *rows)

    found = rows_in.mapInArrow(hashed, f"doc_id {kind}, row bigint, line int, sim bigint, h1 bigint, h2 bigint")
    with arrow_rows(docs.sparkSession, DOC_ROWS):
        lines = stage(found, "lines")
    first = F.min(F.struct("doc_id", "line", "row")).alias("first")
    distinct = with_row_ids(lines.groupBy("sim", "h1", "h2").agg(first, F.count("*").alias("n")), "distinct")

    # Lines are dealt by one block only; which other blocks agree is found where they arrive.
    edges = block_edges(blocks)
    chosen = [c[0] for c in combinations(range(blocks), blocks - distance)]
    firsts = [
        F.lit(b << 32) + F.shiftrightunsigned("sim", edges[b]).bitwiseAND(F.lit((1 << (edges[b + 1] - edges[b])) - 1))
        for b in range(distance + 1)
    ]
    members = distinct.select(F.explode(F.array(*firsts)).alias("key"), "id", F.col("sim").alias("tag"))

    def finer(keys, tags):
        every, first = block_keys(tags.view(np.uint64), distance, blocks).view(np.int64), keys >> 32
        held = [np.flatnonzero(first == b) for b in range(distance + 1)]
        return [(held[b], every[held[b], nth]) for nth, b in enumerate(chosen) if len(held[b])]

    def normal(batches):
        """Lines that may be needed, with their key."""
        import pyarrow as pa
        import xxhash

        for batch in slices(batches, 500):
            whole = [
                n for text in texts_of(batch.column(0)) for n in map(normal_line, text.split(b"\n")) if len(n) >= min_chars
            ]
            keys = [xxhash.xxh3_128_intdigest(n) for n in whole]
            h1 = np.array([k >> 64 for k in keys], np.uint64).view(np.int64)
            h2 = np.array([k & (2**64 - 1) for k in keys], np.uint64).view(np.int64)
            rows = pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), pa.array(whole, pa.binary()).cast(pa.string())], names=["h1", "h2", "normal"]
            )
            yield rows.filter(pa.array(wanted[0].mask(h1)))

    wanted: list[KeyFilter] = []

    def similar(batches):
        import pyarrow as pa

        for batch in batches:
            holds = [edit_similar(a, b, percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kept = batch.filter(pa.array(holds, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    def read(ids: DataFrame) -> DataFrame:
        needed = stage(ids.join(distinct.select("id", "h1", "h2"), "id"), "needed")
        wanted[:] = [KeyFilter(needed, "h1")]
        texts = rows_in.select("text").mapInArrow(normal, "h1 bigint, h2 bigint, normal string")
        return texts.join(needed, ["h1", "h2"]).groupBy("id").agg(F.first("normal").alias("normal"))

    known_texts = KeptTexts(read)

    def verify(pairs: DataFrame, later: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = known_texts.of(ends, later)
        side = lambda s: texts.select(F.col("id").alias(s), F.col("normal").alias(f"text_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(similar, "a bigint, b bigint")

    def close(left, right):
        return np.bitwise_count(left.view(np.uint64) ^ right.view(np.uint64)) <= distance

    def first_met(keys, left, right):
        """Whether a pair's first common key is this one."""
        one, two = (block_keys(x.view(np.uint64), distance, blocks).view(np.int64) for x in (left, right))
        places = np.arange(len(keys))
        return first_common(one, two, places, places) == keys

    def closest(key, one, two):
        left, right = one["tag"].view(np.uint64), two["tag"].view(np.uint64)
        bits = np.bitwise_count(left[:, None] ^ right[None, :])
        i, j = np.nonzero((bits <= distance) & (one["at"][:, None] != two["at"][None, :]))
        mine = first_met(np.full(len(i), key), one["tag"][i], two["tag"][j])
        return i[mine], j[mine], -bits[i, j][mine].astype(np.int64)

    groups = linked_groups(members, verify, close, closest, split=finer, settled=first_met)
    known = distinct.join(groups, "id", "left")
    known = stage(known.select("sim", "h1", "h2", "first", "n", "component", F.coalesce("component", "id").alias("at")), "known")
    # Only lines that occur twice or are linked can have something to drop.
    known = known.filter("n > 1 or component is not null")
    kept = known.groupBy("at").agg(F.min("first").alias("keep"))
    keep = stage(known.join(kept, "at").select("sim", "h1", "h2", "keep"), "keep")
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line") == F.col("keep.line")) & (F.col("row") == F.col("keep.row"))
    return lines.join(keep, ["sim", "h1", "h2"]).filter(~same).select("doc_id", "row", "line")


def drop_repeated_lines(docs: DataFrame, drop_emptied: bool = False, **how) -> DataFrame:
    """``docs`` with the repeated lines cut out of ``text`` and, where there is one, ``n_chars`` counted anew.

    All other columns and all rows stay; with ``drop_emptied`` rows of which no line is left go.
    """
    gone = stage(_repeated(docs, **how), "repeated")
    doc, row, numbers, cut_text = (free_name(docs, n) for n in ("_doc", "_row", "_lines", "_cut"))
    gone = gone.groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set("line").alias(numbers))

    @F.pandas_udf("string")
    def without(texts: pd.Series, lines: pd.Series) -> pd.Series:
        def cut(text, dropped):
            if text is None or dropped is None:
                return text
            out = set(dropped)
            left = [line for i, line in enumerate(text.split("\n")) if i not in out]
            return "\n".join(left) if left else None

        return pd.Series([cut(t, d) for t, d in zip(texts, lines)], dtype=object)

    both = docs.join(gone, docs["doc_id"].eqNullSafe(gone[doc]) & (F.xxhash64(docs["text"]) == gone[row]), "left")
    columns = []
    for name in docs.columns:
        column = docs[f"`{name}`"]
        if name == "text":
            column = F.when(gone[numbers].isNull(), column).otherwise(F.coalesce(cut_text, F.lit("")))
        columns.append(column.alias(name))
    cut = both.withColumn(cut_text, without(docs["text"], gone[numbers]))
    if drop_emptied:
        cut = cut.filter(gone[numbers].isNull() | F.col(cut_text).isNotNull())
    out = cut.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
