"""Records of CSV files whose quoted fields span lines, found in parallel by a scan over quote states.

A file is cut into byte ranges wherever Spark likes. Whether a range begins inside a quoted field depends on
everything before it, but each line maps the state before it to the state after it, and such maps
compose. So one pass finds the map of each range for both states, a running composition over the ranges (one row each)
gives the state at each range's start, and a second pass cuts all ranges at the true record starts. Small ranges are
read many to a task. Only the pieces of a record that crosses a range's end are shuffled.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalign.runtime import stage

# Bytes of a range. The driver and each task hold some 40 bytes for each of them.
SPLIT_BYTES = 32 << 20
# Bytes of the ranges that one task reads, if they are smaller than that.
TASK_BYTES = 32 << 20
# Records that leave a task together.
BATCH_ROWS = 4096


def without_quoted(line: Column, separator: str) -> Column:
    """A line with its closed quoted fields emptied, and without doubled quotes."""
    sep = re.escape(separator)
    return F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), f'(^|{sep})"[^"]*"(?={sep}|$)', "$1")


def opens_field(line: Column, separator: str) -> Column:
    """Whether a quoted field begins in the line and doesn't end in it; a quote inside a field is text."""
    return without_quoted(line, separator).rlike(f'(^|{re.escape(separator)})"[^"]*$')


def _reading_tasks(spark: SparkSession, paths: list[str]) -> int:
    """How many tasks read the files: enough to keep the cluster busy, and no more than their bytes need."""
    total = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def _without_return(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r$", "")).otherwise(text)


@contextmanager
def _fixed_splits(spark: SparkSession, split_bytes: int, tasks: int):
    """Ranges that depend on the files and ``split_bytes`` alone, so that two passes cut alike; a task reads many small ones."""
    wanted = {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.files.maxPartitionNum": str(tasks),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _lines(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    """``(path, block, value, outside, inside)``: physical lines in the order of their range, and the state after
    a line (true: within a quoted field) for either state before it."""
    value = F.regexp_replace("value", "\r$", "")
    quoted = F.col("value").contains('"')
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        (quoted & opens_field(value, separator)).alias("outside"),
        # A line that goes on inside a field is one that begins with the field's quote.
        (~quoted | opens_field(F.concat(F.lit('"'), value), separator)).alias("inside"),
    )


def _runs(batches):
    """``(path, block, first line, part)`` of each run of lines of one range; a range's lines come one after the other."""
    at, line = None, 0
    for batch in batches:
        paths, blocks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        names = paths.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end == start:
                continue
            key = (paths[int(start)].as_py(), int(blocks[start]))
            if key != at:
                at, line = key, 0
            yield *key, line, batch.slice(start, end - start)
            line += int(end - start)


def _states(outside: np.ndarray, inside: np.ndarray, state: bool) -> np.ndarray:
    """The state before each line and after the last one.

    A line after which the state is the same either way settles it, any other one keeps or swaps it. So
    the state is that of the last settling line, swapped as often as lines since then swap it.
    """
    swaps = np.cumsum(outside & ~inside) & 1
    settles = outside == inside
    last = np.maximum.accumulate(np.where(settles, np.arange(len(outside)), -1))
    after = np.where(last >= 0, outside[last] ^ (swaps != swaps[last]), state ^ (swaps == 1))
    return np.append(state, after)


def _range_maps(lines: DataFrame) -> DataFrame:
    """One row a range: for either state before it the state after it and its last line that begins a record (-1: none)."""

    def mapped(batches):
        import pyarrow as pa

        done, at = [], None
        for path, block, first, part in _runs(batches):
            if (path, block) != at:
                at = (path, block)
                done.append([path, block, [False, True], [-1, -1]])
            outside, inside = (part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4))
            own = done[-1]
            for k in (0, 1):
                states = _states(outside, inside, own[2][k])
                own[2][k] = bool(states[-1])
                begun = np.flatnonzero(~states[:-1])
                if len(begun):
                    own[3][k] = first + int(begun[-1])
        rows = [(p, b, *after, *last) for p, b, after, last in done]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()])]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "block", "outside", "inside", "last0", "last1"])

    return lines.mapInArrow(mapped, "path string, block bigint, outside boolean, inside boolean, last0 bigint, last1 bigint")


def _range_starts(maps: DataFrame) -> DataFrame:
    """``(path, block, state, from_block, from_line)``: the state before each range and the record that is open there."""
    order = Window.partitionBy("path").orderBy("block")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(so_far) % 2
    settled = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("int"))
    known = maps.withColumn("swaps", swaps).withColumn("anchor", (settled + F.col("swaps")) % 2)
    after = (F.coalesce(F.last("anchor", ignorenulls=True).over(so_far), F.lit(0)) + F.col("swaps")) % 2
    known = known.withColumn("after", after).withColumn("state", F.lag("after", 1, 0).over(order) == 1)
    begun = F.when(F.col("state"), F.col("last1")).otherwise(F.col("last0"))
    known = known.withColumn("begun", F.when(begun >= 0, F.struct(F.col("block").alias("b"), begun.alias("l"))))
    opened = F.last("begun", ignorenulls=True).over(before)
    return known.select("path", "block", "state", opened["b"].alias("from_block"), opened["l"].alias("from_line"))


PIECE = "path string, block bigint, line bigint, from_block bigint, from_line bigint, text binary, crosses boolean"


def _cut(lines: DataFrame, starts) -> DataFrame:
    """Records that lie within one range and the pieces of those that don't, with the place where they begin."""

    def cut(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        out = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[f.split()[0] for f in PIECE.split(", ")]
        )
        rows: list[tuple] = []
        at, held, held_line, begun, state = None, [], 0, (None, None), False

        def close(crosses: bool) -> None:
            if held:
                rows.append((*at, held_line, *begun, b"\n".join(held), crosses))

        for path, block, first, part in _runs(batches):
            if (path, block) != at:
                close(state or begun[0] != (at and at[1]))
                at, held, held_line = (path, block), [], 0
                blocks, *facts = starts.value[path]
                place = int(np.searchsorted(blocks, block))
                if place == len(blocks) or blocks[place] != block:
                    raise ValueError(f"{path} is cut otherwise than before at {block}")
                state, *begun = (f[place].item() for f in facts)
            outside, inside = (part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4))
            states = _states(outside, inside, state)
            values = part.column(2).to_pylist()
            edges = np.flatnonzero(~states[:-1]).tolist()
            held = held + values[: edges[0] if edges else len(values)]
            for edge, end in zip(edges, [*edges[1:], len(values)]):
                close(begun[0] != block)
                held, held_line, begun = values[edge:end], first + edge, (block, first + edge)
                if len(rows) >= BATCH_ROWS:
                    yield out(rows)
                    rows.clear()
            state = bool(states[-1])
        close(state or begun[0] != (at and at[1]))
        yield out(rows)

    return lines.mapInArrow(cut, PIECE)


def scan_records(spark: SparkSession, paths: list[str], separator: str, charset: str = "UTF-8", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, block, line, text)``: the records of files, header and blank ones included, staged.

    A record is the text of its lines; ``block`` and ``line`` tell where it begins and order the records of a file.
    Lines end with a line feed, or with a carriage return before it; inside a field both stay. A record that isn't
    closed ends with its file.
    """
    with _fixed_splits(spark, split_bytes, _reading_tasks(spark, paths)):
        lines = _lines(spark, paths, separator)
        lines = lines.withColumn("value", F.col("value").cast("binary"))
        ranges = _range_starts(_range_maps(lines)).orderBy("path", "block").toArrow().to_pydict()
        starts: dict[str, list[list]] = {}
        for path, *facts in zip(*ranges.values()):
            starts.setdefault(path, [[], [], [], []])
            for column, fact in zip(starts[path], facts):
                column.append(-1 if fact is None else fact)
        packed = {path: [np.array(c) for c in columns] for path, columns in starts.items()}
        shared = spark.sparkContext.broadcast(packed)
        text = F.col("text").cast("string") if charset == "UTF-8" else F.decode("text", charset)
        ended = F.when(F.col("crosses"), text).otherwise(_without_return(text))
        pieces = stage(_cut(lines, shared).withColumn("text", ended), "pieces")
    complete = pieces.filter("NOT crosses").select("path", F.col("from_block").alias("block"), F.col("from_line").alias("line"), "text")
    piece = F.struct("block", "line", "text")
    crossing = (
        pieces.filter("crosses")
        .groupBy("path", "from_block", "from_line")
        .agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
        .select("path", F.col("from_block").alias("block"), F.col("from_line").alias("line"), F.array_join(F.transform("pieces", lambda x: x["text"]), "\n").alias("text"))
        .withColumn("text", _without_return(F.col("text")))
    )
    return complete.unionByName(stage(crossing, "crossing"))
