"""Read product CSV files of unknown dialect; write results."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalign.operators.schema import normalize_na, quoted, stack, unify_schema, with_initial_group, with_provenance
from catalign.runtime import SINGLE_TASK_ROWS, global_rank, lookup
from catalign.sources.records import SPLIT_BYTES, opens_field, scan_records, without_quoted

# Encodings in the order they are tried.
ENCODINGS = ["utf-8", "cp1251", "cp1252", "latin-1"]
SEPARATORS = [";", ","]
HEAD_LINES = 20
# Where a row stands: file name, full path, start of the split, and line inside it.
PLACE = ["_file", "_path", "_block", "_line"]


class UnreadableFile(ValueError):
    """No dialect gives a header of two or more columns and a row."""


@dataclass(frozen=True)
class Dialect:
    encoding: str
    separator: str
    quoted: bool
    multi_line: bool
    columns: tuple[str, ...]


def clean_headers(names: list[str]) -> list[str]:
    """Strip blanks and quote characters; number repeated names ``x, x.1, …``."""
    out: list[str] = []
    for name in names:
        name = name.replace("﻿", "").strip().strip('"').strip("'")
        unique, n = name, 0
        while unique in out:
            n += 1
            unique = f"{name}.{n}"
        out.append(unique)
    return out


def _location(uri: str) -> str:
    """One form for the URIs that listings and scans give."""
    return re.sub("^file:/+", "/", unquote(uri))


def detect_dialects(spark: SparkSession, paths: list[str]) -> dict[str, dict[str, Dialect | None]]:
    """For each path its files with their dialects, None where no dialect fits.

    All files are looked at together: one job reads their first lines, which decide separator,
    quoting and header (``;`` before ``,`` before a guess, quoted before unquoted), one scan of all
    bytes tells which files are UTF-8 and whether quoted fields span lines, one of the others decides their encodings.
    """
    files = {path: sorted(_location(f) for f in spark.read.text(path).inputFiles()) for path in paths}
    lines = spark.read.text(paths).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    first = lines.filter("block = 0").withColumn("nth", nth).filter(F.col("nth") <= HEAD_LINES)
    heads: dict[str, list[bytes]] = {}
    for row in first.select("path", "nth", F.col("value").cast("binary")).orderBy("path", "nth").collect():
        heads.setdefault(_location(row[0]), []).append(bytes(row[2]))
    guessed = {path: _separator(head) for path, head in heads.items()}
    separators = sorted({g[0] for g in guessed.values() if g})
    checks = [F.bool_and(F.is_valid_utf8("value")).alias("utf-8")]
    checks += [F.bool_or(F.col("value").contains('"') & opens_field(F.col("value"), sep)).alias(f"open{i}") for i, sep in enumerate(separators)]
    facts = {_location(r["path"]): r.asDict() for r in lines.groupBy("path").agg(*checks).collect()}
    others = [file for file, fact in facts.items() if not fact["utf-8"]]
    if others:
        hexes = F.hex(F.col("value").cast("binary"))
        fits = []
        for name in ENCODINGS[1:]:
            bad = [f"{128 + i:02X}" for i, ch in enumerate(_high_bytes(name)) if ch is None]
            fits.append((~F.bool_or(hexes.rlike("^(..)*(" + "|".join(bad) + ")")) if bad else F.bool_and(F.lit(True))).alias(name))
        of_others = spark.read.text(others).select("value", F.col("_metadata.file_path").alias("path"))
        for r in of_others.groupBy("path").agg(*fits).collect():
            facts[_location(r["path"])].update(r.asDict())

    def dialect(file: str) -> Dialect | None:
        if not guessed.get(file):
            return None
        separator, use_quotes = guessed[file]
        fact = facts[file]
        encoding = next(name for name in ENCODINGS if fact[name])
        names = _header(heads[file], encoding, separator, use_quotes)
        spans = use_quotes and fact[f"open{separators.index(separator)}"]
        return Dialect(encoding, separator, use_quotes, bool(spans), tuple(clean_headers(names)))

    return {path: {file: dialect(file) for file in own} for path, own in files.items()}


def detect_dialect(spark: SparkSession, path: str) -> Dialect:
    """The dialect of a file, or of the first readable file of a folder."""
    found = [d for d in detect_dialects(spark, [path])[path].values() if d]
    if not found:
        raise UnreadableFile(path)
    return found[0]


def _header(head: list[bytes], encoding: str, separator: str, use_quotes: bool) -> list[str]:
    quoting = csv.QUOTE_MINIMAL if use_quotes else csv.QUOTE_NONE
    text = [b.decode(encoding, errors="replace").replace("\ufeff", "") for b in head]
    return next(csv.reader([t for t in text if t.strip()], delimiter=separator, quoting=quoting))


def _separator(head: list[bytes]) -> tuple[str, bool] | None:
    """Separator and whether quotes count, from lines of any encoding: separators are ASCII."""
    text = [t for t in (b.decode("latin-1").removeprefix("ï»¿") for b in head) if t.strip()]
    if len(text) < 2:
        return None
    for use_quotes in (True, False):
        for separator in [*SEPARATORS, *_guess(text, use_quotes)]:
            if len(_header([t.encode("latin-1") for t in text], "latin-1", separator, use_quotes)) > 1:
                return separator, use_quotes
    return None


def _guess(text: list[str], use_quotes: bool) -> list[str]:
    if not use_quotes:
        return []
    try:
        return [csv.Sniffer().sniff("\n".join(text)).delimiter]
    except csv.Error:
        return []


def _high_bytes(encoding: str) -> list[str | None]:
    """What each byte from 0x80 on means in a single-byte encoding, None if nothing."""
    return [bytes([b]).decode(encoding, errors="ignore") or None for b in range(128, 256)]


def recode(value: Column, encoding: str, back: bool = False) -> Column:
    """Text read byte by byte (Latin-1) as the text it is in another encoding.

    Spark's CSV source reads only a few charsets, so other single-byte ones are
    mapped character by character; ``back`` maps the other way for writing.
    """
    known = [(chr(128 + i), ch) for i, ch in enumerate(_high_bytes(encoding)) if ch is not None]
    latin, target = "".join(k for k, _ in known), "".join(v for _, v in known)
    return F.translate(value, target, latin) if back else F.translate(value, latin, target)


def scan_csv(spark: SparkSession, paths: list[str], dialect: Dialect, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of files of one dialect as text columns ``c0, c1, …``, with their place and ``_bad``.

    ``_path``, ``_block`` and ``_line`` order the rows as in the files. A row is bad if it has
    more fields than the header, be they empty or not; a short row is filled with nulls.
    """
    width = len(dialect.columns)
    schema = ", ".join(f"c{i} string" for i in range(width)) + ", _raw string"
    charset = "UTF-8" if dialect.encoding == "utf-8" else "ISO-8859-1"
    options = {
        "sep": dialect.separator,
        "quote": '"' if dialect.quoted else "",
        "escape": '"' if dialect.quoted else "",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_raw",
    }
    if dialect.multi_line:
        records = scan_records(spark, paths, dialect.separator, charset, split_bytes)
        rows = _parsed_records(records, schema, options)
    else:
        rows = spark.read.csv(paths, schema=schema, header=True, enforceSchema=True, encoding=charset, **options).select(
            "*",
            F.col("_metadata.file_name").alias("_file"),
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
    # Spark keeps the text of every row that hasn't exactly the header's number of fields.
    bare = without_quoted(F.col("_raw"), dialect.separator) if dialect.quoted else F.col("_raw")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(dialect.separator))) + 1
    text = F.col if dialect.encoding in ("utf-8", "latin-1") else lambda c: recode(F.col(c), dialect.encoding)
    return rows.select(
        *[text(f"c{i}").alias(f"c{i}") for i in range(width)],
        *PLACE,
        F.coalesce(fields > width, F.lit(False)).alias("_bad"),
    )


def _parsed_records(records: DataFrame, schema: str, options: dict) -> DataFrame:
    """Records of files whose quoted fields span lines, each parsed by itself.

    The first record of a file that isn't blank is the header; blank ones are no rows.
    """
    records = records.filter(F.col("text").rlike(r"\S"))
    heads = records.groupBy("path").agg(F.min(F.struct("block", "line")).alias("head"))
    rows = lookup(records, heads, "path").filter(F.struct("block", "line") != F.col("head"))
    return rows.select(
        F.from_csv("text", schema, options | {"multiLine": "true"}).alias("r"),
        F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("_file"),
        F.col("path").alias("_path"),
        F.col("block").alias("_block"),
        F.col("line").alias("_line"),
    ).select("r.*", *PLACE)


def _whole(scanned: DataFrame) -> Column:
    """Always true, but read from all columns: with some pruned away, Spark would no longer count
    a row's fields against the header."""
    return F.length(F.concat_ws("", *[c for c in scanned.columns if c not in (*PLACE, "_bad")])) >= 0


def _good_rows(scanned: DataFrame, dialect: Dialect) -> DataFrame:
    named = [F.col(f"c{i}").alias(name) for i, name in enumerate(dialect.columns)]
    return scanned.filter(~F.col("_bad") & _whole(scanned)).select(*named, *PLACE)


def _row_counts(scanned: DataFrame) -> DataFrame:
    return (
        scanned.filter(_whole(scanned))
        .groupBy("_path", "_file")
        .agg(F.count_if(~F.col("_bad")).alias("kept"), F.count_if("_bad").alias("dropped"))
    )


def _by_dialect(dialects: dict[str, Dialect | None]) -> dict[Dialect, list[str]]:
    groups: dict[Dialect, list[str]] = {}
    for file, dialect in dialects.items():
        if dialect is not None:
            groups.setdefault(dialect, []).append(file)
    return groups


def read_csv(spark: SparkSession, path: str, dialect: Dialect | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One file or folder as text columns under cleaned headers, plus the place of each row.

    Bad rows are left out; ``bad_rows`` counts them. Files whose quoted fields span lines are read in ranges of
    ``split_bytes``, too.
    """
    if dialect is not None:
        return _good_rows(scan_csv(spark, [path], dialect, split_bytes), dialect)
    groups = _by_dialect(detect_dialects(spark, [path])[path])
    if not groups:
        raise UnreadableFile(path)
    return stack([_good_rows(scan_csv(spark, files, d, split_bytes), d) for d, files in groups.items()])


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(file, kept, dropped)`` for each file of a path: rows read, and rows with too many fields."""
    groups = _by_dialect(detect_dialects(spark, [path])[path])
    if not groups:
        raise UnreadableFile(path)
    counts = stack([_row_counts(scan_csv(spark, files, d)) for d, files in groups.items()])
    return counts.select(F.col("_file").alias("file"), "kept", "dropped")


class Loaded(NamedTuple):
    """A catalogue, the paths that could not be read, and ``(file, kept, dropped)`` of the others."""

    catalog: DataFrame
    failed: list[str]
    counts: DataFrame


def load_catalog(
    spark: SparkSession,
    paths: list[str],
    roles: dict[str, dict[str, str]] | None = None,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> Loaded:
    """All readable files as one catalogue.

    ``roles`` may fix the role headers of a file by its path. Every row keeps the name of its
    file and gets a ``row_id`` in the order of paths, files of a path by name, and lines. Files of
    one dialect and header are one scan, however many they are. A file of a folder that has no
    rows is passed over.
    """
    dialects = detect_dialects(spark, paths)
    failed = [path for path in paths if not any(dialects[path].values())]
    groups: dict[tuple, list[tuple[int, str]]] = {}
    for i, path in enumerate(paths):
        fixed = (roles or {}).get(path)
        for file, dialect in dialects[path].items():
            if dialect is not None:
                key = (dialect, tuple(sorted(fixed.items())) if fixed is not None else None)
                groups.setdefault(key, []).append((i, file))
    if not groups:
        raise UnreadableFile(", ".join(paths))
    tables, counts = [], []
    for (dialect, fixed), files in groups.items():
        scanned = scan_csv(spark, [f for _, f in files], dialect)
        counts.append(_row_counts(scanned))
        raw = _good_rows(scanned, dialect)
        table = normalize_na(raw, [c for c in raw.columns if c not in PLACE])
        table = unify_schema(table, None if fixed is None else dict(fixed))
        table = with_provenance(table, F.col("_file")).drop("_file")
        where = spark.createDataFrame([(f, i) for i, f in files], "_location string, _table int")
        at = F.regexp_replace(F.url_decode(F.replace("_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
        tables.append(table.withColumn("_location", at).join(where, "_location").drop("_location"))
    order = [F.col("_table"), F.col("_path"), F.col("_block"), F.col("_line")]
    ranked = global_rank(stack(tables), order, "row_id", start=0, single_task_rows=single_task_rows)
    columns = [c for c in ranked.columns if c not in ("_table", "_path", "_block", "_line", "row_id")]
    catalog = with_initial_group(ranked.select("row_id", *[quoted(c) for c in columns]))
    return Loaded(catalog, failed, stack(counts).select(F.col("_file").alias("file"), "kept", "dropped"))


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """CSV with a header; ``order`` sorts the rows across the part files."""
    rows = df if order is None else df.orderBy(order)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Parquet between stages, read back so later stages prune and push down."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
