"""URL judgement: host and path rules first, then exact list membership by a Bloom filter cascade."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalign.llm.common import LOWER, UPPER, mix64
from catalign.runtime import stage

# Keys of one shard of the cascade, which one task builds.
SHARD_KEYS = 100_000
# Bytes of filters that are broadcast at once; more filters mean more passes, not more memory.
WAVE_BYTES = 64 << 20
MAX_LEVELS = 64


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for a null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else null.

    ``rules`` are (verdict, "host/path") and meant to be tens of entries, since each is an
    expression; long lists belong into the cascade. Of rules of equal length the one with the
    longer host wins; a rule given with both verdicts blocks.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    split = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    for v, r, h, p in sorted(split, key=lambda x: (len(x[1]), len(x[2]), x[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _spots(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x, y = mix64(h1 ^ salt), mix64(h2 + salt) | np.uint64(1)
    return (x + np.arange(hashes, dtype=np.uint64)[:, None] * y) % np.uint64(bits)


def _passes(level: int, packed: np.ndarray, hashes: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    spots = _spots(h1, h2, level, len(packed) * 8, hashes)
    return ((packed[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, bytes]]:
    """The levels ``(hashes, bits)`` that tell listed from other keys without error.

    Odd levels hold listed keys, even ones the other keys that pass the level before. It ends
    when nothing passes wrongly. Two keys with the same 128-bit hash would never end it: ValueError.
    """
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, bytes]] = []
    while len(inside):
        if len(levels) >= MAX_LEVELS:
            raise ValueError("a listed and an unlisted key have the same 128-bit hash")
        rate = 0.5 if levels else min(0.5, max(1e-6, len(inside) / max(1, len(outside)) * 0.5**0.5))
        hashes = max(1, round(-math.log2(rate)))
        packed = np.zeros(max(8, math.ceil(len(inside) * hashes / math.log(2) / 8)), np.uint8)
        spots = _spots(h1[inside], h2[inside], len(levels), len(packed) * 8, hashes).ravel()
        np.bitwise_or.at(packed, spots >> np.uint64(3), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
        wrong = outside[_passes(len(levels), packed, hashes, h1[outside], h2[outside])] if len(outside) else outside
        levels.append((hashes, packed.tobytes()))
        inside, outside = wrong, inside
    return levels


def probe(levels: list[tuple[int, bytes]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: a key leaves at the first level it doesn't pass."""
    listed = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for level, (hashes, packed) in enumerate(levels):
        passed = _passes(level, np.frombuffer(packed, np.uint8), hashes, h1[left], h2[left])
        listed[left[~passed]] = level % 2 == 1
        left = left[passed]
    listed[left] = len(levels) % 2 == 1
    return listed


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def build_cascade(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """``(shard, levels)`` for a ``universe(key)`` of all keys and the ``listed(key)`` among them.

    Repeats are fine, null keys count as empty ones; listed keys outside the universe are added
    to it. Each shard is built by one task from 17 bytes a key.
    """
    empty = lambda df: df.select(F.coalesce("key", F.lit("")).alias("key"))
    keys = (
        empty(universe).withColumn("listed", F.lit(False))
        .unionByName(empty(listed).withColumn("listed", F.lit(True)))
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
    )
    keys = stage(keys.select(*_hashed(F.col("key")), "listed"), "keys")
    shards = max(1, math.ceil(keys.count() / shard_keys))

    def build(group):
        import pandas as pd

        found = build_levels(
            group["h1"].to_numpy(np.int64).view(np.uint64),
            group["h2"].to_numpy(np.int64).view(np.uint64),
            group["listed"].to_numpy(bool),
        )
        return pd.DataFrame(
            {"shard": [group["shard"].iloc[0]], "hashes": [[h for h, _ in found]], "bits": [[b for _, b in found]]}
        )

    rows = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    filters = rows.groupBy("shard").applyInPandas(build, "shard int, hashes array<int>, bits array<binary>")
    return stage(filters, "cascade"), shards


def with_membership(rows: DataFrame, key: Column, cascade: DataFrame, shards: int, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``rows`` plus a boolean ``listed``, without a join or a shuffle.

    Filters are broadcast in waves of at most ``wave_bytes`` by their measured size; each wave
    judges the rows whose shard it holds.
    """
    size = cascade.agg(F.sum(F.aggregate("bits", F.lit(0), lambda n, b: n + F.octet_length(b)))).first()[0] or 0
    waves = max(1, math.ceil(size / wave_bytes))
    hashed = rows.select("*", *_hashed(F.coalesce(key, F.lit(""))))
    hashed = hashed.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    schema = rows.select("*", F.lit(True).alias("listed")).schema
    parts = []
    for wave in range(waves):
        here = cascade.filter(F.pmod("shard", F.lit(waves)) == wave).collect()
        shared = rows.sparkSession.sparkContext.broadcast({r.shard: list(zip(r.hashes, map(bytes, r.bits))) for r in here})

        def judged(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                h1, h2, shard = (batch.column(batch.num_columns - 3 + i).to_numpy() for i in range(3))
                h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
                listed = np.zeros(batch.num_rows, bool)
                order = np.argsort(shard, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    if len(own):
                        listed[own] = probe(shared.value.get(int(shard[own[0]]), []), h1[own], h2[own])
                kept = [batch.column(i) for i in range(batch.num_columns - 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(listed)], names=schema.names)

        parts.append(hashed.filter(F.pmod("shard", F.lit(waves)) == wave).mapInArrow(judged, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages(page_id, url)``.

    A fitting rule decides; else the url is blocked exactly if its key, host plus path, is in
    ``listed(key)``. Null and malformed urls have the empty key. Repeated rows are judged one
    by one; other columns of ``pages`` are ignored; an empty table gives an empty result.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    key = F.concat("host", "path")
    cascade, shards = build_cascade(rows.select(key.alias("key")), listed, shard_keys)
    found = with_membership(rows, key, cascade, shards)
    verdict = F.coalesce("verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
