"""Fuzzy joins of short texts (names of categories, columns, products).

The join is exact: blocking keys come from overlap bounds that every pair above
the threshold meets, so nothing is lost, and nothing is capped. Keys that many
texts share are cut into blocks of bounded size and pairs of blocks become
separate rows, so no task holds a whole key; a task emits only pairs that pass.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalign.functions.strings import MEASURES, bag
from catalign.operators.components import connected_components
from catalign.runtime import lookup, spread, stage

BLOCK_ROWS = 512
SEPARATOR = "\x1f"
# Tokens beyond this many count as rare; any fixed order keeps the join exact.
RANKED_TOKENS = 10_000


def _token_order(values: DataFrame) -> dict[str, int]:
    """Ranks of character tokens, rare first. The table is bounded by the limit."""

    def count(batches):
        import pandas as pd
        from collections import Counter

        for batch in batches:
            seen = Counter(t for text in batch["text"] for t in bag(text))
            if seen:
                yield pd.DataFrame({"token": list(seen), "n": list(seen.values())})

    common = (
        values.select("text")
        .mapInPandas(count, "token string, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(RANKED_TOKENS)
        .collect()
    )
    return {row["token"]: len(common) - i for i, row in enumerate(common)}


def fuzzy_pairs(
    values: DataFrame,
    method: str,
    threshold: float,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All unordered pairs of ``values(id, text)`` scoring at least ``threshold``.

    Returns ``text1 < text2`` and the score. Two sets sharing ``a`` tokens share
    at least ``k`` of their ``size - a + k`` rarest ones, so each text is keyed
    by the ``k``-subsets of that many rarest tokens.
    """
    measure = MEASURES[method](threshold)
    values = stage(values.select("text").distinct(), "texts")
    order = _token_order(values)

    def keys(batches):
        import pandas as pd

        for batch in batches:
            out_key, out_text = [], []
            for text in batch["text"]:
                tokens = _rarest_first(text, order)
                found = set()
                for way in measure.ways(text):
                    for size in way.sizes:
                        take = tokens[: len(tokens) - way.least + size]
                        found.update((way.number, way.extra, *c) for c in itertools.combinations(take, size))
                out_key.extend(SEPARATOR.join(map(str, k)) for k in found)
                out_text.extend([text] * len(found))
            if out_key:
                yield pd.DataFrame({"key": out_key, "text": out_text})

    keyed = spread(values).mapInPandas(keys, "key string, text string")
    blocks = _blocks(stage(keyed, "keyed"), block_rows)

    def verify(batches):
        import pandas as pd

        for batch in batches:
            left, right, score = [], [], []
            for key, a, b in zip(batch["key"], batch["left"], batch["right"]):
                for x, y, s in _block_matches(measure, order, key, a, b):
                    left.append(x)
                    right.append(y)
                    score.append(s)
            if left:
                yield pd.DataFrame({"text1": left, "text2": right, "score": score})

    return spread(blocks).mapInPandas(verify, "text1 string, text2 string, score double").distinct()


def score_pairs(pairs: DataFrame, method: str, threshold: float) -> DataFrame:
    """``pairs(text1, text2, …)`` that score at least ``threshold``, each compared directly."""
    measure = MEASURES[method](threshold)

    def score(batches):
        for batch in batches:
            found = [measure.score(a, b) for a, b in zip(batch["text1"], batch["text2"])]
            batch = batch.assign(score=found)
            yield batch[batch["score"] >= threshold]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return spread(pairs).mapInPandas(score, fields + ", score double")


def _rarest_first(text: str, order: dict[str, int]) -> list[str]:
    return sorted(bag(text), key=lambda t: (order.get(t, 0), t))


def _blocks(keyed: DataFrame, block_rows: int) -> DataFrame:
    """Rows ``(key, left, right)`` of text lists; ``right`` is null for one block alone."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = stage(sizes.filter("n > 1"), "sizes")
    hot = shared.filter(F.col("n") > block_rows).select(
        "key", F.ceil(F.col("n") / block_rows).cast("int").alias("parts")
    )
    split = lookup(keyed.join(shared.select("key"), "key", "left_semi"), hot, "key").select(
        "key",
        "text",
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.pmod(F.xxhash64("text", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int").alias("part"),
    )
    # A block holds about block_rows texts: its key was cut by a hash into that many parts.
    packed = split.groupBy("key", "parts", "part").agg(F.collect_list("text").alias("texts"))
    packed = stage(packed, "blocks")
    alone = packed.select("key", F.col("texts").alias("left"), F.lit(None).cast("array<string>").alias("right"))
    later = packed.filter("part < parts - 1").select(
        "key", F.col("texts").alias("left"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part")
    )
    crossed = later.join(packed.select("key", "part", F.col("texts").alias("right")), ["key", "part"])
    return alone.unionByName(crossed.select("key", "left", "right"))


def _block_matches(measure, order, key, left, right):
    """Pairs of one block (or two) that pass; each pair counts in one block only.

    Of the keys a pair shares, the one made of its rarest common tokens checks
    it, so a pair that meets under many keys is scored once.
    """
    import numpy as np

    number, _, *tokens = key.split(SEPARATOR)
    number = int(number)
    alone = right is None
    left = list(left)
    right = left if alone else list(right)
    la = np.array([len(x) for x in left], dtype=float)[:, None]
    lb = np.array([len(x) for x in right], dtype=float)[None, :]
    needed = measure.needed(number, la, lb) - 1e-6
    hit = np.minimum(la, lb) >= needed
    moved = measure.elsewhere(number, left, right)
    if moved is not None:
        hit &= ~moved
    if alone:
        hit &= np.triu(np.ones(hit.shape, dtype=bool), 1)
    if tokens and hit.any():
        last = max((order.get(t, 0), t) for t in tokens)
        rarer = lambda texts: [_rarer_than(measure, order, number, len(tokens), t, last) for t in texts]
        hit &= _overlap(rarer(left), None if alone else rarer(right)) == len(tokens) - 1
    if hit.any():
        hit &= _overlap([bag(t) for t in left], None if alone else [bag(t) for t in right]) >= needed
    for i, j in zip(*np.nonzero(hit)):
        a, b = left[i], right[j]
        if a == b:
            continue
        if a > b:
            a, b = b, a
        score = measure.score(a, b)
        if score >= measure.threshold:
            yield a, b, score


def _rarer_than(measure, order, number, size, text, last):
    """The text's blocking tokens that are rarer than the last token of the key."""
    way = next(w for w in measure.ways(text) if w.number == number)
    tokens = _rarest_first(text, order)
    return [t for t in tokens[: len(tokens) - way.least + size] if (order.get(t, 0), t) < last]


def _overlap(left: list[list[str]], right: list[list[str]] | None):
    """Number of shared tokens for every pair of token lists."""
    columns: dict[str, int] = {}
    index = lambda rows: [[columns.setdefault(t, len(columns)) for t in row] for row in rows]
    rows_l = index(left)
    rows_r = rows_l if right is None else index(right)
    a = _indicator(rows_l, len(columns))
    return a @ (a if right is None else _indicator(rows_r, len(columns))).T


def _indicator(rows, width):
    import numpy as np

    out = np.zeros((len(rows), width), dtype=np.float32)
    for i, tokens in enumerate(rows):
        out[i, tokens] = 1.0
    return out


def link_values(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Group texts connected by similar pairs; the smallest text names the group."""
    nodes = values.select(F.col("text").alias("id")).distinct()
    edges = pairs.select(F.col("text1").alias("src"), F.col("text2").alias("dst"))
    return connected_components(nodes, edges).select(
        F.col("id").alias("text"), F.col("component").alias("linked_to")
    )
