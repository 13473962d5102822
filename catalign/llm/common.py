"""Pieces the pipeline operators share: stable ranges, bounded filters, groups of linked rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalign.operators.components import connected_components
from catalign.runtime import arrow_rows, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Size of a key filter: 2^23 bits are 1 MB whatever the number of keys. A fuller one lets more rows pass.
FILTER_BITS = 1 << 23
# Members of a bucket that are compared with as many others at once.
BLOCK_MEMBERS = 256
# Bytes of what belongs to the members of a block; larger members make smaller blocks.
BLOCK_BYTES = 1 << 20
# Members that are compared at once, whole buckets as far as they fit; one bucket of more than the limit comes in pieces.
RUN_ROWS, RUN_LIMIT = 100_000, 1_000_000
# A run of so many members is compared by shifting it along itself, one of up to MATRIX_RUN as a matrix.
SHORT_RUN, MATRIX_RUN = 32, 4096
# More near pairs than so many for each member of a run are not written down; the members meet PIVOTS of them instead.
PAIRS_EACH, PIVOTS = 4, 8
# Rows in an Arrow batch while whole texts are compared; 10,000 pairs of them would fill a worker.
TEXT_ROWS = 500
# Rows in an Arrow batch while documents are read one by one: 10,000 of a few KB stand in a worker and the JVM several times.
DOC_ROWS = 2000
# So many links of components are finished by one task.
FINISHED_EDGES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without decoding them."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def text_slices(batch, column: int, limit: int):
    """The Arrow batch cut into runs of rows with about ``limit`` bytes in ``column``; a longer text stands alone."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - 1) // limit
    starts = np.append(0, np.flatnonzero(run[1:] != run[:-1]) + 1)
    for start, end in zip(starts, np.append(starts[1:], batch.num_rows)):
        yield batch.slice(start, end - start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def range_bounds(docs: DataFrame, key: str, part_bytes: int) -> list[int]:
    """Upper-exclusive limits that cut ``key`` into ranges of about ``part_bytes`` of text.

    The limits are approximate quantiles, at most 10,000 of them, found by one aggregate.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(10_000, max(1, math.ceil(size / part_bytes)))
    if parts == 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, shares, 10_000)).first()[0]
    return sorted(set(found or []))


class KeyFilter:
    """Which 64-bit hashes may be in a set: a bitmap of fixed size, with false positives only.

    It thins rows before a shuffle; the join behind it decides. ``keys`` is a column of evenly
    hashed longs. The driver gets at most FILTER_BITS / 64 words, however many keys there are.
    """

    def __init__(self, rows: DataFrame, key: str):
        spot = F.shiftrightunsigned(F.col(key), 64 - int(math.log2(FILTER_BITS)))
        words = (
            rows.select(spot.alias("spot"))
            .groupBy(F.shiftright("spot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
            .toArrow()
        )
        packed = np.zeros(FILTER_BITS // 64, np.int64)
        packed[words["word"].to_numpy()] = words["bits"].to_numpy()
        self._shared = rows.sparkSession.sparkContext.broadcast(packed)

    def mask(self, keys: np.ndarray) -> np.ndarray:
        """For each signed 64-bit key whether it may be in the set."""
        spot = keys.view(np.uint64) >> np.uint64(64 - int(math.log2(FILTER_BITS)))
        word = self._shared.value[(spot >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        return ((word >> (spot & np.uint64(63))) & np.uint64(1)).astype(bool)

    def thin(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be in the set."""

        def passing(batches):
            import pyarrow as pa

            for batch in batches:
                keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(self.mask(keys.astype(np.int64))))

        return rows.mapInArrow(passing, rows.schema)


def give_back() -> None:
    """Return freed memory at the end of a task: its worker is used again by stages that need it elsewhere."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


class KeptTexts:
    """Texts of ids for ``verify``, read from the documents once for all rounds as far as they can be foreseen.

    ``read`` gets new ids and returns ``(id, text)``.
    """

    def __init__(self, read: Callable[[DataFrame], DataFrame]):
        self._read, self._have = read, None

    def of(self, ids: DataFrame, later: DataFrame) -> DataFrame:
        new = ids if self._have is not None else ids.unionByName(later).distinct()
        if self._have is not None:
            new = stage(new.join(self._have.select("id"), "id", "left_anti"), "new")
            if new.isEmpty():
                return self._have
        texts = stage(self._read(new), "texts")
        self._have = texts if self._have is None else self._have.unionByName(texts)
        return self._have


def with_row_ids(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written down with a unique long ``id``; it is given while writing, so it stays."""
    return stage(rows.withColumn("id", F.monotonically_increasing_id()), name)


def linked_groups(
    members: DataFrame,
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    near: Callable[[np.ndarray, np.ndarray], np.ndarray],
    compare: Callable[[int, dict, dict], tuple[np.ndarray, np.ndarray, np.ndarray]],
    payload: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    split: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]] | None = None,
    settled: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
    sure: bool = False,
) -> DataFrame:
    """``(id, component)`` of the ids that links join, links being verified pairs of a bucket.

    ``members(key, id, tag)`` are distinct rows of longs; ids that share a key are candidates,
    ``tag`` belongs to the id. ``verify`` gets ``(a, b)`` and ids that may be in later pairs, and returns the pairs that
    hold (unless ``sure``, those whose ends others of them join may be left out); ``near`` is a cheap condition on two arrays of tags, in either order, that links meet. ``split`` tells for arrays of keys
    and tags which members (positions) have which finer keys, if sharing ``key`` alone makes no candidates.
    ``settled(key, tags, tags)`` leaves out near pairs that another bucket of both settles.

    Members are shuffled once, by key, and each task compares the members of its buckets. Near pairs of a bucket go to
    ``verify``, but of a bucket that has many of them only those with a few pivots, so no bucket is expanded into all
    its pairs. What is linked by then is one component. Then only members of *different* components that still share
    such a crowded bucket are compared with each other, so that no link between two components is lost. That is done in
    blocks of members, whose pairs stay inside a task: ``compare`` gets the bucket's key and two blocks as arrays ``id``,
    ``tag``, ``at`` (the component) and what ``payload(id, data)`` adds (a function gets the ids), and returns the positions of
    the pairs worth verifying and how alike they seem. The first time each member gets its best partner of a block, which
    joins what is left of large groups; what still differs is compared in full. ``compare`` should
    leave out pairs that another bucket of both settles. So a bucket of many that aren't linked makes few rows.
    If ``compare`` is ``sure``, it returns links only, of which a block pair makes no more rows than join its components:
    first each block is compared with itself, then all of them, so that candidates that don't hold make no rows at all.
    Its links are still verified; only if one is refused do all that are left make a row each.
    """
    spark = members.sparkSession

    def meet(batches):
        for (keys, ids, tags), cut in _whole_keys(batches):
            for own, fine in split(keys, tags) if split else [(slice(None), keys)]:
                yield from _met(fine, ids[own], tags[own], near, settled, cut)

    sorted_members = members.select("key", "id", "tag").repartition("key").sortWithinPartitions("key")
    met = stage(sorted_members.mapInArrow(meet, "key bigint, id bigint, tag bigint, other bigint"), "met")
    left = met.filter("other is null").select("key", "id", "tag")
    pairs = met.filter("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))

    crowd = left.select("id").distinct()

    def verified(candidates: DataFrame) -> DataFrame:
        with arrow_rows(spark, TEXT_ROWS):
            return stage(verify(candidates, crowd), "links")

    tested = stage(pairs.distinct(), "pairs")
    groups = _components(verified(tested))
    refused = False
    for step in ("own", "all", "left") if sure else ("best", "all"):
        if step == "left" and not refused:
            break
        known = left.join(groups, "id", "left")
        known = stage(known.select("key", "id", "tag", F.coalesce("component", "id").alias("at")), "known")
        mixed = known.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
        mixed = stage(mixed.filter("lo <> hi").select("key"), "mixed")
        if mixed.isEmpty():
            break
        rest = stage(known.join(mixed, "key"), "rest")
        if payload is not None:
            rest = rest.join(payload(rest.select("id").distinct()) if callable(payload) else payload, "id")
        pairs = _compared_blocks(rest, compare, step, sure and step != "left").distinct()
        pairs = stage(pairs, "proposed") if sure else pairs
        fresh = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            refused = refused or (sure and not pairs.isEmpty())
            if step == "best":
                break
            continue
        found = verified(fresh)
        # A link that doesn't hold after all may have stood for others, which are looked at one by one then.
        refused = refused or (sure and found.count() < pairs.count())
        tested = tested.unionByName(fresh)
        if not found.isEmpty():
            groups = _joined(groups, found)
    return groups


def _whole_keys(batches):
    """The columns of batches sorted by their first one, in pieces that hold all rows of a key.

    With each piece comes whether it is a part of one key only, as such a key has more than RUN_LIMIT rows.
    """
    held, over, wait = None, None, RUN_ROWS
    for batch in batches:
        new = [column.to_numpy() for column in batch.columns]
        if not batch.num_rows:
            continue
        held = [[n] for n in new] if held is None else [h + [n] for h, n in zip(held, new)]
        if sum(map(len, held[0])) < wait:
            continue
        rows = [np.concatenate(h) for h in held]
        if over is not None:
            ends = int(np.searchsorted(rows[0], over, side="right"))
            if ends:
                yield [r[:ends] for r in rows], True
            rows = [r[ends:] for r in rows]
            over = over if not len(rows[0]) else None
        if len(rows[0]):
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield [r[:last] for r in rows], False
            rows = [r[last:] for r in rows]
            if len(rows[0]) >= RUN_LIMIT:
                over = rows[0][-1]
                yield rows, True
                rows = [r[:0] for r in rows]
        held, wait = [[r] for r in rows], max(RUN_ROWS, 2 * len(rows[0]))
    if held is not None:
        rows = [np.concatenate(h) for h in held]
        ends = int(np.searchsorted(rows[0], over, side="right")) if over is not None else 0
        if ends:
            yield [r[:ends] for r in rows], True
        if len(rows[0]) > ends:
            yield [r[ends:] for r in rows], False


def _met(keys, ids, tags, near, settled, cut: bool):
    """Rows ``(key, id, tag, other)``: near pairs of a key, and the members (without ``other``) of crowded keys."""
    import pyarrow as pa

    order = np.argsort(keys, kind="stable")
    keys, ids, tags = keys[order], ids[order], tags[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    run = np.repeat(np.arange(len(starts)), sizes)
    after = (starts + sizes)[run] - np.arange(len(keys)) - 1
    one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    crowded = np.full(len(starts), cut)
    at = np.flatnonzero(~crowded[run] & (sizes[run] <= SHORT_RUN))
    for shift in range(1, SHORT_RUN):
        at = at[after[at] >= shift]
        if not len(at):
            break
        fits = at[near(tags[at], tags[at + shift])]
        one.append(fits)
        two.append(fits + shift)
    for nth in np.flatnonzero((sizes > SHORT_RUN) & ~crowded):
        i, j, full = _run_pairs(tags[starts[nth] : starts[nth] + sizes[nth]], near)
        crowded[nth] = full
        one.append(starts[nth] + i)
        two.append(starts[nth] + j)
    i, j = np.concatenate(one), np.concatenate(two)
    crowded |= np.bincount(run[i], minlength=len(starts)) > PAIRS_EACH * sizes
    kept = ~crowded[run[i]]
    i, j = i[kept], j[kept]
    if settled is not None:
        kept = settled(keys[i], tags[i], tags[j])
        i, j = i[kept], j[kept]
    one, two = [i], [j]
    for nth in np.flatnonzero(crowded):
        i, j = _pivot_pairs(tags[starts[nth] : starts[nth] + sizes[nth]], near)
        one.append(starts[nth] + i)
        two.append(starts[nth] + j)
    i, j, rest = np.concatenate(one), np.concatenate(two), np.flatnonzero(crowded[run])
    names = ["key", "id", "tag", "other"]
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(ids[i]), pa.array(tags[i]), pa.array(ids[j])], names=names)
    if len(rest):
        columns = [pa.array(keys[rest]), pa.array(ids[rest]), pa.array(tags[rest]), pa.nulls(len(rest), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _run_pairs(tags: np.ndarray, near) -> tuple[np.ndarray, np.ndarray, bool]:
    """All near pairs of a run, or none and True if there are many or the run is too long to look."""
    none = np.empty(0, np.int64)
    if len(tags) > MATRIX_RUN:
        return none, none, True
    one, two, total, step = [none], [none], 0, max(1, 1_000_000 // len(tags))
    for start in range(0, len(tags), step):
        i, j = np.nonzero(near(tags[start : start + step, None], tags[None, :]))
        kept = j > i + start
        one.append(i[kept] + start)
        two.append(j[kept])
        total += int(kept.sum())
        if total > PAIRS_EACH * len(tags):
            return none, none, True
    return np.concatenate(one), np.concatenate(two), False


def _pivot_pairs(tags: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a run's first member and all that are near it, then of the first one that is left, and so on."""
    one, two, left = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(tags))
    for _ in range(PIVOTS):
        if len(left) < 2:
            break
        fits = near(np.broadcast_to(tags[left[0]], len(left) - 1), tags[left[1:]])
        hit = left[1:][fits]
        one.append(np.full(len(hit), left[0]))
        two.append(hit)
        left = left[1:][~fits]
    return np.concatenate(one), np.concatenate(two)


def first_common(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of rows the first key that both have in the same column; it names the bucket that settles the pair."""
    out = np.empty(len(i), left.dtype)
    for start in range(0, len(i), 16384):
        one, two = left[i[start : start + 16384]], right[j[start : start + 16384]]
        same = (one == two).argmax(1)
        out[start : start + 16384] = one[np.arange(len(one)), same]
    return out


def _best_partners(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions of the pairs that are the best one of a member on either side."""
    order = np.argsort(-score, kind="stable")
    best = [order[np.unique(side[order], return_index=True)[1]] for side in (i, j)]
    return np.unique(np.concatenate(best))


def _joining(i: np.ndarray, j: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) are needed to join the components ``one[i]`` and ``two[j]`` that all of them join."""
    every, places = np.unique(np.concatenate([one[i], two[j]]), return_inverse=True)
    root, needed = list(range(len(every))), []

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    # Pairs of the same two components say the same.
    pairs, first = np.unique(np.stack([places[: len(i)], places[len(i) :]], axis=1), axis=0, return_index=True)
    for (x, y), nth in zip(pairs.tolist(), first.tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[x] = y
            needed.append(nth)
    return np.array(needed, np.int64)


def _compared_blocks(rest: DataFrame, compare, step: str, sure: bool) -> DataFrame:
    """Pairs ``(a, b)`` of different components in a bucket that ``compare`` keeps: all, the best of each member, or those
    of a block's own members; of sure ones what joins the components of two blocks."""
    fields = [c for c in ("id", "tag", "at", "data") if c in rest.columns]
    parts = F.count("*") / BLOCK_MEMBERS
    if "data" in fields:
        parts = F.greatest(parts, F.sum(F.length("data")) / BLOCK_BYTES)
    sizes = rest.groupBy("key").agg(F.ceil(parts).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    split = rest.join(sizes, "key").groupBy("key", "parts", part.alias("part"))
    # A block holds about BLOCK_MEMBERS members: the bucket was cut by a hash into that many parts.
    packed = stage(split.agg(F.collect_list(F.struct(*fields)).alias("rows")), "blocks")
    others = F.sequence("part", F.col("part") if step == "own" else F.col("parts") - 1)
    left = packed.select("key", F.col("rows").alias("one"), F.explode(others).alias("part"))
    met = left.join(packed.select("key", "part", F.col("rows").alias("two")), ["key", "part"]).select("key", "one", "two")

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            sides = []
            for column in batch.columns[1:]:
                rows = column.flatten()
                ends = np.cumsum(column.value_lengths().to_numpy())
                own = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
                own = {n: v.to_numpy(zero_copy_only=False) for n, v in own.items()}
                sides.append([{n: v[s:e] for n, v in own.items()} for s, e in zip(np.append(0, ends[:-1]), ends)])
            for key, one, two in zip(batch.column(0).to_pylist(), *sides):
                i, j, score = compare(key, one, two)
                if len(i) and (sure or step == "best"):
                    some = _joining(i, j, one["at"], two["at"]) if sure else _best_partners(i, j, score)
                    i, j = i[some], j[some]
                a, b = one["id"][i], two["id"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return met.mapInArrow(kept, "a bigint, b bigint")


def _components(links: DataFrame) -> DataFrame:
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return stage(connected_components(nodes, edges, single_task_edges=FINISHED_EDGES), "groups")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups(id, component)`` after more links: only components that these touch are looked at again."""
    side = lambda end: groups.select(F.col("id").alias(end), F.col("component").alias(f"{end}_at"))
    both = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    both = stage(both.select("a", "b", F.coalesce("a_at", "a").alias("a_at"), F.coalesce("b_at", "b").alias("b_at")), "touched")
    merged = _components(both.select(F.col("a_at").alias("a"), F.col("b_at").alias("b")))
    ends = both.select(F.col("a").alias("id"), F.col("a_at").alias("at")).unionByName(both.select(F.col("b").alias("id"), F.col("b_at").alias("at")))
    every = groups.select("id", F.col("component").alias("at")).unionByName(ends.distinct().join(groups, "id", "left_anti"))
    to = merged.select(F.col("id").alias("at"), F.col("component").alias("to"))
    return stage(every.join(to, "at", "left").select("id", F.coalesce("to", "at").alias("component")), "groups")
