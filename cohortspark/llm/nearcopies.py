"""Pairs of sets with a similarity of 0.8 or more: keys propose them, the sets themselves decide.

A key is a run of five smallest hashes of a set under five orders. Two sets of similarity s share one with the
probability s^5, and one of the 48 keys surely but for (1 - 0.8^5)^48 = 5e-9 at 0.8. A passage that very many texts
have does not bring them under one key, as their sets are not alike. Every pair proposed is decided by its exact
similarity; no sketch accepts or rejects one.

Rows of a key that are connected already need no comparison, so large groups are first connected through a hub, one
pair a row; then every pair of a key that is not connected yet is compared. Crowded keys are dealt out in tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import parts, ship, slices, store

BANDS, RUN = 48, 5
CROWD = 4096  # a key with more rows is compared in tiles of about this many
HUBS = 4  # rounds of hubs at most
MANY = 16  # pairs a row that are compared without a further hub
_RNG = np.random.default_rng(11)
FLIPS = _RNG.integers(0, 1 << 32, BANDS * RUN, dtype=np.uint32)[:, None]
FACTORS = _RNG.integers(0, 1 << 32, (2, BANDS * RUN), dtype=np.uint32)[:, :, None] | np.uint32(1)


def marks(hashes: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """(digest of a set, its size, its keys); hashes: sorted, distinct. The empty set has no key."""
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    if not len(hashes):
        return digest, 0, np.zeros(0, np.int64)
    halves = np.ascontiguousarray(hashes, "<u8").view(np.uint32).reshape(-1, 2)
    least = np.full(BANDS * RUN, 0xFFFFFFFF, np.uint32)
    half = BANDS * RUN // 2
    for at in range(0, len(halves), 1024):
        for side in (0, 1):
            some = slice(side * half, (side + 1) * half)
            mixed = halves[at : at + 1024, side][None] ^ FLIPS[some]
            mixed *= FACTORS[0, some]
            mixed ^= mixed >> np.uint32(15)
            mixed *= FACTORS[1, some]
            np.minimum(least[some], mixed.min(axis=1), out=least[some])
    keys = [xxhash.xxh3_64_intdigest(run.tobytes(), i) for i, run in enumerate(least.reshape(BANDS, RUN))]
    return digest, len(hashes), np.array(keys, np.uint64).view(np.int64)


def alike(a: Column, b: Column) -> Column:
    """Whether two sets (arrays of distinct hashes) have a similarity of 0.8 or more."""
    common = F.size(F.array_intersect(a, b))
    return 5 * common >= 4 * (F.size(a) + F.size(b) - common)


def _decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike. Sets are compared row by row inside the join's task, never in batches."""
    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(first, "a").join(second, "b").where(alike(F.col("ha"), F.col("hb"))).select("a", "b")


def _hub_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """(a, b): one row of each key with those that are not connected to it."""
    hub = F.min(F.struct(F.xxhash64("node", F.lit(seed)), "node", "n", "component")).alias("hub")
    open_keys = rows.groupBy("key").agg(hub, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    met = rows.join(open_keys, "key").where("component <> hub.component and 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _all_pairs(rows: DataFrame, crowd: int) -> DataFrame:
    """(a, b): all pairs of a key that are not connected and whose sizes allow for 0.8.

    A key with more than `crowd` rows is cut into blocks by hash; each pair of blocks is a tile of its own, so no task
    needs more than about two blocks of a key.
    """
    ship(rows.sparkSession)
    low, high = F.min("component").alias("low"), F.max("component").alias("high")
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("blocks"), low, high)
    cut = rows.join(sizes.where("low < high").select("key", "blocks"), "key")
    cut = cut.withColumn("block", F.expr("cast(pmod(xxhash64(node, 99), blocks) as int)"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    alone = F.col("block") == F.col("other")
    dealt = cut.select(tile.alias("tile"), "key", "node", "n", "component", "block", alone.alias("alone"))
    dealt = dealt.repartition(parts(rows.sparkSession), "tile").sortWithinPartitions("tile", "key")

    def pairs(node, n, component, block, alone):
        for i in range(0, len(node) - 1, 64):
            some = slice(i, i + 64)
            fits = component[some, None] != component[None]
            fits &= 5 * np.minimum(n[some, None], n[None]) >= 4 * np.maximum(n[some, None], n[None])
            fits &= (block[some, None] != block[None]) | (alone[some, None] & alone[None])
            fits &= node[some, None] < node[None]
            a, b = np.nonzero(fits)
            for j in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(node[some][a[j : j + (1 << 16)]]), pa.array(node[b[j : j + (1 << 16)]])], names=["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in slices(batches, 8192):
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            changes = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            for begin, end in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
                now = (columns[0][begin], columns[1][begin])
                if held and now != last:
                    yield from pairs(*map(np.concatenate, zip(*held)))
                    held = []
                held.append([c[begin:end] for c in columns[2:]])
                last = now
        if held:
            yield from pairs(*map(np.concatenate, zip(*held)))

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def links(
    distinct: DataFrame,
    sets: Callable[[DataFrame], DataFrame],
    components: Callable[[DataFrame], DataFrame],
    crowd: int = CROWD,
    many: float = MANY,
) -> DataFrame:
    """(a, b): pairs of alike sets that connect all sets that such pairs connect.

    distinct: (node, n, keys). sets gives (node, hashes) of the nodes asked for; components the (node, component) of
    links. Hubs only spare comparisons: after them every pair of a key that is still apart is compared.
    """
    spread = distinct.select("node", "n", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    rows = store(spread.join(shared, "key", "left_semi"), "shared-keys")
    held = store(sets(rows.select("node").distinct()), "sets")
    found = distinct.sparkSession.createDataFrame([], "a bigint, b bigint")
    now = rows.withColumn("component", F.col("node"))
    for seed in range(HUBS):
        each = now.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("c"))
        each = each.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"))
        total, apart = each.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()
        if not apart:
            return found
        if apart <= many * total:
            break
        found = store(found.unionByName(_decided(_hub_pairs(now, seed), held)), "links")
        now = store(rows.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node")), "connected")
    return store(found.unionByName(_decided(_all_pairs(now, crowd), held)), "links")
