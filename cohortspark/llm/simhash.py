"""SimHash near-duplicates: links between fingerprints that differ in few bits, and their connected groups.

Block keys propose pairs: of five blocks two at least agree if three bits differ, so each of the ten pairs of blocks
is a key. Pivot distance tables then filter. Within a key, each fingerprint has a table of Hamming distances to fixed
random reference fingerprints; by the triangle inequality two tables that differ by more than the limit in any
coordinate belong to fingerprints that differ by more, and the pair is discarded. Survivors are verified.

`groups` is exact so, and `keep_linked` keeps one row of each of its groups. Near copies of texts, a similarity of 0.8
on five words, often differ by more bits than three; for them `keep_one`, another method, takes keys of smallest hashes
(`nearcopies`) and compares the shingle sets themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import nearcopies
from cohortspark.llm.bpe import id_type
from cohortspark.llm.common import free_names, map_batches, parts, ship, slices, store

BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
PIVOTS = 16
CROWD = 4096  # a key with more fingerprints is divided by further bits


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words joined by a space; fewer words are one shingle."""
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths + 1) - lengths - 1
    ends = (begins + lengths)[size - 1 :].tolist()
    return [joined[a:b] for a, b in zip(begins[: len(ends)].tolist(), ends)]


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: A-Z only, and the six blanks of ASCII


def margins(hashes: np.ndarray) -> np.ndarray:
    """For each bit twice the number of hashes (rows of bytes) that have it, less their number."""
    counts = np.zeros(8 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * counts - len(hashes)


def _narrow(words: list[bytes], size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, 42) for x in shingles(words, size)], "<u8")
    return margins(hashes.view(np.uint8).reshape(-1, 8))


def fingerprint(text: str, size: int = 3) -> int:
    """SimHash of the word shingles of a text, as an unsigned number; 0 without a word."""
    words = words_of(text)
    return int(np.packbits(_narrow(words, size) > 0, bitorder="little").view("<u8")[0]) if words else 0


def five_words(text: str) -> np.ndarray:
    """The sorted distinct hashes of the five-word shingles of a text; none without a word."""
    words = words_of(text)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(x) for x in shingles(words, 5)] if words else [], "<u8"))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, bits bigint): the fingerprint of each whole text as a signed number; a null text has no word."""

    def run(batch):
        bits = [fingerprint(t or "", size) for t in batch.column(1).to_pylist()]
        return batch.column(0), pa.array(np.array(bits, np.uint64).view(np.int64))

    return map_batches(docs, [id_column, text], run, f"doc_id {id_type(docs, id_column)}, bits bigint")


def references() -> np.ndarray:
    """The fixed random reference fingerprints."""
    return np.random.default_rng(3).integers(0, 1 << 64, PIVOTS, dtype=np.uint64, endpoint=False)


def linked_groups(bits: np.ndarray, limit: int, table: np.ndarray) -> list[tuple[int, int]]:
    """(first, member) for each member of a connected group but the first; positions in `bits`.

    Each fingerprint is compared once with those not yet reached: pivot tables first, then the bits themselves.
    """
    rest = np.arange(len(bits))
    out = []
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), 64):
                some = front[i : i + 64]
                open_rows = np.flatnonzero(~near)
                for j in range(0, len(open_rows), 4096):
                    rows = open_rows[j : j + 4096]
                    apart = np.abs(table[some][:, None, :] - table[rest[rows]][None]).max(axis=2)
                    a, b = np.nonzero(apart <= limit)
                    close = np.bitwise_count(bits[some[a]] ^ bits[rest[rows[b]]]) <= limit
                    near[rows[b[close]]] = True
            front, rest = rest[near], rest[~near]
            out += [(root, int(x)) for x in front]
    return out


def _spread(distinct: DataFrame) -> DataFrame:
    """A row for each pair of blocks: (key, mask, bits, node); mask has the bits that the key fixes."""
    keys = []
    for (a, n), (b, m) in combinations(BLOCKS, 2):
        mask = ((1 << n) - 1 << a) | ((1 << m) - 1 << b)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.xxhash64(F.col("bits").bitwiseAND(F.lit(mask)), F.lit(mask)).alias("key"), F.lit(mask).alias("mask")))
    return distinct.withColumn("k", F.explode(F.array(*keys))).select("k.key", "k.mask", "bits", "node")


def _refine(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of crowded keys with finer keys: of the bits left, one part of limit + 1 agrees for any link."""

    def run(batch):
        key, mask, bits = (batch.column(i) for i in range(3))
        out = [[], [], []]
        take = []
        for row, (k, m) in enumerate(zip(key.to_pylist(), mask.to_pylist())):
            free = [b for b in range(64) if not (m >> b) & 1]
            for part in range(limit + 1):
                chosen = sum(1 << b for b in free[part :: limit + 1])
                value = bits[row].as_py() & ((1 << 64) - 1) & chosen
                finer = (m & ((1 << 64) - 1)) | chosen
                digest = xxhash.xxh64_intdigest(f"{k}:{finer}:{value}".encode())
                out[0].append(digest - ((digest >> 63) << 64))
                out[1].append(finer - ((finer >> 63) << 64))
                take.append(row)
        take = pa.array(take, pa.int64())
        return out[0], out[1], *[x.take(take) for x in batch.columns[2:]]

    schema = f"key bigint, mask bigint, bits bigint, node {id_type(rows, 'node')}"
    return map_batches(rows, rows.columns, run, schema)


def links(distinct: DataFrame, limit: int = 3, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs of at most `limit` differing bits would.

    distinct: (bits, node), one row a fingerprint. Within a key only a spanning forest of its links comes out,
    so rows grow with the fingerprints and not with the square of a group. Keys with more than `crowd` rows are
    counted with partial sums, never gathered: their rows get finer keys, again and again; when fewer than
    sixteen bits are free, a key holds at most 2^16 fingerprints, whatever the data. The five blocks are keys for
    three bits and no more, so a larger limit is an error.
    """
    if limit > 3:
        raise ValueError("pairs of five blocks find no more than three differing bits")
    spark = distinct.sparkSession
    ship(spark)
    kind = id_type(distinct, "node")
    columns = ["key", "bits", "node"]

    def run(batches):
        pivots = references()
        held: list[tuple] = []  # parts of the key that is being read

        def done():
            bits = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.uint64)
            if len(bits) < 2:
                return None
            nodes = pa.concat_arrays([x[1] for x in held])
            table = np.bitwise_count(bits[:, None] ^ pivots).astype(np.int8)
            found = linked_groups(bits, limit, table)
            if not found:
                return None
            ends = [nodes.take(pa.array(x)) for x in zip(*found)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        last = None
        for batch in slices(batches, 8192):
            key = batch.column(0).to_numpy()
            bits = batch.column(1).to_numpy().view(np.uint64)
            ends = np.flatnonzero(np.append(np.diff(key) != 0, True)) + 1
            begin = 0
            for end in ends.tolist():
                if key[begin] != last:
                    if (out := done()) is not None:
                        yield out
                    held, last = [], key[begin]
                held.append((bits[begin:end], batch.column(2).slice(begin, end - begin)))
                begin = end
        if (out := done()) is not None:
            yield out

    found = []
    rows = _spread(distinct)
    for level in range(8):
        crowded = rows.groupBy("key", "mask").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
        crowded = store(crowded.where(F.bit_count("mask") < 48).select("key"), "crowded")
        some = not crowded.isEmpty()
        quiet = rows.join(crowded, "key", "left_anti") if some else rows
        dealt = quiet.select(columns).repartition(parts(spark), "key").sortWithinPartitions("key")
        found.append(store(dealt.mapInArrow(run, f"a {kind}, b {kind}"), "links"))
        if not some:
            break
        rows = store(_refine(rows.join(crowded, "key", "left_semi"), limit), f"keys-{level}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Alternates two star operations, each a partial minimum by node joined back to the edges; chains shrink by half
    at least, so rounds grow with the logarithm of the longest. Rounds are stored in the shared folder.
    """

    def both(e):
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def with_least(e, grouped):
        least = grouped.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "of")
        return e.join(least, e.a == least.of)

    edges = store(edges.where("a <> b").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while (now := mark(edges)) != before:
        before = now
        sides = both(edges)
        large = with_least(sides, sides).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        stars = with_least(down, down)
        small = stars.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(stars.select("a", F.col("m").alias("b")))
        edges = store(small.where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _own_keys(docs: DataFrame, id_column: str, text: str) -> tuple[DataFrame, str, str]:
    """The rows with their id as a string that tells null from empty, and the digest of their text; the columns' names."""
    own_d, own_k = free_names(docs, "_d", "_k")
    keyed = docs.withColumns({
        own_d: F.concat(F.when(F.isnull(id_column), F.lit("-")).otherwise(F.lit("=")), F.coalesce(F.col(id_column).cast("string"), F.lit(""))),
        own_k: F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))),
    })
    return keyed, own_d, own_k


def _first_rows(keyed: DataFrame, own_d: str, own_k: str, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that come first in each component; distinct: (node, first), found: (node, component) of linked nodes."""
    kept_d, kept_k = free_names(keyed, "_kept_d", "_kept_k")
    named = distinct.join(found, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.d").alias(kept_d), F.col("first.k").alias(kept_k))
    same = (F.col(own_d) == F.col(kept_d)) & (F.col(own_k) == F.col(kept_k))
    chosen = keyed.join(kept, same, "left_semi")
    return chosen.dropDuplicates([own_d, own_k]).drop(own_d, own_k)


def first_row() -> Column:
    """The order of rows (id, d, k) in a group: nulls last."""
    return F.struct(F.isnull("id").alias("n"), "id", "d", "k")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", crowd: int = nearcopies.CROWD) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id, nulls last.

    Near copies: texts whose sets of five-word shingles have a similarity of 0.8 or more, and what such texts connect.
    Texts are not stored: the rows chosen are found again by id and digest, and of rows that repeat both exactly one
    stays. Null and empty texts are copies of each other. An empty table gives no row.
    """
    keyed, own_d, own_k = _own_keys(docs, id_column, text)

    def run(batch):
        return *batch.columns[:3], *zip(*[nearcopies.marks(five_words(t or "")) for t in batch.column(3).to_pylist()])

    schema = f"id {id_type(docs, id_column)}, d string, k binary, digest binary, n int, keys array<bigint>"
    rows = store(map_batches(keyed, [id_column, own_d, own_k, text], run, schema), "marked")
    distinct = rows.groupBy("digest").agg(F.min(first_row()).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    distinct = store(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")

    def sets(nodes: DataFrame) -> DataFrame:
        """(node, hashes array<bigint>) of some nodes, from the texts of their first documents."""
        wanted = distinct.join(nodes, "node", "left_semi").select("node", F.col("first.d").alias("of_d"), F.col("first.k").alias("of_k"))
        texts = keyed.select(F.col(own_d).alias("d"), F.col(own_k).alias("k"), F.col(text).alias("t"))
        texts = texts.join(wanted, (F.col("d") == F.col("of_d")) & (F.col("k") == F.col("of_k")))
        hashed = lambda batch: (batch.column(0), [five_words(t or "").view(np.int64) for t in batch.column(1).to_pylist()])
        return map_batches(texts, ["node", "t"], hashed, "node bigint, hashes array<bigint>").dropDuplicates(["node"])

    found = components(nearcopies.links(distinct, sets, components, crowd))
    return _first_rows(keyed, own_d, own_k, distinct, found)


def keep_linked(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3, limit: int = 3, crowd: int = CROWD
) -> DataFrame:
    """One row of each group that `groups` finds, with all its columns: that of the smallest id, nulls last.

    Pivot tables filter and bits decide, as there. Fingerprints alone are stored and linked, a node for each distinct
    one, so copies cost one partial minimum; texts are shuffled once, to meet the rows that are kept.
    """
    keyed, own_d, own_k = _own_keys(docs, id_column, text)

    def run(batch):
        bits = [fingerprint(t or "", size) for t in batch.column(3).to_pylist()]
        return *batch.columns[:3], pa.array(np.array(bits, np.uint64).view(np.int64))

    schema = f"id {id_type(docs, id_column)}, d string, k binary, bits bigint"
    rows = map_batches(keyed, [id_column, own_d, own_k, text], run, schema)
    distinct = rows.groupBy("bits").agg(F.min(first_row()).alias("first"))
    distinct = store(distinct.withColumn("node", F.col("bits")), "distinct")
    found = components(links(distinct.select("bits", "node"), limit, crowd))
    return _first_rows(keyed, own_d, own_k, distinct, found)


def groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3, limit: int = 3, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, bits, component_id) of every document: its fingerprint, and the smallest id that links reach.

    Documents of one fingerprint are one node from the start, so copies cost one partial minimum. Null and empty
    texts share the fingerprint 0 and are linked by it like any other. A null id stays, and never is the smallest
    unless the group has no other (then component_id is null). Repeated rows stay; an empty table gives none.
    """
    marked = store(fingerprints(docs, id_column, text, size), "fingerprints")
    distinct = store(marked.groupBy("bits").agg(F.min("doc_id").alias("node")), "distinct")
    found = components(links(distinct.where("node is not null"), limit, crowd))
    named = distinct.join(found, "node", "left").select(
        F.col("bits").alias("of"), F.coalesce("component", "node").alias("component_id")
    )
    return marked.join(named, marked.bits == named.of, "left").select("doc_id", "bits", "component_id")
