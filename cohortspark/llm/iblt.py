"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraph pieces, each with the number of its earlier equals. A sketch puts each digest
into three cells that hold a count, and the exclusive or of digests and of checks. Cells of two versions are
subtracted; what both have cancels out, and peeling cells that hold a single digest brings back the digests that
differ. If peeling gets stuck, both texts are sketched again with more cells.
"""

from __future__ import annotations

import bisect
import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bpe import id_type
from cohortspark.llm.common import arrow_type, map_batches, parts, ship, slices

CELLS = 12  # of the stored fingerprint; a multiple of three
LONGEST = 64  # code points of a paragraph piece
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
CHECK = np.uint64(0xD6E8FEB86659FD93)


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's pieces: lines with a character, cut every LONGEST code points."""
    seen: dict[str, int] = {}
    out = []
    for line in text.split("\n"):
        for i in range(0, len(line), LONGEST):
            piece = line[i : i + LONGEST]
            earlier = seen.get(piece, 0)
            seen[piece] = earlier + 1
            out.append(xxhash.xxh3_64_intdigest(piece.encode(), earlier))
    return np.unique(np.array(out, np.uint64))


def _checks(keys: np.ndarray) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * CHECK
    return mixed >> np.uint64(32)


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """Three cells for each key, one in each third of the table."""
    third = np.uint64(cells // 3)
    mixed = (keys[None, :] ^ (keys[None, :] >> np.uint64(29))) * FACTORS[:, None]
    return ((mixed >> np.uint64(32)) % third + np.arange(3, dtype=np.uint64)[:, None] * third).astype(np.int64)


def sketch(keys: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, keys, checks) of the cells."""
    counts, sums, checks = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
    where = _cells(keys, cells).ravel()
    counts += np.bincount(where, minlength=cells)
    np.bitwise_xor.at(sums, where, np.tile(keys, 3))
    np.bitwise_xor.at(checks, where, np.tile(_checks(keys), 3))
    return counts, sums, checks


def peel(first, second) -> tuple[np.ndarray, np.ndarray] | None:
    """Digests of the first sketch only and of the second only; None if peeling gets stuck."""
    counts, sums, checks = first[0] - second[0], first[1] ^ second[1], first[2] ^ second[2]
    cells = len(counts)
    mine, theirs = [], []
    while True:
        single = np.flatnonzero((np.abs(counts) == 1) & (checks == _checks(sums)))
        if not len(single):
            break
        keys, at = np.unique(sums[single], return_index=True)
        signs = counts[single][at]
        mine.append(keys[signs > 0])
        theirs.append(keys[signs < 0])
        where = _cells(keys, cells).ravel()
        np.subtract.at(counts, where, np.tile(signs, 3))
        np.bitwise_xor.at(sums, where, np.tile(keys, 3))
        np.bitwise_xor.at(checks, where, np.tile(_checks(keys), 3))
    if counts.any() or sums.any() or checks.any():
        return None
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(mine or none), np.concatenate(theirs or none)


def difference(first: np.ndarray, second: np.ndarray, start=None) -> tuple[np.ndarray, np.ndarray]:
    """Digests that differ, by peeling. start: sketches of CELLS cells, if there are any already.

    Retries take cells for all digests of both at least, then twice as many each time. A table that large holds
    the sets almost surely; should eight fail, the sets themselves are compared.
    """
    a, b = start or (sketch(first), sketch(second))
    found = peel(a, b)
    cells = 3 * ((2 * (len(first) + len(second))) // 3 + CELLS)
    for _ in range(8):
        if found is not None:
            return found
        found = peel(sketch(first, cells), sketch(second, cells))
        cells *= 2
    return found if found is not None else (np.setdiff1d(first, second), np.setdiff1d(second, first))


class Fingerprint:
    """A text's digests, its stored sketch, and the sketch as text: number of digests, digest of the text, cells."""

    def __init__(self, text: str):
        self.text, self.keys = text, digests(text)
        self.sketch = sketch(self.keys)

    def hex(self) -> str:
        whole = xxhash.xxh3_64_intdigest(self.text.encode())
        head = struct.pack(">IQ", len(self.keys), whole)
        counts, sums, checks = self.sketch
        return (head + counts.astype(">i4").tobytes() + sums.astype(">u8").tobytes() + checks.astype(">u4").tobytes()).hex()

    def near(self, other: Fingerprint) -> tuple[float, int]:
        """Share of common digests among all of both (1 for two empty texts), and the number that differ."""
        if self.text == other.text:
            return 1.0, 0
        mine, theirs = difference(self.keys, other.keys, (self.sketch, other.sketch))
        common = len(self.keys) - len(mine)
        union = common + len(mine) + len(theirs)
        return (common / union if union else 1.0), len(mine) + len(theirs)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint string) of every whole text; a null text is empty. Equal texts have equal fingerprints."""

    def run(batch):
        return batch.column(0), [Fingerprint(t or "").hex() for t in batch.column(1).to_pylist()]

    return map_batches(docs, [id_column, text], run, f"doc_id {id_type(docs, id_column)}, fingerprint string")


def with_next(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, t, copy, part) dealt into ordered parts, each followed by a copy of the next part's first row.

    Null ids come first, rows of one id are ordered by text. The parts' first ids are all that the driver sees, one
    for each partition. Texts are shuffled once; one row of each part, the least text of its first id, is copied.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids = rows.select("doc_id").repartitionByRange(parts(spark), "doc_id")
    found = ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("first"), F.count_if(F.isnull("doc_id")).alias("nulls"))
    found = found.collect()
    firsts = sorted(r["first"] for r in found if r["first"] is not None)
    nulls = any(r["nulls"] for r in found)
    end = max(0, len(firsts) - 1)

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        return pa.array([max(0, bisect.bisect_right(firsts, x) - 1) if x is not None else 0 for x in ids.to_pylist()], pa.int32())

    @F.arrow_udf("int")
    def part_before(ids: pa.Array) -> pa.Array:
        """The part that a copy of the first row of this id closes; a circle, which null ids begin if there are any."""
        whose = [bisect.bisect_left(firsts, x) if x is not None else 0 for x in ids.to_pylist()]
        return pa.array([at - 1 if at else end for at in whose], pa.int32())

    heads = rows.where(F.col("doc_id").isin(firsts[1:] if nulls else firsts) | F.col("doc_id").isNull())
    heads = heads.groupBy("doc_id").agg(F.min("t").alias("t"))
    placed = rows.select("doc_id", "t", part_of("doc_id").alias("part"), F.lit(0).alias("copy"))
    placed = placed.unionByName(heads.select("doc_id", "t", part_before("doc_id").alias("part"), F.lit(1).alias("copy")))
    dealt = placed.repartitionById(max(1, len(firsts)), F.col("part"))
    return dealt.sortWithinPartitions("part", "copy", "doc_id", "t")


def versions(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited version, and how near that and the next document are.

    Edited: the last quarter of the code points (rounded down) is replaced by as many from the start of the next
    document in order of id; the last is followed by the first, a document alone by itself. Result: (doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_changed). Null texts are
    empty; repeated rows are documents of their own; an empty table gives no row.
    """
    schema = (
        f"doc_id {id_type(docs, id_column)}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, n_changed bigint"
    )
    fields = [x.split() for x in schema.split(", ")]
    types, names = [arrow_type(t) for _, t in fields], [n for n, _ in fields]

    def compare(key, mine: Fingerprint, following: Fingerprint) -> tuple:
        n = len(mine.text)
        edited = Fingerprint(mine.text[: n - n // 4] + following.text[: n // 4])
        near, changed = mine.near(edited)
        digest = hashlib.sha256(edited.text.encode()).hexdigest()
        return key, n, digest, mine.hex(), edited.hex(), near, mine.near(following)[0], changed

    def run(batches):
        out, last = [], None
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                for key, t, part, copy in zip(*(c.to_pylist() for c in batch.columns)):
                    if last is None and copy:
                        continue  # a part needs one row behind its own
                    now = (key, Fingerprint(t))
                    if last is not None:
                        out.append(compare(*last, now[1]))
                    last = None if copy else now
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
                    out = []

    return with_next(docs, id_column, text).mapInArrow(run, schema)
