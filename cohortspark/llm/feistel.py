"""Shards from a Feistel permutation of global row numbers, with DataFrame functions only.

Rows are numbered from 0 in the order of id and text. A keyed permutation of 0 to rows - 1 deals them out: the number
that a row is sent to gives its shard (the remainder) and its slot (the quotient), so shards differ by one row at
most, slots have no gap, and the row in any slot can be computed back. The permutation is a Feistel network on pairs
(left, right), left below a and right below b, with a * b just above the number of rows; numbers that fall beyond
the rows walk on along their cycle until they are inside. How many steps that can take is found beforehand from the
fewer than a numbers outside, about the root of the number of rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import parts, store

ROUNDS = 4  # each changes both halves
OUTER = 33  # monotonically_increasing_id keeps the partition above this bit


def halves(rows: int) -> tuple[int, int]:
    """a, b with a * b >= rows and a * b - rows < a."""
    a = max(1, isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _mix(half: Column, seed: int, i: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(seed).cast("bigint"), i), F.lit(modulus).cast("bigint"))


def _split(x: Column, a: int) -> Column:
    wide = F.lit(a).cast("bigint")
    return F.struct(F.pmod(x, wide).alias("l"), F.call_function("div", x, wide).alias("r"))


def _joined(pair: Column, a: int) -> Column:
    return pair["l"] + pair["r"] * F.lit(a).cast("bigint")


def permuted(x: Column, rows: int, seed: int) -> Column:
    """The network once: a permutation of 0 to a * b - 1."""
    a, b = halves(rows)

    def step(pair, i):
        left = F.pmod(pair["l"] + _mix(pair["r"], seed, 2 * i, a), F.lit(a).cast("bigint"))
        right = F.pmod(pair["r"] + _mix(left, seed, 2 * i + 1, b), F.lit(b).cast("bigint"))
        return F.struct(left.alias("l"), right.alias("r"))

    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, _split(x, a), step, lambda pair: _joined(pair, a))


def unpermuted(x: Column, rows: int, seed: int) -> Column:
    """The inverse of the network."""
    a, b = halves(rows)

    def step(pair, i):
        right = F.pmod(pair["r"] - _mix(pair["l"], seed, 2 * i + 1, b), F.lit(b).cast("bigint"))
        left = F.pmod(pair["l"] - _mix(right, seed, 2 * i, a), F.lit(a).cast("bigint"))
        return F.struct(left.alias("l"), right.alias("r"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))
    return F.aggregate(turns, _split(x, a), step, lambda pair: _joined(pair, a))


def longest_walk(spark: SparkSession, rows: int, seed: int) -> int:
    """Applications of the network after which every row number is surely back below `rows`."""
    a, b = halves(rows)
    # Cycles that lie outside as a whole are never entered.
    outside, steps = spark.range(rows, a * b).where(unpermuted(F.col("id"), rows, seed) < rows), 1
    while not outside.isEmpty():
        steps += 1
        outside = outside.select(permuted(F.col("id"), rows, seed).alias("id")).where(F.col("id") >= rows)
    return steps


def walked(frame: DataFrame, column: str, rows: int, seed: int, inverse: bool = False, steps: int | None = None) -> DataFrame:
    """The frame with the numbers of the column sent where the permutation of 0 to rows - 1 sends them, or back."""
    once = unpermuted if inverse else permuted
    steps = steps or longest_walk(frame.sparkSession, rows, seed)
    frame = frame.withColumn(column, once(F.col(column), rows, seed))
    for _ in range(steps - 1):
        outside = F.col(column) >= rows
        frame = frame.withColumn(column, F.when(outside, once(F.col(column), rows, seed)).otherwise(F.col(column)))
    return frame


def numbered(frame: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """The frame with each row's number from 0 in the order, nulls first, and the number of rows.

    The rows are dealt out by ranges of the order and sorted within; equal rows, which may take each other's
    numbers, are divided by an arbitrary last key. One count for each range reaches the driver.
    """
    spark = frame.sparkSession
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    tied = frame.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys).drop("_tie")
    placed = store(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", OUTER), F.col("_at").bitwiseAND(F.lit((1 << OUTER) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    rows, offsets = 0, []
    for row in counts:
        offsets.append((row.part, rows))
        rows += row.n
    before = F.broadcast(spark.createDataFrame(offsets, "_part bigint, _before bigint"))
    joined = placed.withColumn("_part", part).join(before, "_part")
    return joined.withColumn(name, within + F.col("_before")).drop("_at", "_part", "_before"), rows


def shard(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 13, extra: int = 16
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number) of every row.

    The law is `rows`: the numbers of rows in the shards are at most one apart; grown_shard is null. A null text is
    empty; a null id comes first; repeated rows are rows of their own, and which of them gets which number makes no
    difference. An empty table gives no row. Texts are read once, and only their sizes and digests are moved. Equal
    texts are not kept together: a group may be larger than a shard.
    """
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(data) + F.lit(extra)).cast("bigint").alias("size"),
        F.crc32(data).cast("bigint").alias("text_crc32"),
        F.xxhash64(data).alias("digest"),
    )
    narrow = store(narrow, "sizes")
    ordered, rows = numbered(narrow, ["doc_id", "digest", "size", "text_crc32"])
    dealt = walked(ordered.withColumn("place", F.col("row_number")), "place", rows, seed)
    wide = F.lit(shards).cast("bigint")
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", wide).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), wide).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def row_numbers(slots: DataFrame, rows: int, shards: int = 40, seed: int = 13) -> DataFrame:
    """(shard, slot) with the row_number that `shard` put there, of a table of `rows` rows."""
    placed = slots.withColumn("row_number", F.col("slot").cast("bigint") * shards + F.col("shard"))
    return walked(placed, "row_number", rows, seed, inverse=True)
