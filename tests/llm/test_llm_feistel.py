import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from cohortspark.llm import feistel


def signed(x):
    return x - ((x >> 63) << 64)


def plain_permuted(x, rows, seed):
    """The network in Python: hashes of the other half, the key and the turn."""
    a, b = feistel.halves(rows)

    def mix(half, i, modulus):
        h = xxhash.xxh64_intdigest(struct.pack("<q", half), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", seed), h)
        return signed(xxhash.xxh64_intdigest(struct.pack("<i", i), h)) % modulus

    left, right = x % a, x // a
    for i in range(feistel.ROUNDS):
        left = (left + mix(right, 2 * i, a)) % a
        right = (right + mix(left, 2 * i + 1, b)) % b
    return left + a * right


def plain_walk(x, rows, seed):
    x = plain_permuted(x, rows, seed)
    while x >= rows:
        x = plain_permuted(x, rows, seed)
    return x


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 7, 50, 1001])
def test_a_permutation_with_its_inverse(spark, rows):
    numbers = spark.range(rows).withColumn("x", F.col("id"))
    there = feistel.walked(numbers, "x", rows, 13)
    assert {r.id: r.x for r in there.collect()} == {i: plain_walk(i, rows, 13) for i in range(rows)}
    assert sorted(r.x for r in there.collect()) == list(range(rows))
    assert all(r.id == r.x for r in feistel.walked(there, "x", rows, 13, inverse=True).collect())


@pytest.mark.parametrize("rows", [1, 2, 6, 10, 10**6, 10**12 + 1])
def test_few_numbers_lie_outside(rows):
    a, b = feistel.halves(rows)
    assert rows <= a * b < rows + a and a <= rows**0.5 + 1


def test_documents(spark, documents):
    found = feistel.shard(documents).collect()
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    by = {r.doc_id: r for r in found}
    assert len(found) == len(by) == len(rows)
    for i, r in enumerate(rows):
        data, place = (r.text or "").encode(), plain_walk(i, len(rows), 13)
        want = (r.doc_id, len(data) + 16, zlib.crc32(data), "rows", place % 40, place // 40, None, i)
        assert tuple(by[r.doc_id]) == want
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_the_shuffle_does_not_depend_on_the_layout(spark, documents):
    once = sorted(map(tuple, feistel.shard(documents).collect()))
    again = sorted(map(tuple, feistel.shard(documents.orderBy(F.xxhash64("text")).repartition(13)).collect()))
    assert once == again


def test_the_row_of_a_slot_can_be_computed(spark, documents):
    found = feistel.shard(documents)
    rows = found.count()
    back = feistel.row_numbers(found.select("shard", "slot", F.col("row_number").alias("given")), rows)
    assert all(r.row_number == r.given for r in back.collect())


def test_odd_rows(spark, docs, odd_texts):
    many = docs(*odd_texts, (None, "an id is missing"), (None, "an id is missing"), *[(5, "a hot row")] * 200, extra=True)
    found = feistel.shard(many).collect()
    n = len(odd_texts) + 202
    assert sorted(r.row_number for r in found) == list(range(n))
    assert sorted(r.slot * 40 + r.shard for r in found) == list(range(n))
    assert sorted(r.row_number for r in found if r.doc_id is None) == [0, 1]
    assert feistel.shard(docs("x").where("false")).count() == 0


def test_no_python_runs_on_rows(spark, documents):
    plan = feistel.shard(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
