"""Packs documents into sequences along a Hilbert curve.

Each document's token counts are hashed into a vector, projected to few dimensions, and given its place on a
Hilbert curve through them. The table is range-partitioned and sorted by that place, so neighbours in a sequence
are alike, and each partition cuts its own stream into sequences of `length` ids.
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortspark.llm.bpe import id_type
from cohortspark.llm.common import arrow_type, map_batches, parts, slices, store

HASHED, DIMENSIONS, BITS = 256, 4, 12


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + others.index(b)) for b in range(256)]


def id_format(path: str) -> str:
    """How stored ids are packed: in two bytes if the vocabulary allows, else in four; little-endian, unsigned."""
    from tokenizers import Tokenizer

    return "H" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "I"


class Merges:
    """Ids of whole texts as `Tokenizer.from_file(path).encode(text, add_special_tokens=False)` gives them.

    Where the file's ids rise in the order of its merges and its added tokens have no rules of their own, as in
    byte-level vocabularies, a pair's rank is the id that it makes, so the merge loop of tiktoken gives the same ids
    in a third of the time. For any other file the tokenizer itself is used.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, added = said["model"], {t["content"]: t["id"] for t in said.get("added_tokens") or []}
        plain = not any(t[flag] for t in said.get("added_tokens") or [] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        vocabulary = model.get("vocab", {})
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model.get("merges", [])]
        made = [vocabulary.get(a + b, -1) for a, b in pairs]
        own = {letter: byte for byte, letter in enumerate(byte_letters())}
        bytewise = (said.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not said["pre_tokenizer"]["add_prefix_space"]
        rest = set(vocabulary) - {a + b for a, b in pairs} - set(added)
        if bytewise and plain and not said.get("normalizer") and made == sorted(made) and rest == set(own):
            import tiktoken

            ranks = {bytes(own[x] for x in token): i for token, i in vocabulary.items() if token not in added}
            self.merges = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
            self.encode = lambda text: self.merges.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.encode = lambda text: np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Merges:
    """One encoder for each worker process. A text that spells an added token, such as the end mark, has its id."""
    return Merges(path, pattern)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), by inverting Skilling's transpose form."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


@functools.lru_cache(maxsize=1)
def directions() -> np.ndarray:
    """Fixed random directions from hashed counts to the curve's dimensions."""
    return np.random.default_rng(7).standard_normal((HASHED, DIMENSIONS))


def curve_places(vectors: np.ndarray) -> np.ndarray:
    """Place of each row of hashed counts. Rows are scaled to unit length; the projection is squeezed to a cube."""
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    unit = vectors / np.maximum(norm, 1e-12)
    cube = 0.5 + np.arctan(3 * (unit @ directions())) / np.pi
    return hilbert(np.minimum((cube * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text", end_id: int = 1
) -> DataFrame:
    """(doc_id, place, ids binary): ids of each whole text and the end id, packed as id_format says."""
    dtype = np.dtype(f"<u{struct.calcsize('<' + id_format(path))}")

    def run(batch):
        encode = tokenizer(path, pattern).encode
        packed = []
        counts = np.empty((batch.num_rows, HASHED))
        for row, t in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode(t or ""), np.uint32(end_id)).astype(np.uint32)
            counts[row] = np.bincount((ids * np.uint32(2654435761)) >> np.uint32(24), minlength=HASHED)
            packed.append(ids.astype(dtype).tobytes())
        return batch.column(0), pa.array(curve_places(counts)), packed

    schema = f"doc_id {id_type(docs, id_column)}, place bigint, ids binary"
    return map_batches(docs, [id_column, text], run, schema)


def powers(length: int) -> list[int]:
    """The powers of two that add up to a length, falling."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def cut(rows, length: int) -> Iterator[tuple]:
    """Pieces (row, start, size, sequence, offset) of rows given as (row, size), cut where a sequence is full.

    The last sequence is cut again into sequences of a power of two, so none needs padding.
    """
    sequence, fill, last = 0, 0, []
    for row, size in rows:
        start = 0
        while start < size:
            take = min(size - start, length - fill)
            last.append((row, start, take, sequence, fill))
            start, fill = start + take, fill + take
            if fill == length:
                yield from last
                last, sequence, fill = [], sequence + 1, 0
    ends = powers(fill)
    at = used = 0
    for row, start, take, _, _ in last:
        while take:
            step = min(take, ends[at] - used)
            yield row, start, step, sequence + at, used
            start, take, used = start + step, take - step, used + step
            if used == ends[at]:
                at, used = at + 1, 0


def pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_column: str = "doc_id",
    text: str = "text",
    length: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids binary, doc_tokens, sequence_id, offset) of sequences of `length` ids.

    Each id of each row lies in exactly one piece; an empty or null text has the end id alone. Sequences are full
    but for the last of each partition, whose rest is cut into sequences of a power of two: there is no padding.
    Copies share a place on the curve and are dealt out by (place, id), so no place is bound to one task. Rows are
    tokenized once and stored; only then are they sorted. An empty table gives no piece. Repeated rows are packed
    each. The sequence id holds the partition above bit 32.
    """
    spark = docs.sparkSession
    dtype = np.dtype(f"<u{struct.calcsize('<' + id_format(path))}")
    rows = store(tokenized(docs, path, pattern, id_column, text, end_id), "tokens", "zstd")
    ordered = rows.repartitionByRange(parts(spark), "place", "doc_id").sortWithinPartitions("place", "doc_id", "ids")
    kind = id_type(docs, id_column)
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    types = [arrow_type(x) for x in (kind, "bigint", "bigint", "binary", "bigint", "bigint", "bigint")]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        base = TaskContext.get().partitionId() << 32

        def documents():
            for piece in slices(batches):
                for key, ids in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist()):
                    ids = np.frombuffer(ids, dtype).astype("<u4")
                    yield (key, ids), len(ids)

        out = []
        for (key, ids), start, size, sequence, offset in cut(documents(), length):
            out.append((key, start, size, ids[start : start + size].tobytes(), len(ids), base + sequence, offset))
            if len(out) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return ordered.mapInArrow(run, schema)
