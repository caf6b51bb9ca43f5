"""Byte-level BPE: whole texts to ids and back.

Within a match of the split pattern the next merge is always the leftmost pair of the lowest rank. A segment tree
over the byte positions holds that minimum: a leaf stands for the pair that begins at its byte, and a merge
changes the leaves of the merged token, of its left neighbour and of the byte that ceased to begin a token, each
in logarithmic time. A match of n bytes therefore costs O(n log n), also when it is a megabyte without a space.
"""

from __future__ import annotations

import base64
import functools
import struct

from pyspark.sql import DataFrame

from cohortspark.llm.common import map_batches
from cohortspark.llm.pieces import PieceEncoder

NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: a line holds the token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    get, n = ranks.get, len(word)
    whole = get(word)
    if whole is not None:
        return [whole]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    mask = size - 1
    leaves = [NONE] * size
    for i in range(n - 1):
        rank = get(word[i : i + 2])
        if rank is not None:
            leaves[i] = rank * size + i  # the lowest rank, then the leftmost position
    tree = [NONE] * size + leaves
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    following, before = list(range(1, n + 2)), list(range(-1, n))
    while (least := tree[1]) < NONE:
        i = least & mask
        j = following[i]
        following[i] = k = following[j]
        before[k] = i
        rank = get(word[i : following[k]]) if k < n else None
        tree[size + i] = NONE if rank is None else rank * size + i
        changed = [size + i]
        if j < n - 1:  # the pair that began at j is gone
            tree[size + j] = NONE
            changed.append(size + j)
        b = before[i]
        if b >= 0:
            rank = get(word[b:k])
            tree[size + b] = NONE if rank is None else rank * size + b
            changed.append(size + b)
        for p in changed:
            p >>= 1
            while p:
                left, right = tree[2 * p], tree[2 * p + 1]
                value = left if left < right else right
                if tree[p] == value:
                    break
                tree[p] = value
                p >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : following[i]]])
        i = following[i]
    return ids


class Codec:
    """Encoder and decoder for a rank file and a split pattern. Ids are packed as little-endian unsigned 32-bit."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.encode = PieceEncoder(pattern, self._word).encode

    def _word(self, word: str) -> bytes:
        ids = merge(word.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I"))) if packed else b""


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, so that its caches outlive a task."""
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary): ids of every whole text as little-endian unsigned 32-bit. A null text counts as empty.

    Rows are independent: repeated rows give repeated results, and an empty table an empty one. `path` must be
    readable on every executor, as the installed vocabulary package is.
    """

    def run(batch):
        encode = codec(path, pattern).encode
        return batch.column(0), [encode(t or "") for t in batch.column(1).to_pylist()]

    return map_batches(docs, [id_column, text], run, f"doc_id {id_type(docs, id_column)}, ids binary")


def decode_ids(
    encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids: str = "ids", keep_ids: bool = False
) -> DataFrame:
    """(doc_id, text_bytes binary), with keep_ids also ids: bytes of the decoded ids. Null ids count as none.

    An id that the rank file lacks raises KeyError: nothing is left out.
    """

    def run(batch):
        decode = codec(path, pattern).decode
        out = [batch.column(0), [decode(x or b"") for x in batch.column(1).to_pylist()]]
        return [*out, batch.column(1)] if keep_ids else out

    schema = f"doc_id {id_type(encoded, id_column)}, text_bytes binary" + ", ids binary" * keep_ids
    return map_batches(encoded, [id_column, ids], run, schema)


def id_type(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()
