"""Removes long byte strings that occur more than once, by ordering the suffixes at agreed places.

No shard builds a transform of its own and none are merged: what stands around each place is gathered and sorted.

Sorting all suffixes of a corpus is out of reach, and not needed: a string of `span` bytes is repeated only if the
string around one agreed byte position in it is. Each window of `span` bytes has an anchor, the place of the least
hash among its k-grams, so equal strings have their anchors at the same offset. Every shard (an input slice) gives
its anchors; those whose k-gram occurs once in the corpus are done with. For the others a shard ships what stands
right of the anchor (the suffix) and left of it, byte by byte (the column of a Burrows-Wheeler transform for this
suffix, the one before it, and so on). Several lengths can be looked for at once: the least one then fixes the windows
and with them the anchors, the greatest one how far the contexts reach.

The suffixes of an anchor are sorted by refinement: blocks of equal suffixes are split symbol
by symbol, and a split fixes the common prefix of the neighbours at it. From the order at the anchor, the order
one byte further left follows from the transform's own step: a stable sort by the preceding byte, common prefixes
growing by one within equal bytes. No suffix is compared again. A suffix whose common prefix with a neighbour in
the order reaches `span` begins a repeated string.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bpe import id_type
from cohortspark.llm.common import free_names, map_batches, parts, ship, slices, store, with_columns

SPAN, GRAM = 400, 48
PASSAGE, WORDS = 200, 50  # bytes that over 99 % of all passages of over 50 words have; a passage has more than so many words
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
STEP = 1 << 19
POSITION = np.uint64((1 << 20) - 1)
CROWD = 20_000  # an anchor with more contexts is not merged in one task
FINER = (32, 1)  # starts of strings that share an anchor where the one before is crowded; with one start none can be
BATCH = 4096  # contexts merged at once
LETTERS = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
ZSTD = pa.Codec("zstd")


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each string of `size` bytes, by doubling: two halves make a whole."""
    parts_of = {1: LETTERS[data]}
    width = 1
    while 2 * width <= size:
        h = parts_of[width]
        factor = np.uint64(pow(BASE, width, 1 << 64))
        parts_of[2 * width] = h[: len(h) - width] * factor + h[width:]
        width *= 2
    out, done = parts_of[width], width
    while done < size:
        width = 1 << ((size - done).bit_length() - 1)
        factor = np.uint64(pow(BASE, width, 1 << 64))
        right = parts_of[width][done:]
        out = out[: len(right)] * factor + right
        done += width
    out = out ^ (out >> np.uint64(29))
    return out * np.uint64(0xBF58476D1CE4E5B9)


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of `width` neighbours."""
    out, done = values, 1
    while 2 * done <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, hash) for each run of windows with the same anchor.

    A window of `span` bytes starts at each position up to len - span. Ties go to the k-gram further right, so
    the anchor depends on the window's bytes alone.
    """
    found = []
    for base in range(0, len(data) - span + 1, STEP):
        part = data[base : base + STEP + span - 1]
        hashes = gram_hashes(part, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = window_least((hashes & ~POSITION) | (POSITION - place), span - gram + 1)
        where = (POSITION - (least & POSITION)).astype(np.int64)
        first = np.flatnonzero(np.append(True, np.diff(where) != 0))
        last = np.append(first[1:], len(where)) - 1
        found.append((base + where[first], base + first, base + last, hashes[where[first]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def finer(data: bytes, found: tuple[np.ndarray, ...], crowds: list[tuple[np.ndarray, int]], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """The crowded ones of the anchors found, in the same form, with longer strings as anchors.

    crowds: (hashes of crowded anchors, width), one pair after the other. Strings of `span` bytes that start near to far
    bytes left of an anchor, far being near + width - 1, all hold what stands from near bytes left of it to the end of the
    farthest. A hash of this, span - width + 1 bytes, is their anchor now: equal strings still have equal ones.
    """
    for crowded, width in crowds:
        kept = np.isin(found[3], crowded)
        out = []
        for a, lo, hi, h in zip(*(x[kept].tolist() for x in found)):
            for near in range((a - hi) // width * width, a - lo + 1, width):
                far = near + width - 1
                shared = data[a - near : a - far + span] + near.to_bytes(4, "big")
                out.append((a, max(lo, a - far), min(hi, a - near), xxhash.xxh3_64_intdigest(shared, h & 0xFFFF_FFFF_FFFF_FFFF)))
        *places, hashes = zip(*out) if out else [()] * 4
        found = (*(np.array(x, np.int64) for x in places), np.array(hashes, np.uint64).view(np.int64))
    return found


def merge_orders(group: np.ndarray, contexts: list[bytes], shift: np.ndarray, span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each context the runs (least, greatest distance left of the anchor) of repeated strings.

    group: ascending; contexts of one group are merged. shift: the anchor's place in the context. A context of m
    bytes holds the strings that start shift - (m - span) to shift bytes left of its anchor.
    """
    return merge_orders_of(group, contexts, shift, (span,))[0]


def merge_orders_of(
    group: np.ndarray, contexts: list[bytes], shift: np.ndarray, spans: tuple[int, ...]
) -> list[list[list[tuple[int, int]]]]:
    """What merge_orders gives, for each of the spans (ascending); the orders are made once."""
    n = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    width = -(-spans[-1] // 8)
    right = np.zeros((n, 8 * width), np.uint8)
    left = np.zeros((n, max(1, int(shift.max()))), np.uint8)
    for i, (c, k) in enumerate(zip(contexts, shift.tolist())):
        tail = np.frombuffer(c, np.uint8)
        right[i, : len(tail) - k] = tail[k:]
        left[i, :k] = tail[:k][::-1]
    length = sizes - shift
    symbols = right.view(">u8").astype(np.uint64)

    # The order at the anchor: blocks of equal prefixes are split symbol by symbol.
    order = np.arange(n)
    block = group.copy()  # by place in the order
    lcp = np.append(np.where(np.append(True, np.diff(group) != 0), 0, -1), 0)  # with the one before; -1: not yet split
    for k in range(width):
        open_ = lcp[:-1] < 0
        active = np.flatnonzero(open_ | np.append(open_[1:], False))
        if not len(active):
            break
        symbol = symbols[order[active], k]
        by = np.lexsort((symbol, block[active]))
        order[active], symbol = order[active][by], symbol[by]
        block_of = block[active]
        new = np.append(False, (symbol[1:] != symbol[:-1]) & (block_of[1:] == block_of[:-1]))
        at = np.flatnonzero(new)
        apart = symbol[at] ^ symbol[at - 1]
        same = (64 - _bit_length(apart)) // 8
        lcp[active[at]] = 8 * k + same
        block = np.cumsum(lcp[:-1] >= 0)
    ends = np.minimum(length[order], np.append(0, length[order][:-1]))
    lcp[:-1] = np.where(lcp[:-1] < 0, ends, np.minimum(lcp[:-1], ends))
    lcp[0] = 0

    # Further left, one byte at a time.
    repeated = np.zeros((len(spans), n, left.shape[1] + 1), bool)
    for distance in range(left.shape[1] + 1):
        longest = np.maximum(lcp[:-1], lcp[1:])
        for of_span, span in zip(repeated, spans):
            of_span[order[longest >= span], distance] = True
        if distance == left.shape[1]:
            break
        hope = (shift[order] > distance) & (longest + shift[order] - distance >= spans[0])
        kept = np.flatnonzero(hope)
        if len(kept) < 2:
            break
        key = group[order[kept]] * 256 + left[order[kept], distance]
        by = np.argsort(key, kind="stable")
        kept, key = kept[by], key[by]
        pairs = np.column_stack([kept[:-1] + 1, kept[1:] + 1]).ravel()
        between = np.minimum.reduceat(lcp, pairs)[::2]
        grown = np.where(key[1:] == key[:-1], between + 1, 0)
        order = order[kept]
        lcp = np.concatenate([[0], grown, [0]])
    return [[_runs(row) for row in of_span] for of_span in repeated]


def _runs(row: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _bit_length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(step)
        out += np.where(high > 0, step, 0)
        x = np.where(high > 0, high, x)
    return out + (x > 0)


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans, and the spans merged."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    out, at = [], 0
    for start, end in merged:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]]), merged


def stretches(size: int, span: int, found: tuple[list[int] | None, ...]) -> list[tuple[int, int]]:
    """(start, end) of what the repeated strings of `span` bytes cover in a text of `size` bytes. found: lists of first
    starts, last starts and spans; a span of zero holds for strings of any length that the text has there.
    """
    ends = ((start, min(last, size - span) + span) for start, last, of in zip(*(x or [] for x in found)) if of in (0, span))
    return [(start, end) for start, end in ends if end - start >= span]


def squeezed(t: str) -> bytes:
    """The text's bytes as they are shuffled: their number, then zstd, a third less than Spark's own compression."""
    data = t.encode()
    return len(data).to_bytes(4, "big") + ZSTD.compress(data, asbytes=True)


def unsqueezed(z: bytes) -> bytes:
    return ZSTD.decompress(z[4:], int.from_bytes(z[:4], "big"), asbytes=True)


def _shards(
    rows: DataFrame, window: int, spans: tuple[int, ...] = (), crowds: list[tuple[np.ndarray, int]] | None = None
) -> DataFrame:
    """(k, d, n, size, place, anchor, ctx): all different texts, with lists of all their anchors.

    n: how many rows have the text; d: the least of their ids; size: its bytes. ctx is a digest of the context; as only
    contexts of one anchor are compared, 64 bits do beside the anchor's own 64. Copies are met as one row, so that the
    hash of the text deals them out, not an anchor that many copies have. Anchors are those of windows of `window` bytes;
    contexts reach to the end of strings of the greatest of the spans (default: as many), or of the text. With crowds
    only texts with crowded anchors are given, once for each span (span), with lists of the finer ones of its strings.
    """
    spans = spans or (window,)

    def run(batch):
        out = [[] for _ in range(7 if crowds else 6)]
        for k, d, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data = t.encode()
            if len(data) < window:
                continue
            with np.errstate(over="ignore"):
                places = anchors(np.frombuffer(data, np.uint8), window)
            digest = xxhash.xxh3_64_intdigest
            for span in spans if crowds else spans[-1:]:
                a, lo, hi, h = places
                if crowds:
                    a, lo, hi, h = (x[lo <= len(data) - span] for x in places)
                    a, lo, hi, h = finer(data, (a, lo, np.minimum(hi, len(data) - span), h), crowds, span)
                    if not len(a):
                        continue
                pairs = zip(a.tolist(), lo.tolist(), hi.tolist())
                ctx = [digest(data[x : y + span] + (p - x).to_bytes(4, "big")) for p, x, y in pairs]
                place = (a << 32) | ((a - lo) << 16) | (hi - lo)
                for column, values in zip(out, (k, d, len(data), place, h, np.array(ctx, np.uint64).view(np.int64), span)):
                    column.append(values)
        return out

    if window > 1 << 16:
        raise ValueError("a place holds distances of 16 bits")
    lists = ("place", "anchor", "ctx")
    schema = "k binary, d string, size bigint, place array<bigint>, anchor array<bigint>, ctx array<bigint>"
    found = map_batches(rows, ["k", "d", "t"], run, schema + (", span int" if crowds else ""), rows=64)
    return found.groupBy("k", *(["span"] if crowds else [])).agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("d"), F.first("size").alias("size"), *[F.first(x).alias(x) for x in lists]
    )


def _ends() -> list[Column]:
    """a, lo and hi of a place."""
    a, place = F.shiftright("place", 32), F.col("place")
    lo = a - F.shiftright(place, 16).bitwiseAND(F.lit(0xFFFF))
    return [a.alias("a"), lo.alias("lo"), (lo + place.bitwiseAND(F.lit(0xFFFF))).alias("hi")]


def _contexts(rows: DataFrame, texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(anchor, k, lo, shift, full, bytes) of the contexts wanted, cut from the texts; of copies one text is read.

    The places grow with the input, so the joins shuffle at every size.
    """
    fields = ("a", "lo", "hi", "anchor", "full")
    listed = wanted.select("k", *_ends(), "anchor", "full").groupBy("k").agg(F.collect_list(F.struct(*fields)).alias("places"))
    listed = listed.join(texts.select("k", "d").hint("merge"), "k")
    packed = map_batches(rows, ["k", "d", "t"], lambda b: [b.column(0), b.column(1), [squeezed(t) for t in b.column(2).to_pylist()]],
                         "k binary, d string, z binary")
    joined = packed.join(listed.hint("merge"), ["k", "d"])

    def run(batch):
        out = [[], [], [], [], [], []]
        for k, z, *lists in zip(*(batch.column(i).to_pylist() for i in range(7))):
            data = unsqueezed(z)
            for a, lo, hi, anchor, full in zip(*lists):
                for column, value in zip(out, (anchor, k, lo, a - lo, full, data[lo : hi + span])):
                    column.append(value)
        return out

    schema = "anchor bigint, k binary, lo bigint, shift bigint, full boolean, bytes binary"
    return map_batches(joined, ["k", "z", *[F.col(f"places.{f}") for f in fields]], run, schema, rows=64)


def _merged(contexts: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """(k, start, last, span): starts of repeated strings in contexts, merged by anchor."""
    ship(contexts.sparkSession)
    names = ["k", "start", "last", "span"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    dealt = contexts.repartition(parts(contexts.sparkSession), "anchor").sortWithinPartitions("anchor", "k", "lo")

    def solve(rows):
        anchor = np.array([r[0] for r in rows])
        group = np.cumsum(np.append(0, np.diff(anchor) != 0))
        shift = np.array([r[3] for r in rows])
        found = merge_orders_of(group, [r[5] for r in rows], shift, spans)
        out = [
            (r[1], r[2] + r[3] - far, r[2] + r[3] - near, span)
            for span, of_span in zip(spans, found)
            for r, runs in zip(rows, of_span)
            if not r[4]
            for near, far in runs
        ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    def run(batches):
        rows: list[tuple] = []
        for batch in slices(batches, 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:3] == rows[-1][:3]:
                    continue  # the same place of a repeated row
                if len(rows) >= BATCH and row[0] != rows[-1][0]:
                    yield from solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from solve(rows)

    return dealt.mapInArrow(run, "k binary, start bigint, last bigint, span int")


def _kinds(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, start, last, span): first and last start of the contexts that occur twice; (anchor, k, place, full, kinds): the
    different contexts of anchors that have several; (anchor, kinds): the number of these contexts.
    """
    span = [x for x in texts.columns if x == "span"]
    every = texts.select("k", "n", *span, F.inline(F.arrays_zip("place", "anchor", "ctx")))
    often = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    often = store(often, "recurring", "zstd")  # a plain table, so that the join can split an anchor with very many rows
    every = store(every.join(often, "anchor", "left_semi"), "repeated-anchors", "zstd")
    kinds = every.groupBy("anchor", "ctx").agg(
        F.sum("n").alias("n"), F.min("n").alias("least"), F.min(F.struct("k", "place")).alias("at")
    )
    kinds = store(kinds, "contexts", "zstd")
    full = kinds.where("n > 1 AND least = 1").select("anchor", "ctx")  # copied texts go as a whole
    whole = every.where("n = 1").join(full, ["anchor", "ctx"], "left_semi").select("k", *_ends(), *(span or [F.lit(0).alias("span")]))
    whole = whole.select("k", F.col("lo").alias("start"), F.col("hi").alias("last"), "span")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = store(several, "several", "zstd")
    return whole, kinds.join(several, "anchor").select("anchor", "at.*", (F.col("n") > 1).alias("full"), "kinds"), several


def repeated_spans(rows: DataFrame, spans: tuple[int, ...] = (SPAN,), crowd: int = CROWD) -> DataFrame:
    """(k, found array of (start, last, span)): of each text k the first and last starts of runs of repeated strings, for
    each of the spans (ascending); a span of zero holds for all of them. rows: (k, d, t).

    A text that several rows have is repeated from end to end; for all others its anchors count once. Crowded anchors are
    replaced by finer ones, for each span its own, found in the texts again without a shuffle of these. The driver holds
    the hashes of crowded anchors, each of which has over `crowd` contexts: 8 bytes for several megabytes of different texts.
    """
    window, reach = spans[0], spans[-1]
    texts = store(_shards(rows, window, spans), "anchors", "zstd")
    start, every = F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("span")
    found = texts.where("n > 1").select("k", start, F.col("size").alias("last"), every)
    whole, mixed, several = _kinds(texts)
    found, wanted, crowds = found.unionByName(whole), mixed.where(F.col("kinds") <= crowd), []
    for width in FINER:
        crowded = [r.anchor for r in several.where(F.col("kinds") > crowd).select("anchor").collect()]
        if not crowded:
            break
        crowds.append((np.array(crowded, np.int64), min(width, window)))
        whole, mixed, several = _kinds(store(_shards(rows, window, spans, crowds), "finer-anchors", "zstd"))
        found = found.unionByName(whole)
        if width > 1:
            wanted = wanted.unionByName(mixed.where(F.col("kinds") <= crowd))
    found = found.unionByName(_merged(_contexts(rows, texts, wanted, reach), spans))
    found = found.distinct().groupBy("k").agg(F.collect_list(F.struct("start", "last", "span")).alias("found"))
    return store(found, "spans")


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, d, t, k): the id, the id as text, the text (null: empty), and the text's digest."""
    whole: Column = F.coalesce(F.col(text), F.lit(""))
    identity = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), identity.alias("d"), whole.alias("t"))
    return rows.withColumn("k", F.unhex(F.md5("t")))


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", span: int = SPAN, crowd: int = CROWD, passage: int | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every document; with passage also (n_repeated, n_passages).

    Each byte covered by a string of `span` bytes that also starts anywhere else, in the same document or another,
    is removed; all occurrences go. A null text is empty. Repeated rows are documents of their own, so what they
    share is repeated. Texts shorter than `span` bytes stay as they are; an empty table gives no row. Anchors with
    more than `crowd` different contexts are replaced by finer ones before they are merged, with the same result.
    Copies share a digest; what they share is found once and joined to each, skew being split at run time.

    passage: bytes of shorter strings, found in the same way and at the same time but not removed. n_repeated: bytes
    covered by those that occur more than once; n_passages: maximal runs of such bytes with over WORDS words.
    """
    if passage and passage > span:
        raise ValueError("strings of a passage are no longer than those that are removed")
    rows = keyed(docs, id_column, text)
    spans = tuple(sorted({passage or span, span}))
    spans = repeated_spans(rows.select("k", "d", "t"), spans, crowd).withColumnRenamed("k", "of")
    kind = id_type(docs, id_column)
    packed = map_batches(rows, ["doc_id", "t", "k"], lambda b: [b.column(0), [squeezed(t) for t in b.column(1).to_pylist()], b.column(2)],
                         f"doc_id {kind}, z binary, k binary")
    joined = packed.join(spans.hint("merge"), packed.k == spans.of, "left")
    found = [F.col(f"found.{f}") for f in ("start", "last", "span")]

    def run(batch):
        out = [[] for _ in range(6 if passage else 4)]
        for z, *lists in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
            data = unsqueezed(z)
            kept, merged = cut_out(data, stretches(len(data), span, lists))
            values = [len(data), len(data) - len(kept), len(merged), kept]
            if passage:
                _, runs = cut_out(data, stretches(len(data), passage, lists))
                passages = sum(len(WORD.findall(data, *x)) > WORDS for x in runs)
                values += [sum(end - start for start, end in runs), passages]
            for column, value in zip(out, values):
                column.append(value)
        return [batch.column(0), *out]

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    schema += ", n_repeated bigint, n_passages bigint" if passage else ""
    return map_batches(joined, ["doc_id", "z", *found], run, schema)


def stripped(docs: DataFrame, id_column: str = "doc_id", text: str = "text", span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """The rows with the repeated byte strings taken out of their texts; all other columns stay.

    Bytes of a character that a cut has torn apart go with it. A null text stays null.
    """
    spans = repeated_spans(keyed(docs, id_column, text).select("k", "d", "t"), (span,), crowd)
    key, of, first, last, span_of, left, packed = free_names(docs, "_k", "_of", "_start", "_last", "_span", "_kept", "_z")
    fields = zip((first, last, span_of), ("start", "last", "span"))
    spans = spans.select(F.col("k").alias(of), *[F.col(f"found.{f}").alias(name) for name, f in fields])
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    small = with_columns(
        docs.withColumn(key, digest), [text], lambda c: [[t if t is None else squeezed(t) for t in c[0]]], f"{packed} binary"
    )
    joined = small.drop(text).join(spans.hint("merge"), F.col(key) == F.col(of), "left")

    def run(columns):
        out = []
        for z, *lists in zip(*columns):
            data = None if z is None else unsqueezed(z)
            out.append(z if z is None else cut_out(data, stretches(len(data), span, lists))[0].decode("utf-8", "ignore"))
        return [out]

    marked = with_columns(joined, [packed, first, last, span_of], run, f"{left} string")
    return marked.withColumnRenamed(left, text).select(*docs.columns)
