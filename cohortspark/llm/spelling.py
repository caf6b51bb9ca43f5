"""Groups spelling variants: words of one corpus that differ by one letter point at the more frequent one.

Words are counted once; only distinct words are compared. A word's letters, each with the number of its occurrence,
are a set, that is a binary vector. Words that differ by one replaced letter have sets that differ in two places, by
one inserted letter in one. PartEnum makes exact keys of that: the places are dealt into PARTS parts, and as at most
two (one) of the parts can differ, some choice of the other parts agrees. Every choice of PARTS - 2 (PARTS - 1) parts
with what a word has there is a signature. Words of equal length and of lengths one apart have signatures of their
own. One difference leaves the first or the last half of a word as it is, so each signature is kept once with
either half; without it, short words that have few letters in the chosen parts would all meet under one signature.

Words with a common signature meet in an equi-join, which lets only pairs at a distance of exactly one through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import map_batches, ship, slices, store

PARTS = 4
HELD = 200_000  # distinct words that a task counts before it hands them on
# One run in DELETED, by its checksum, loses a letter.
DELETED = 97
LETTERS = "A-Za-zÀ-ÿ"


def words_of(prefix: int, text: str, least: int) -> Counter:
    """Counts of the runs of letters with at least `least` letters, A-Z lower-cased; some runs lose a letter.

    prefix: the checksum of `<doc_id>:`. The checksum of a run decides whether it loses a letter, and which.
    """
    out: Counter = Counter()
    runs = Counter(re.findall(f"[{LETTERS}]{{{least},}}", text.encode().lower().decode()))
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DELETED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def counted(docs: DataFrame, id_column: str, text: str, letters: int, least: int) -> DataFrame:
    """(word, n) of the words with at least `letters` letters that occur at least `least` times."""
    ship(docs.sparkSession)

    def handed(words: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        words: Counter = Counter()
        for batch in slices(batches):
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.update(words_of(zlib.crc32(f"{key}:".encode()), t or "", letters))
                if len(words) >= HELD:
                    yield handed(words)
                    words = Counter()
        if words:
            yield handed(words)

    read = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    parts = read.mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def projections(word: str) -> list[str]:
    """What the word's set has in each part: letters with the number of their occurrence, sorted."""
    out = [""] * PARTS
    seen = ""
    for letter in sorted(word):
        seen = seen + letter if seen[:1] == letter else letter
        place = letter + chr(len(seen))
        out[zlib.crc32(place.encode()) % PARTS] += place
    return out


def signatures(word: str) -> list[tuple[int, bool]]:
    """(key, whether it is for equal lengths): two words at a distance of one have a key in common."""
    parts, out = projections(word), []
    n = len(word)
    for short, agree in ((n, PARTS - 2), (n, PARTS - 1), (n - 1, PARTS - 1)):
        same = agree == PARTS - 2
        half = short // 2
        for side, kept in (("<", word[:half]), (">", word[n - half :])):
            for chosen in combinations(range(PARTS), agree):
                key = f"{short}{agree}{side}{kept}{chosen}{[parts[i] for i in chosen]}"
                out.append((xxhash.xxh3_64_intdigest(key) - (1 << 63), same))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of words (word, n), distinct, that differ by one letter inserted, deleted or replaced."""

    def run(batch):
        out = [[], [], [], []]
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for key, same in signatures(word):
                for column, value in zip(out, (key, same, word, n)):
                    column.append(value)
        return out

    rows = map_batches(words, ["word", "n"], run, "key bigint, same boolean, word string, n bigint")
    rows = store(rows.withColumn("size", F.length("word")), "signatures")
    other = rows.select(F.col("key").alias("of"), F.col("word").alias("b"), F.col("n").alias("bn"), F.col("size").alias("bs"))
    in_order = (F.col("same") & (F.col("word") < F.col("b"))) | (~F.col("same") & (F.col("size") < F.col("bs")))
    met = rows.join(other, (F.col("key") == F.col("of")) & in_order & (F.levenshtein("word", "b", 1) == 1))
    return met.select(F.col("word").alias("a"), F.col("n").alias("an"), "b", "bn").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row (word, form): forms are followed to the last, twice as far in each round."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        now = store(now.join(on, F.col("root") == F.col("at"), "left"), "roots")
        if now.where("further is not null").isEmpty():
            return now.select("word", "root")
        now = now.select("word", F.coalesce("further", "root").alias("root"))


def variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", letters: int = 5, least: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    Words have at least `letters` letters and occur at least `least` times in whole texts; a null text has none, a
    null id counts as an empty one. Words are near if they differ by exactly one letter. The form of a word is its
    near word of largest n, ties to the smaller in code-point order, if it is at least twice as frequent; root follows
    forms to the last and is the word itself if it has none. Repeated rows count each. Other columns are not read. An
    empty table gives no row. Chains of forms end, as n doubles at each step.
    """
    words = store(counted(docs, id_column, text, letters, least), "words")
    pairs = store(near_pairs(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = F.min(F.struct((-F.col("bn")).alias("minus"), F.col("b").alias("form"))).alias("best")
    near = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    judged = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    frequent = F.col("form_n") >= 2 * F.col("n")
    judged = judged.select(
        "word",
        F.when(frequent, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(frequent, F.col("form_n")).alias("form_n"),
    )
    judged = store(judged, "forms")
    found = roots(judged.where("form is not null"))
    return judged.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
