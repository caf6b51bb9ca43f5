"""Clusters vectors around centroids: rounds of Lloyd's method, with Orchard's search for the nearest centroid.

All arithmetic is on integers, so results do not depend on how rows are dealt out. For each centroid there is a list
of the others by distance. A vector's search reads the list of the best centroid found so far; when one is closer, it
jumps to that one's list. Centroids seen are marked and not measured again. By the triangle inequality a centroid
further from the best than twice the vector's distance cannot be closer, so the search stops strictly beyond it; one
at exactly twice the distance may tie, and ties go to the smaller number.

Centroids and their lists are sent to every task. Their size is bounded by MOST_CENTROIDS, not by the data. A round
shuffles one sum for each task, centroid and component.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bpe import id_type
from cohortspark.llm.common import map_batches, ship, slices, store

MOST_CENTROIDS = 4096  # the lists then take 4096^2 * 10 bytes
BATCH = 1024


@dataclass(frozen=True)
class Lists:
    """Centroids (k, d); the others of each by distance (k, k - 1), and those squared distances."""

    centroids: np.ndarray
    order: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Lists:
        k = len(centroids)
        order, gaps = np.zeros((k, k - 1), np.int16), np.zeros((k, k - 1), np.int64)
        for i in range(k):
            apart = squared(centroids, centroids[i])
            by = np.lexsort((np.arange(k), apart))
            by = by[by != i]
            order[i], gaps[i] = by, apart[by]
        return cls(centroids, order, gaps)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by row."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def largest_component(size: int) -> int:
    """Four times a squared distance of vectors with smaller components fits in 64 bits."""
    return isqrt((1 << 58) // size)


def nearest(vectors: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row, by Orchard's search.

    It starts at the centroid whose squared length is next to the vector's.
    """
    n, k = len(vectors), len(lists.centroids)
    rows = np.arange(n)
    lengths = np.einsum("ij,ij->i", lists.centroids, lists.centroids)
    sorted_by_length = np.argsort(lengths, kind="stable")
    own = np.einsum("ij,ij->i", vectors, vectors)
    best = sorted_by_length[np.minimum(np.searchsorted(lengths[sorted_by_length], own), k - 1)]
    least = squared(vectors, lists.centroids[best])
    seen = np.zeros((n, k), bool)
    seen[rows, best] = True
    at = np.zeros(n, np.int64)
    live = rows if k > 1 else rows[:0]
    while len(live):
        place = best[live], at[live]
        going = lists.gaps[place] <= 4 * least[live]
        live, other = live[going], lists.order[place][going].astype(np.int64)
        at[live] += 1
        fresh = ~seen[live, other]
        measured, other = live[fresh], other[fresh]
        seen[measured, other] = True
        apart = squared(vectors[measured], lists.centroids[other])
        closer = (apart < least[measured]) | ((apart == least[measured]) & (other < best[measured]))
        moved = measured[closer]
        best[moved], least[moved], at[moved] = other[closer], apart[closer], 0
        live = live[at[live] < k - 1]
    return best, least


def quantized(vectors: DataFrame, id_column: str, vector: str, size: int, scale: int) -> DataFrame:
    """(vec_id, q array<bigint>): floor(scale * x) of the vectors with exactly `size` finite components.

    A component so large that distances would not fit in a long is an error.
    """
    most = largest_component(size)
    x = F.col(vector)
    finite: Column = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    small = lambda v: F.floor(scaled(v)).cast("bigint")
    error = F.raise_error(F.lit(f"a component is not below {most} after scaling")).cast("bigint")
    whole = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < float(most), small(v)).otherwise(error))
    return vectors.where((F.size(x) == size) & finite).select(F.col(id_column).alias("vec_id"), whole.alias("q"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows with the smallest hashes of `seed:id`, in that order; rows of one id by their components."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.select(F.sha2(text, 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in chosen], np.int64)


def moved(rows: DataFrame, lists: Lists) -> np.ndarray:
    """The centroids after one round: floor of the exact mean of their vectors; one without vectors stays."""
    k, size = lists.centroids.shape

    def run(batches):
        sums = np.zeros((k, size + 1), np.int64)  # the last column counts
        for batch in slices(batches, BATCH):
            vectors = _matrix(batch.column(0), size)
            best, _ = nearest(vectors, lists)
            np.add.at(sums[:, :size], best, vectors)
            sums[:, size] += np.bincount(best, minlength=k)
        filled = np.flatnonzero(sums[:, size])
        place = (filled[:, None] * (size + 1) + np.arange(size + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[filled].ravel())], names=["place", "part"])

    parts = rows.select("q").mapInArrow(run, "place bigint, part bigint")
    totals = parts.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    found = {r.place: int(r.total) for r in totals}
    out = lists.centroids.copy()
    for i in range(k):
        if count := found.get(i * (size + 1) + size):
            out[i] = [found[i * (size + 1) + c] // count for c in range(size)]
    return out


def cluster(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    size: int = 64,
    scale: int = 1024,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly `size` components, none null or non-finite; a null vector is not kept. A null id is
    kept and hashes as an empty text. Repeated rows are vectors of their own and may be centroids of their own. With
    fewer than k kept vectors each is a first centroid. An empty table gives no row. Rounds that change nothing are
    not repeated, as all later ones would be the same.
    """
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"from 1 to {MOST_CENTROIDS} centroids, as all are sent to every task")
    spark = vectors.sparkSession
    ship(spark)
    kind = id_type(vectors, id_column)
    rows = store(quantized(vectors, id_column, vector, size, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    columns = f"vec_id {kind}, cluster int, distance bigint"
    if not len(centroids):
        more = ", cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], columns + more)
    for _ in range(rounds):
        before, centroids = centroids, moved(rows, Lists.of(centroids))
        if np.array_equal(before, centroids):
            break
    lists = Lists.of(centroids)

    def assign(batch):
        best, least = nearest(_matrix(batch.column(1), size), lists)
        return batch.column(0), best.astype(np.int32), least

    assigned = store(map_batches(rows, ["vec_id", "q"], assign, columns, rows=BATCH), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    whole = sum(int(r.total) for r in sums)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    found = [(r.cluster, int(r.total), whole, digest(centroids[r.cluster])) for r in sums]
    names = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return assigned.join(F.broadcast(spark.createDataFrame(found, names)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
