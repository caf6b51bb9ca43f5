import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import orchard

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, cluster int, place int"


def plain(vectors, k=8, rounds=10, seed=3):
    """Lloyd's rounds with every distance measured, in Python's integers. vectors: (id, components)."""
    text = lambda i: "" if i is None else str(i)
    digest = lambda v: hashlib.sha256(f"{seed}:{text(v[0])}".encode()).hexdigest()
    centroids = [list(v[1]) for v in sorted(vectors, key=lambda v: (digest(v), v[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        found = [min((apart(v, c), i) for i, c in enumerate(centroids)) for _, v in vectors]
        if turn < rounds:
            for i in range(len(centroids)):
                own = [v for (_, v), (_, j) in zip(vectors, found) if j == i]
                if own:
                    centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in found)
    inertia = {i: sum(d for d, j in found if j == i) for i in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(v[0], j, d, inertia[j], total, sha[j]) for v, (d, j) in zip(vectors, found)]


@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_the_search_finds_the_nearest_and_the_smaller_of_ties(seed, k, n):
    some = np.random.default_rng(seed)
    centroids, vectors = some.integers(-3, 4, (k, 3)), some.integers(-4, 5, (n, 3))
    best, least = orchard.nearest(vectors, orchard.Lists.of(centroids))
    apart = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()


def test_the_search_measures_fewer_centroids_than_there_are(monkeypatch):
    some = np.random.default_rng(1)
    centroids = some.integers(-1000, 1000, (200, 4))
    vectors = centroids[some.integers(0, 200, 500)] + some.integers(-10, 10, (500, 4))
    lists, measured = orchard.Lists.of(centroids), []
    plain_squared = orchard.squared
    monkeypatch.setattr(orchard, "squared", lambda a, b: measured.append(len(a)) or plain_squared(a, b))
    best, _ = orchard.nearest(vectors, lists)
    assert (best == ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(measured) < 500 * 200 / 3


def test_clusters_equal_the_plain_method(spark):
    some = np.random.default_rng(5)
    rows = [(i, [float(x) for x in some.normal(0, 1, 64).astype("float32")], 0, "x", 1, 1) for i in range(150)]
    rows += [(7, rows[7][1], 0, "x", 1, 1), (7, rows[7][1], 0, "x", 1, 1), (None, rows[9][1], None, None, None, None)]
    left_out = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] + [0.5] * 63]
    odd = [(500 + i, v, 0, "x", 1, 1) for i, v in enumerate(left_out)]
    found = orchard.cluster(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    whole = [(r[0], [int(np.floor(1024 * x)) for x in r[1]]) for r in rows]
    key = lambda r: (r[0] is None, *[str(x) for x in r])
    assert sorted(map(tuple, found), key=key) == sorted(plain(whole), key=key)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [i / 8] * 64, 0, "x", 1, 1) for i in range(n)]
    found = orchard.cluster(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found)) == sorted(plain([(r[0], [int(1024 * x) for x in r[1]]) for r in rows]))
    assert all(r.distance == 0 for r in found)


def test_a_component_too_large_for_exact_distances_is_an_error(spark):
    wide = spark.createDataFrame([(1, [1e30] + [0.0] * 63, 0, "x", 1, 1)], SCHEMA)
    with pytest.raises(Exception, match="a component is not below"):
        orchard.cluster(wide)
    with pytest.raises(ValueError):
        orchard.cluster(wide, k=5000)


def test_vectors_of_the_table_that_are_all_alike(spark):
    rows = [(i, [0.25] * 64, 0, "x", 1, 1) for i in range(50)]
    found = orchard.cluster(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.cluster, r.distance) for r in found} == {(0, 0)}
