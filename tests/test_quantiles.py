import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.quantiles import order_statistics, quantiles
from cohortspark.functions.ranking import at_or_before, global_rank, in_parts, rank_cuts, running_totals

PROBABILITIES = [0, 0.1, 0.25, 0.5, 0.8, 1]


def datasets():
    rng = np.random.default_rng(5)
    spread = rng.normal(0, 1e6, 4000)
    return {
        "spread": spread.tolist(),
        "skewed": rng.lognormal(0, 6, 4000).tolist(),
        "one value holds a third": np.where(rng.random(4000) < 0.34, 7.0, rng.random(4000) * 20).tolist(),
        "packed close together": (1 + rng.random(4000) * 1e-9).tolist() + [1e12],
        "all equal": [3.0] * 500,
        "single": [4.0],
    }


@pytest.mark.parametrize("name", datasets())
@pytest.mark.parametrize("limit, bins", [(10**6, 1024), (40, 60)])
def test_exact_in_both_ways(values, name, limit, bins):
    data = datasets()[name]
    got = quantiles(values("x", data), {"x": PROBABILITIES}, limit, bins)["x"]
    assert np.allclose(got, np.quantile(data, PROBABILITIES), rtol=1e-12, atol=0)


@pytest.mark.parametrize("limit", [10**6, 30])
def test_order_statistics_report_rows_below_and_equal(values, limit):
    data = sorted([5] * 400 + list(range(600)))
    ranks = [0, 5, 300, 999]
    found = order_statistics(values("x", data, "bigint"), {"x": ranks}, None, limit, 50)["x"]
    for r in ranks:
        v, below, equal = found[r]
        assert (v, below, equal) == (data[r], sum(d < data[r] for d in data), data.count(data[r]))


def test_nulls_are_ignored_and_empty_columns_have_no_quantiles(values):
    df = values("x", [1.0, None, 3.0]).withColumn("y", F.lit(None).cast("double"))
    assert quantiles(df, {"x": [0.5], "y": [0.5]}) == {"x": [2.0], "y": [None]}


def test_large_ids_stay_whole(values):
    data = [2**60 + i for i in range(5)]
    assert order_statistics(values("x", data, "bigint"), {"x": [2]})["x"][2][0] == 2**60 + 2


def test_rank_out_of_range(values):
    with pytest.raises(IndexError):
        order_statistics(values("x", [1.0]), {"x": [1]})


def test_not_a_number_counts_as_missing(values):
    df = values("x", [float("nan"), 1.0, 2.0])
    assert quantiles(df, {"x": [0.5]}) == {"x": [1.5]}


@pytest.mark.parametrize("limit", [10**6, 3])
def test_neighbouring_large_ids(values, limit):
    data = [2**53 + i for i in range(60)] + [-(2**62), 2**62]
    found = order_statistics(values("x", data, "bigint"), {"x": [0, 1, 2, 30, 61]}, None, limit, 8)["x"]
    assert [found[r][:2] for r in (0, 1, 2, 30, 61)] == [(sorted(data)[r], r) for r in (0, 1, 2, 30, 61)]


@pytest.mark.parametrize("ascending", [True, False])
def test_rank_cuts_split_rows_at_the_rank(values, ascending):
    rng = np.random.default_rng(3)
    data = [int(v) for v in rng.integers(0, 6, 200)]
    df = values("x", data, "bigint")
    order = sorted(range(200), key=lambda i: (data[i] if ascending else -data[i], i))
    for rank, cut in zip([0, 1, 57, 130, 200, 400], rank_cuts(df, "x", [0, 1, 57, 130, 200, 400], ascending)):
        kept = sorted(r["CustomerID"] for r in df.filter(at_or_before("x", cut, ascending)).collect())
        assert kept == sorted(i + 1 for i in order[:rank])


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("parts", [1, 30])
def test_global_rank_with_a_hot_value(values, ascending, parts):
    rng = np.random.default_rng(9)
    data = [int(v) for v in np.where(rng.random(3000) < 0.4, 50, rng.integers(0, 300, 3000))]
    ranked = global_rank(values("x", data, "bigint"), "x", ascending, parts=parts).collect()
    order = sorted(range(3000), key=lambda i: (data[i] if ascending else -data[i], i))
    assert {r["CustomerID"]: r["rank"] for r in ranked} == {i + 1: k for k, i in enumerate(order, 1)}


def test_no_part_grows_with_a_hot_value(values):
    df = values("x", [50] * 4000 + list(range(6000)), "bigint")
    placed = in_parts(df, [F.col("x"), F.col("CustomerID")], 20)
    assert placed.groupBy("_part").count().agg(F.max("count")).first()[0] <= 1000


def test_ranks_keep_types(spark):
    large = [(i, 2**53 + i % 2) for i in range(400)]
    ranked = global_rank(spark.createDataFrame(large, "CustomerID bigint, x bigint"), "x", parts=7).collect()
    order = sorted(large, key=lambda r: (r[1], r[0]))
    assert {r["CustomerID"]: r["rank"] for r in ranked} == {i: k for k, (i, _) in enumerate(order, 1)}
    dates = spark.createDataFrame([(f"c{i}", f"2020-01-{1 + i % 3:02d}") for i in range(50)], "CustomerID string, x string")
    dates = dates.selectExpr("CustomerID", "cast(x AS date) AS x")
    ranked = global_rank(dates, "x", False, parts=5).collect()
    order = sorted(ranked, key=lambda r: (-r["x"].toordinal(), r["CustomerID"]))
    assert [r["rank"] for r in order] == list(range(1, 51))
    cut = rank_cuts(dates, "x", [20])[0]
    assert dates.filter(at_or_before("x", cut)).count() == 20


def test_mixed_types_keep_whole_numbers(values):
    df = values("x", [2**53 + 1] * 3, "bigint").selectExpr("*", "0.5D AS y")
    found = order_statistics(df, {"x": [1], "y": [1]})
    assert found["x"][1][0] == 2**53 + 1 and found["y"][1][0] == 0.5


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("parts", [1, 13])
def test_running_totals(values, ascending, parts):
    rng = np.random.default_rng(2)
    data = [float(v) for v in np.where(rng.random(2000) < 0.3, 0.5, rng.random(2000).round(2))]
    totals = running_totals(values("x", data), "x", {"n": F.count("*")}, ascending, parts).collect()
    distinct = sorted(set(data), reverse=not ascending)
    seen, want = 0, {}
    for v in distinct:
        seen += data.count(v)
        want[v] = (data.count(v), seen)
    assert {r["x"]: (r["n"], r["cum_n"]) for r in totals} == want
