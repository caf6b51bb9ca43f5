import random

import numpy as np
import pandas as pd
import pytest

from cohortspark.functions import bands
from cohortspark.operators import scoring


def scores(df, column, ascending=True):
    rows = scoring.quintile_scores(df, {"s": (column, ascending)}).collect()
    return [r["s"] for r in sorted(rows, key=lambda r: r["CustomerID"])]


def expected(data, ascending):
    """The rule on a plain list, ids counting from 1."""
    n, edges = len(data), np.quantile(np.array(data, float), [0, 0.2, 0.4, 0.6, 0.8, 1])
    if len(set(edges)) == 6:
        bins = [1 + sum(v > e for e in edges[1:5]) for v in data]
        return [b if ascending else 6 - b for b in bins]
    order = sorted(range(n), key=lambda i: (data[i] if ascending else -data[i], i))
    result = [0] * n
    for rank, i in enumerate(order, 1):
        result[i] = -(-5 * rank // (n + 1))
    return result


def test_rank_rule_on_repeated_edges(values):
    data = [2, 2, 2, 2, 2, 3, 4, 5, 6, 7]
    assert scores(values("x", data, "bigint"), "x") == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_quantile_rule_with_edges_on_data(values):
    assert scores(values("x", list(range(1, 12)), "bigint"), "x") == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_one_and_two_customers(values):
    assert scores(values("x", [9.0]), "x") == [3]
    assert scores(values("x", [9.0, 9.0]), "x") == [2, 4]


def test_empty_input(values):
    assert scores(values("x", [1.0]).limit(0), "x") == []


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("seed, top", [(1, 4), (2, 12), (3, 1000), (4, 10**9)])
def test_against_plain_rule(values, ascending, seed, top):
    rng = random.Random(seed)
    data = [rng.randint(1, top) for _ in range(rng.randint(7, 137))]
    assert scores(values("x", data, "bigint"), "x", ascending) == expected(data, ascending)


def test_matches_pandas_cut(values):
    data = [float(v) for v in np.random.default_rng(0).lognormal(5, 2, 203)]
    want = pd.qcut(pd.Series(data), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert scores(values("x", data), "x") == want
    assert scores(values("x", data), "x", False) == [6 - w for w in want]


def test_segment_cut_offs(spark):
    df = spark.createDataFrame([(s,) for s in range(3, 16)], "RFM_Score int")
    names = {r["RFM_Score"]: r["g"] for r in df.select("RFM_Score", scoring.segment().alias("g")).collect()}
    assert [names[s] for s in (3, 6, 7, 9, 10, 12, 13, 15)] == [
        "Lower Value",
        "Lower Value",
        "Medium Value",
        "Medium Value",
        "High Value",
        "High Value",
        "Very High Value",
        "Very High Value",
    ]


def groups(df):
    rows = sorted(scoring.frequency_group(df, "x").collect(), key=lambda r: r["CustomerID"])
    return [r["Frequency_Group"] for r in rows]


@pytest.mark.parametrize(
    "data",
    [[2] * 8 + [3, 4], [2, 2, 3, 3, 3, 9, 9, 40], [5] * 100, list(np.random.default_rng(42).integers(2, 50, 1765))],
)
def test_frequency_groups_equal_a_cut_of_ranks(values, data):
    data = [int(v) for v in data]
    rank = pd.Series(data).rank(method="first")
    want = pd.cut(rank, bins=4, labels=bands.FREQUENCY_GROUPS, include_lowest=True).tolist()
    got = groups(values("x", data, "bigint"))
    assert got == want and len(set(got)) == 4


def test_frequency_group_of_a_single_customer(values):
    assert groups(values("x", [7], "bigint")) == ["Q2"]


def test_value_groups(values):
    data = [float(v) for v in range(1, 9)]
    rows = sorted(scoring.value_group(values("Monetary", data)).collect(), key=lambda r: r["CustomerID"])
    assert [r["Value_Group"] for r in rows] == [g for g in bands.VALUE_GROUPS for _ in range(2)]


def test_value_groups_need_four_distinct_edges(values):
    with pytest.raises(ValueError):
        scoring.value_group(values("Monetary", [1.0, 1.0, 1.0, 1.0, 1.0, 2.0]))


def banded(values, column, data):
    df = values("Recency", data, "int")
    return [r[0] for r in df.orderBy("CustomerID").select(column).collect()]


def test_dashboard_bands_leave_out_zero(values):
    data = [0, 30, 31, 180, 181, 9999, 10000]
    assert banded(values, bands.dashboard_recency_band(), data) == [None, "≤30d", "31–60d", "121–180d", ">180d", ">180d", None]


def test_notebook_bands_include_zero(values):
    assert banded(values, bands.notebook_recency_band(181), [0, 30, 31, 181]) == ["0–30", "0–30", "31–90", "181–182"]


@pytest.mark.parametrize(
    "longest, names",
    [
        (236, ["0–30", "31–90", "91–180", "181–237"]),
        (300, ["0–30", "31–90", "91–180", "181–270", "271–301"]),
        (500, ["0–30", "31–90", "91–180", "181–270", "271–365", ">365"]),
        (364, ["0–30", "31–90", "91–180", "181–270", "271–365"]),
        (100, ["0–30", "31–90", "91–101", "102–180"]),
    ],
)
def test_notebook_band_names(longest, names):
    assert [n for _, _, n in bands.notebook_recency_bands(longest)] == names


def test_frequency_bands_are_open_above(values):
    df = values("Frequency", [2, 3, 4, 10, 11, 20, 21], "bigint").orderBy("CustomerID")
    assert [r[0] for r in df.select(bands.frequency_band()).collect()] == ["2–3", "2–3", "4–6", "7–10", "11–20", "11–20", ">20"]


def test_columns_of_both_rules_at_once(spark):
    """Whole numbers by rank, money by bins, a column without values and one with gaps, from the same selections."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), float(rng.normal()), None, float(i % 2) if i % 3 else None) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "CustomerID bigint, few int, money double, none double, gaps double")
    columns = {"A": ("few", True), "B": ("few", False), "C": ("money", True), "D": ("none", True), "E": ("gaps", False)}
    together = {r["CustomerID"]: r for r in scoring.quintile_scores(df, columns).collect()}
    for name, (value, ascending) in columns.items():
        alone = scoring.quintile_scores(df, {name: (value, ascending)}).collect()
        assert all(together[r["CustomerID"]][name] == r[name] for r in alone)
    placed = sorted(rows, key=lambda r: (r[1], r[0]))
    for rank, r in enumerate(placed, 1):
        assert together[r[0]]["A"] == -(-5 * rank // (len(rows) + 1))
    assert {together[r[0]]["D"] for r in rows} == {None}
