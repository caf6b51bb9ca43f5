"""Exact order statistics and quantiles of columns of any size.

Selection works by counting. A column with few distinct values is counted per value and cumulated. A numeric column
with more is narrowed first: the values between the bounds around a wanted rank are counted in bins, the bin that
holds the rank gives the next bounds, and this repeats until few distinct values are left inside. Counts per bin are
ordinary partial sums; no step shuffles rows or holds more than `distinct_limit` values in one task, whatever the
distribution. Not-a-number counts as missing. Columns that are no numbers are counted per value at any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTINCT_LIMIT = 2_000_000
BINS = 1_024


def counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """All rows, and the non-null rows of each column."""
    df = _numbers(df, columns)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return row["rows"], {c: row[f"n{i}"] for i, c in enumerate(columns)}


def column_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Non-null rows of each column."""
    return counts(df, columns)[1]


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns, with not-a-number as null."""
    floats = {c for c in columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in columns])


def _few_distinct(estimate: int, limit: int) -> bool:
    """The estimate has a standard error of 5 %; five of them are allowed for."""
    return estimate * 1.25 <= limit


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    sizes: Mapping[str, int] | None = None,
    distinct_limit: int = DISTINCT_LIMIT,
    bins: int = BINS,
) -> dict[str, dict[int, tuple]]:
    """For each column and each 0-based rank of its ascending non-null values: (value, rows below, rows equal)."""
    sizes = sizes or column_sizes(df, list(ranks))
    df = _numbers(df, list(ranks))
    for c, wanted in ranks.items():
        if any(not 0 <= r < sizes[c] for r in wanted):
            raise IndexError(f"rank outside 0..{sizes[c] - 1} for column {c}")
    long = [c for c in ranks if sizes[c] > distinct_limit and isinstance(df.schema[c].dataType, T.NumericType)]
    estimates = df.agg(*[F.approx_count_distinct(c).alias(c) for c in long]).first().asDict() if long else {}
    small, found = {}, {}
    for c, wanted in ranks.items():
        if c not in estimates or _few_distinct(estimates[c], distinct_limit):
            small[c] = sorted(set(wanted))
        else:
            found[c] = _select_large(df, c, sorted(set(wanted)), sizes[c], distinct_limit, bins)
    by_kind: dict[str, dict[str, Sequence[int]]] = {}
    for c, wanted in small.items():
        by_kind.setdefault(_kind(df, c), {})[c] = wanted
    found.update(_select_small(df, by_kind) if by_kind else {})
    return found


def _kind(df: DataFrame, column: str) -> str:
    """The type in which a column is counted: whole numbers as bigint, floats as double, others as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    return "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else kind.simpleString()


def _select_small(df: DataFrame, by_kind: Mapping[str, Mapping[str, Sequence[int]]]) -> dict[str, dict[int, tuple]]:
    """Count per distinct value of all columns, cumulate, keep the values that cover a wanted rank. One job for all."""
    parts = [_covering(df, ranks, kind, f"v{i}") for i, (kind, ranks) in enumerate(by_kind.items())]
    covering = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [list(ranks) for ranks in by_kind.values()]
    found: dict[str, dict[int, tuple]] = {c: {} for some in columns for c in some}
    for row in covering.collect():
        kind = row["kind"]
        c = columns[kind][row["c"]]
        for r in list(by_kind.values())[kind][c]:
            if row["below"] <= r < row["below"] + row["equal"]:
                found[c][r] = (row[f"v{kind}"], row["below"], row["equal"])
    return found


def _covering(df: DataFrame, ranks: Mapping[str, Sequence[int]], kind: str, value: str) -> DataFrame:
    """The values of columns of one type that cover a wanted rank, with the rows below and equal."""
    columns = list(ranks)
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast(kind).alias("v")) for i, c in enumerate(columns)])
    counted = (
        df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count("*").alias("equal"))
    )
    running = Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("below", F.sum("equal").over(running) - F.col("equal"))
    wanted = F.element_at(F.array(*[F.array(*[F.lit(r).cast("bigint") for r in ranks[c]]) for c in columns]), F.col("c") + 1)
    covers = F.exists(wanted, lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("equal")))
    return placed.filter(covers).select(F.lit(int(value[1:])).alias("kind"), "c", "below", "equal", F.col("v").alias(value))


def _bin(v: Column, low, high, bins: int) -> Column:
    """Number of the bin between two bounds: the first holds the lower bound alone, the last the upper one alone."""
    share = (v.cast("double") - float(low)) / max(float(high) - float(low), 5e-324)
    within = F.floor(share * (bins - 2)).cast("int") + 1
    within = F.greatest(F.lit(1), F.least(F.lit(bins - 2), F.coalesce(within, F.lit(1))))
    return F.when(v <= F.lit(low), 0).when(v >= F.lit(high), bins - 1).otherwise(within)


def _select_large(df, column, ranks, rows, distinct_limit, bins) -> dict[int, tuple]:
    values = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())
    v = F.col("v")

    def inside(low, high):
        return (v >= F.lit(low)) & (v <= F.lit(high))

    targets = [[r] for r in ranks]
    # One box per target: lowest value, highest value, rows below it, rows in it, distinct values in it.
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.approx_count_distinct("v").alias("n")).first()
    boxes = [(ends["low"], ends["high"], 0, rows, ends["n"]) for _ in targets]
    while True:
        wide = [b for b in dict.fromkeys(boxes) if b[0] != b[1] and not _few_distinct(b[4], distinct_limit)]
        if not wide:
            break
        placed = F.array(
            *[
                F.when(inside(*b[:2]), F.struct(F.lit(k).alias("k"), _bin(v, b[0], b[1], bins).alias("b"), v.alias("v")))
                for k, b in enumerate(wide)
            ]
        )
        counted = values.select(F.inline(F.array_compact(placed))).groupBy("k", "b")
        counted = counted.agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.approx_count_distinct("v").alias("d")
        )
        narrower: dict[tuple, list[tuple]] = {b: [] for b in wide}
        for row in sorted(counted.collect(), key=lambda r: (r["k"], r["b"])):
            box = wide[row["k"]]
            done = narrower[box]
            below = done[-1][2] + done[-1][3] if done else box[2]
            done.append((row["low"], row["high"], below, row["n"], row["d"]))
        for i, (r,) in enumerate(targets):
            boxes[i] = next((b for b in narrower.get(boxes[i], []) if b[2] <= r < b[2] + b[3]), boxes[i])

    tagged = F.array(
        *[F.when(inside(*box[:2]), F.struct(F.lit(i).alias("k"), v.alias("v"))) for i, box in enumerate(boxes)]
    )
    counted = (
        values.select(F.explode(F.array_compact(tagged)).alias("t"))
        .groupBy(F.col("t.k").alias("k"), F.col("t.v").alias("v"))
        .agg(F.count("*").alias("equal"))
    )
    running = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.element_at(F.array(*[F.lit(box[2]).cast("bigint") for box in boxes]), F.col("k") + 1)
    first = F.element_at(F.array(*[F.lit(t[0]).cast("bigint") for t in targets]), F.col("k") + 1)
    last = F.element_at(F.array(*[F.lit(t[-1]).cast("bigint") for t in targets]), F.col("k") + 1)
    placed = counted.withColumn("below", F.sum("equal").over(running) - F.col("equal") + start)
    found = {}
    for row in placed.filter((F.col("below") <= last) & (first < F.col("below") + F.col("equal"))).collect():
        for r in targets[row["k"]]:
            if row["below"] <= r < row["below"] + row["equal"]:
                found[r] = (row["v"], row["below"], row["equal"])
    return found


def quantile_places(rows: int, probabilities: Sequence) -> list[Fraction]:
    """The 0-based places of quantiles among `rows` ordered values; a place between two ranks lies between their values."""
    return [Fraction(str(p)) * (rows - 1) for p in probabilities] if rows else []


def ranks_around(places: Sequence[Fraction]) -> list[int]:
    return sorted({r for x in places for r in (floor(x), floor(x) + (x.denominator > 1))})


def at_places(found: Mapping[int, tuple], places: Sequence[Fraction]) -> list[float]:
    """Values at the places from the order statistics around them, linearly interpolated."""
    edges = []
    for x in places:
        low = float(found[floor(x)][0])
        high = float(found[floor(x) + (x.denominator > 1)][0])
        edges.append(low if low == high else low + (high - low) * float(x - floor(x)))
    return edges


def quantiles(
    df: DataFrame,
    probabilities: Mapping[str, Sequence],
    distinct_limit: int = DISTINCT_LIMIT,
    bins: int = BINS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; None for a column without values."""
    sizes = column_sizes(df, list(probabilities))
    places = {c: quantile_places(sizes[c], ps) for c, ps in probabilities.items()}
    ranks = {c: ranks_around(xs) for c, xs in places.items() if xs}
    found = order_statistics(df, ranks, sizes, distinct_limit, bins) if ranks else {}
    return {c: at_places(found[c], places[c]) if places[c] else [None] * len(ps) for c, ps in probabilities.items()}
