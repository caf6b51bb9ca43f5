"""Positions in a total order over all rows, without sending all rows to one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.quantiles import column_sizes, order_statistics
from cohortspark.session import stored

# ---------------------------------------------------------------- cut points of a rank


@dataclass(frozen=True)
class Cuts:
    """Wanted 1-based ranks in the order `value`, then the tie column ascending, among `rows` rows with a value.

    Ranks below 1 have no row and ranks past the end mean the last row.
    """

    value: str
    ranks: Sequence[int]
    rows: int
    ascending: bool = True

    @property
    def places(self) -> dict[int, int]:
        """0-based place in the ascending values for each rank that has a row."""
        kept = {min(r, self.rows) for r in self.ranks}
        return {r: (r - 1 if self.ascending else self.rows - r) for r in sorted(kept) if r >= 1}


def cut_pairs(df: DataFrame, wanted: Mapping[str, Cuts], found: Mapping[str, dict], tie: str) -> dict[str, list[tuple | None]]:
    """The (value, tie) pair at each wanted rank, by name. `found` has the order statistics of each value column at the
    places of the cuts. One selection finds all ties within all values together; only the pairs reach the driver."""
    within: dict[tuple, dict[int, int]] = {}
    for name, cuts in wanted.items():
        for r, p in cuts.places.items():
            v, below, equal = found[cuts.value][p]
            before = below if cuts.ascending else cuts.rows - below - equal
            within.setdefault((name, v), {})[r] = r - before - 1
    groups = {f"_t{i}": key for i, key in enumerate(within)}
    ties = [F.when(F.col(wanted[name].value) == F.lit(v), F.col(tie)).alias(g) for g, (name, v) in groups.items()]
    chosen = order_statistics(df.select(*ties), {g: list(within[key].values()) for g, key in groups.items()}) if groups else {}
    pairs = {
        (name, r): (v, chosen[g][p][0]) for g, (name, v) in groups.items() for r, p in within[name, v].items()
    }
    return {name: [pairs.get((name, min(r, cuts.rows))) for r in cuts.ranks] for name, cuts in wanted.items()}


def rank_cuts(
    df: DataFrame,
    value: str,
    ranks: Sequence[int],
    ascending: bool = True,
    tie: str = "CustomerID",
    sizes: Mapping[str, int] | None = None,
) -> list[tuple | None]:
    """The (value, tie) pair that holds each 1-based rank in the order `value`, then `tie` ascending.

    Ranks below 1 give None and ranks past the end give the last row. Only these pairs reach the driver.
    """
    sizes = sizes or column_sizes(df, [value])
    cuts = Cuts(value, ranks, sizes[value], ascending)
    places = list(cuts.places.values())
    found = order_statistics(df, {value: places}, sizes) if places else {}
    return cut_pairs(df, {value: cuts}, found, tie)[value]


def at_or_before(value: str, cut: tuple | None, ascending: bool = True, tie: str = "CustomerID") -> Column:
    """True for the rows up to and including the cut pair."""
    if cut is None:
        return F.lit(False)
    v, t = cut
    earlier = F.col(value) < F.lit(v) if ascending else F.col(value) > F.lit(v)
    return earlier | ((F.col(value) == F.lit(v)) & (F.col(tie) <= F.lit(t)))


# ---------------------------------------------------------------- running totals and ranks of every row


def in_parts(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """The rows dealt into ranges of the order, stored with the number of their range in `_part`.

    There are as many ranges as the session has shuffle partitions, of similar size; columns keep their types. The
    table is stored, so the bounds are drawn once and every later reading sees the same ranges.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _offsets(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """For each range the totals of those before it, as `_o_<name>`: one row for each range."""
    sums = placed.groupBy("_part").agg(*[totals[n].alias(n) for n in totals])
    start, rows = [0] * len(totals), []
    for row in sorted(sums.collect(), key=lambda r: r["_part"]):
        rows.append((row["_part"], *start))
        start = [s + row[n] for s, n in zip(start, totals)]
    return placed.sparkSession.createDataFrame(rows, "_part int, " + ", ".join(f"_o_{n} bigint" for n in totals))


def running_totals(
    df: DataFrame, value: str, totals: dict[str, Column], ascending: bool = True, parts: int | None = None
) -> DataFrame:
    """One row per distinct `value` with each total and `cum_<total>`, the sum over all values up to it.

    Rows are summed per value before any ordering, so a value with many rows is one row afterwards. The values are
    dealt into ranges; the totals of the ranges, one row each, give every range its starting sum.
    """
    names = list(totals)
    per_value = df.filter(F.col(value).isNotNull()).groupBy(value).agg(*[totals[n].alias(n) for n in names])
    order = F.col(value).asc() if ascending else F.col(value).desc()
    placed = in_parts(per_value, [order], parts)
    offsets = _offsets(placed, {n: F.sum(n) for n in names})
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(offsets), "_part").select(
        value, *names, *[(F.sum(n).over(inside) + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in names]
    )


def global_rank(
    df: DataFrame,
    value: str,
    ascending: bool = True,
    tie: str = "CustomerID",
    name: str = "rank",
    parts: int | None = None,
) -> DataFrame:
    """Adds the 1-based position (bigint) in the order `value`, then `tie` ascending. `tie` must be unique.

    Ranges are drawn over (value, tie), so a value that most rows share is divided like any other. Rows without a
    value are left out.
    """
    order = [F.col(value).asc() if ascending else F.col(value).desc(), F.col(tie).asc()]
    placed = in_parts(df.filter(F.col(value).isNotNull()), order, parts)
    offsets = _offsets(placed, {"rows": F.count(F.lit(1))})
    inside = Window.partitionBy("_part").orderBy(*order)
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.row_number().over(inside) + F.col("_o_rows"))
    return ranked.drop("_part", "_o_rows")
