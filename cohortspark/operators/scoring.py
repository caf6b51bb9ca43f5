"""Quintile scores, segments and rank groups.

Edges and cut points are a few numbers found by distributed selection; scoring itself is then a CASE
expression on each row, without a shuffle or a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.bands import FREQUENCY_GROUPS, VALUE_GROUPS, bin_number
from cohortspark.functions.quantiles import at_places, column_sizes, counts, order_statistics, quantile_places, quantiles, ranks_around
from cohortspark.functions.ranking import Cuts, at_or_before, cut_pairs, rank_cuts

QUINTILES = [0, 0.2, 0.4, 0.6, 0.8, 1]
QUARTILES = [0, 0.25, 0.5, 0.75, 1]


def quintile_scores(df: DataFrame, columns: dict[str, tuple[str, bool]], tie: str = "CustomerID") -> DataFrame:
    """Adds scores 1-5. `columns` maps the score's name to (value column, higher value means higher score).

    Where all six quintile edges differ, bins between them decide. Where any edge repeats, every row is scored
    by its rank instead: ceil(5 * rank / (rows + 1)), ties in order of `tie`. One count gives all sizes, one selection
    the values at all edges and ranks, and one more the ties of all columns that need them.
    """
    values = list(dict.fromkeys(value for value, _ in columns.values()))
    rows, sizes = counts(df, values)
    places = {value: quantile_places(sizes[value], QUINTILES) for value in values}
    by_rank = {
        name: Cuts(value, [j * (rows + 1) // 5 for j in range(1, 5)], sizes[value], ascending)
        for name, (value, ascending) in columns.items()
    }
    ranks = {value: set(ranks_around(places[value])) for value in values if sizes[value]}
    for cuts in by_rank.values():
        if cuts.value in ranks:
            ranks[cuts.value] |= set(cuts.places.values())
    found = order_statistics(df, {value: sorted(some) for value, some in ranks.items()}, sizes) if ranks else {}
    edges = {value: at_places(found[value], places[value]) for value in found}
    repeated = {name: cuts for name, cuts in by_rank.items() if len(set(edges.get(cuts.value, QUINTILES))) < len(QUINTILES)}
    pairs = cut_pairs(df, repeated, found, tie)
    scored = {}
    for name, (value, ascending) in columns.items():
        if value not in edges:
            scored[name] = F.lit(None).cast("int")
        elif name in pairs:
            scored[name] = _score_by_cuts(value, pairs[name], ascending, tie)
        else:
            number = bin_number(value, edges[value])
            scored[name] = number if ascending else 6 - number
    return df.withColumns({name: score.cast("int") for name, score in scored.items()})


def _score_by_cuts(value: str, cuts: list, ascending: bool, tie: str) -> Column:
    chain = F.lit(len(cuts) + 1)
    for i in range(len(cuts) - 1, -1, -1):
        chain = F.when(at_or_before(value, cuts[i], ascending, tie), i + 1).otherwise(chain)
    return chain


def segment(score: str = "RFM_Score") -> Column:
    value = F.col(score)
    return (
        F.when(value >= 13, "Very High Value")
        .when(value >= 10, "High Value")
        .when(value >= 7, "Medium Value")
        .otherwise("Lower Value")
    )


def add_rfm_scores(df: DataFrame) -> DataFrame:
    """R (recent is high), F, M, their sum and the segment, over exactly the rows given."""
    scored = quintile_scores(df, {"R": ("Recency", False), "F": ("Frequency", True), "M": ("Monetary", True)})
    return scored.withColumn("RFM_Score", F.col("R") + F.col("F") + F.col("M")).withColumn("RFM_Segment", segment())


def frequency_group(df: DataFrame, column: str = "Frequency", tie: str = "CustomerID") -> DataFrame:
    """Adds Frequency_Group: four equal-width groups of the rank, so ties never empty a group."""
    sizes = column_sizes(df, [column])
    rows = sizes[column]
    if rows == 1:
        # The middle of a range of zero width is the upper end of its second quarter.
        return df.withColumn("Frequency_Group", F.lit(FREQUENCY_GROUPS[1]))
    cuts = rank_cuts(df, column, [1 + j * (rows - 1) // 4 for j in range(1, 4)], True, tie, sizes)
    number = _score_by_cuts(column, cuts, True, tie)
    names = F.array(*[F.lit(n) for n in FREQUENCY_GROUPS])
    return df.withColumn("Frequency_Group", F.when(F.col(column).isNotNull(), F.element_at(names, number)))


def value_group(df: DataFrame, column: str = "Monetary") -> DataFrame:
    """Adds Value_Group by monetary quartile. Repeated edges are an error, as four names need four groups."""
    edges = quantiles(df, {column: QUARTILES})[column]
    if len(set(edges)) < len(QUARTILES):
        raise ValueError(f"quartile edges of {column} repeat: {edges}")
    names = F.array(*[F.lit(n) for n in VALUE_GROUPS])
    return df.withColumn("Value_Group", F.element_at(names, bin_number(column, edges)))
