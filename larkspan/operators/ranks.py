"""Ranks of groups of any size: no task orders a whole group.

Values are cut into cells at quantiles of the whole column; rows are ordered within a group's
cell, and the rows of the group's earlier cells are added.  Equal values share a cell, so ties
are ranked as one window over the group would rank them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 128


def ranked(df: DataFrame, group: list[str], value: str, ident: str, cells: int = CELLS) -> DataFrame:
    """``df`` with row_no (by value, then ident), rank (ties share the least) and n, the rows of the group.

    Null values come first, as one value.
    """
    bounds = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / cells for i in range(1, cells)], 20 * cells).alias("q")).head()["q"] or []
    cell = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), lambda b: b <= F.col(value).cast("double")))
    rows = df.withColumn("__cell", F.when(F.col(value).isNull(), -1).otherwise(cell))
    each = Window.partitionBy(*group, "__cell").orderBy(F.asc_nulls_first(value), ident)
    ties = Window.partitionBy(*group, "__cell").orderBy(F.asc_nulls_first(value))
    placed = rows.withColumns({"__row": F.row_number().over(each), "__rank": F.rank().over(ties)})
    counts = rows.groupBy(*group, "__cell").agg(F.count("*").alias("__n"))  # at most CELLS + 1 rows a group
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    offsets = counts.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("n"))
    on = F.col("__cell") == F.col("__c")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = placed.join(offsets, on)
    return out.select(*df.columns, (F.col("__before") + F.col("__row")).alias("row_no"), (F.col("__before") + F.col("__rank")).alias("rank"), "n")


def tile(tiles: int) -> Column:
    """The tile (from 1) of a row by row_no and n, as ``ntile`` deals them."""
    q, rest = F.floor(F.col("n") / tiles), F.col("n") % tiles
    wide = rest * (q + 1)
    inside = F.floor((F.col("row_no") - 1) / (q + 1)) + 1
    after = F.floor(F.try_divide(F.col("row_no") - 1 - wide, q)) + rest + 1
    return F.when(F.col("row_no") <= wide, inside).otherwise(after).cast("int")


def percent(place: str = "rank") -> Column:
    """The share of the group's other rows before a row, as ``percent_rank`` has it."""
    return F.when(F.col("n") > 1, (F.col(place) - 1) / (F.col("n") - 1)).otherwise(0.0)
