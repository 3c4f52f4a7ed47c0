"""Mergeable sketches: small summaries that are stored per part and united later.

A day's sketches are made once, by partial aggregation in each task; a report over any set
of days unites the stored ones and never reads the rows again.  Uniting is exact: the sketch
of two parts is that of all their rows, up to the order in which quantile sketches compact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log2 of the registers of a distinct count.
REGISTERS = 14
#: Items of a level of a quantile sketch.
ITEMS = 400
#: Log2 of the nominal entries of a set sketch.
ENTRIES = 14


def count_error(registers: int = REGISTERS, deviations: float = 3.0) -> float:
    """The relative error of a united distinct count that is exceeded at so many standard deviations."""
    return deviations * 1.04 / math.sqrt(2**registers)


def rank_error(items: int = ITEMS) -> float:
    """The error of a rank (0 to 1) of a quantile sketch with 99 % confidence."""
    return 2.446 / items**0.9433


def summaries(df: DataFrame, keys: list[Column | str], item: str, value: str) -> DataFrame:
    """One row for each group: its rows, its different ``item``s, the quantiles of ``value`` and the set of items."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(item, REGISTERS).alias("items"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), ITEMS).alias("ranks"),
        F.theta_sketch_agg(item, ENTRIES).alias("members"),
    )


def united(stored: DataFrame, *keys: str) -> DataFrame:
    """The summaries of larger groups from stored ones."""
    return stored.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("items").alias("items"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
        F.theta_union_agg("members").alias("members"),
    )


def distinct(sketch: str = "items") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(q: float, sketch: str = "ranks") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def common(a: Column | str, b: Column | str) -> Column:
    """About how many items two sets share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
