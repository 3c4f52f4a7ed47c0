"""JSON of any shape as binary variant columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: the JSON text of ``column`` as a variant, null where it is no JSON."""
    return df.withColumn(out, F.try_parse_json(column))


def field(variant: Column | str, path: str, kind: str) -> Column:
    """The value at ``path`` as ``kind``; null where there is none or it cannot be one."""
    return F.try_variant_get(variant if isinstance(variant, Column) else F.col(variant), path, kind)


def first_of(variant: str, paths: list[str], kind: str) -> Column:
    """The first of several places at which the value is given as ``kind``."""
    return F.coalesce(*(field(variant, p, kind) for p in paths))


def shapes(df: DataFrame, variant: str, *keys: str) -> DataFrame:
    """One schema that all variants of a group fit, merged from those of the rows; nulls count apart."""
    v = F.col(variant)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_invalid"), F.schema_of_variant_agg(v).alias("shape"))


def members(df: DataFrame, variant: str, *keep: str) -> DataFrame:
    """A row for each member of each object: its name, and its value as a variant.

    Variants that are no object have none.
    """
    # A variant that is no object has no map of its members.
    pairs = F.try_variant_get(F.col(variant), "$", "map<string, variant>")
    return df.select(*keep, F.explode(pairs).alias("name", "value"))
