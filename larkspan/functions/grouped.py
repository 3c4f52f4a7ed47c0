"""Python functions over groups of any size: by parts, and a merge of what they return.

A group is split into parts of bounded size, each given to the function by itself; what it
returns is merged by Spark's aggregates, and a last expression makes the result.  So a group
with a third of all rows is many tasks, and no task holds more than a part.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About the rows of a part.
PART = 50_000


def by_parts(df: DataFrame, key: str, columns: list[str], part: Callable[[pa.Table], dict[str, float]], names: list[str], merge: dict[str, Column], rows: int = PART) -> DataFrame:
    """``key`` and the ``merge`` aggregates over the ``names`` that ``part`` returns for each part of a group."""
    partial = parts_of(df, key, columns, part, names, rows)
    return partial.groupBy(F.col("k").alias(key)).agg(*(c.alias(n) for n, c in merge.items()))


def parts_of(df: DataFrame, key: str, columns: list[str], part: Callable[[pa.Table], dict[str, float]], names: list[str], rows: int = PART) -> DataFrame:
    """k and the ``names`` that ``part`` returns for each part of a group.

    Parts are dealt by the hash of the ``columns`` and a row's place, equal rows apart.
    """
    counts = df.groupBy(F.col(key).alias("part_key")).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    many = counts.where("parts > 1")  # as many as the rows have times ``rows`` at most
    dealt = df.select(F.col(key).alias("k"), *columns).join(F.broadcast(many), F.col("k") == F.col("part_key"), "left")
    salt = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = dealt.select("k", *columns, salt.alias("part"))
    kind = df.schema[key].dataType.simpleString()

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        found = part(rows)
        return pa.table({"k": pa.array([group[0].as_py()], rows.schema.field("k").type)} | {n: pa.array([float(found[n])]) for n in names})

    return dealt.groupBy("k", "part").applyInArrow(run, f"k {kind}, " + ", ".join(f"{n} double" for n in names))


MOMENTS = ["n", "mx", "my", "sxx", "sxy"]


def moments(x: str, y: str) -> Callable[[pa.Table], dict[str, float]]:
    """Count, means and centred sums of the rows of a part that have both values."""

    def run(rows: pa.Table) -> dict[str, float]:
        import numpy as np

        a, b = (rows.column(c).to_numpy().astype(float) for c in (x, y))
        good = ~(np.isnan(a) | np.isnan(b))
        a, b = a[good], b[good]
        mx, my = (a.mean(), b.mean()) if len(a) else (0.0, 0.0)
        return {"n": len(a), "mx": mx, "my": my, "sxx": ((a - mx) ** 2).sum(), "sxy": ((a - mx) * (b - my)).sum()}

    return run


def regression(df: DataFrame, key: str, x: str, y: str, rows: int = PART) -> DataFrame:
    """``key``, n, slope and intercept of the least squares line of ``y`` by ``x`` in each group."""
    parts = parts_of(df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), key, ["x", "y"], moments("x", "y"), MOMENTS, rows)
    # A row a part: the means of a group first, then how far those of its parts are from them.
    group = Window.partitionBy("k")
    mean = lambda m: F.try_divide(F.sum(F.col("n") * F.col(m)).over(group), F.sum("n").over(group))
    parts = parts.withColumns({"gx": mean("mx"), "gy": mean("my")})
    dx, dy = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    found = parts.groupBy(F.col("k").alias(key)).agg(F.sum("n").cast("long").alias("n"), F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"), F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"))
    slope = F.try_divide("sxy", "sxx")
    return found.select(key, "n", slope.alias("slope"), (F.col("gy") - slope * F.col("gx")).alias("intercept"))
