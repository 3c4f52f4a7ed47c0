"""The identity of a row of ``documents``, and joins by it.

``doc_id`` need not be unique or present.  Operators address a row by an order
key (``doc_id``, or the largest long for a null) and two fingerprints of the text,
128 bits together; rows that agree in all are interchangeable.  Only ``doc_id`` and
the text are taken from the input, so further columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a row without doc_id stands in the order of documents: after all others.
LAST = 9223372036854775807
#: The most rows of a table of keys (some 50 bytes each) that is sent to all executors.
BROADCAST_ROWS = 1_000_000


def order_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def second_print(text: Column | str) -> Column:
    """A fingerprint beside xxhash64 of the text alone; null and "" differ."""
    return F.xxhash64(F.lit(2), text, F.coalesce(F.length(text), F.lit(-1)))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns doc_id, ord, fp and text of each row."""
    return docs.select("doc_id", order_key().alias("ord"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))


def sent(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table of keys, marked for broadcast if it is small by its number of ``rows``, counted if not known."""
    rows = keys.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(keys) if rows <= BROADCAST_ROWS else keys.hint("merge")


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of its variants that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """``docs`` less the rows whose ``keys`` (never null) are a row of ``gone``, a written table."""
    names = [spare_name(docs, f"__key{i}") for i in range(len(keys))]
    gone = sent(gone.toDF(*(f"{n}g" for n in names)))
    on = [F.col(n) == F.col(f"{n}g") for n in names]
    return docs.withColumns(dict(zip(names, keys, strict=True))).join(gone, on, "left_anti").drop(*names)
