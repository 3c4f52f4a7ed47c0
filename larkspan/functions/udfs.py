"""The extension surface: vectorised scalar, aggregate and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType


@pandas_udf(DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    return price * (1 - discount)


def partial_extremes(key: str, value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The least and largest value of each key in each batch, for a merge by Spark.

    No task holds more than a batch, however many rows a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(key).aggregate([(value, "min"), (value, "max")])
            yield from table.select([key, f"{value}_min", f"{value}_max"]).rename_columns([key, "lo", "hi"]).to_batches()

    return run


@udtf(returnType=StructType().add("word", StringType()).add("n", LongType()), useArrow=True)
class WordLengths:
    """Rows of the words of a text and their lengths."""

    def eval(self, text: str | None) -> Iterator[tuple[str, int]]:
        for word in (text or "").split():
            yield word, len(word)
