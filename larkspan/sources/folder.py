"""A data source over a folder of JSON lines or raw files, below folders of one key's values.

    folder/day=2024-01-01/a.json      format "larkspan_folder", key "day"

Conditions on the key choose folders on the driver, before a task is planned; files are packed
into partitions by their bytes, and a large JSON file is cut into ranges of bytes, each read
from its first whole line.  As a stream, files come in the order of their paths.  The folder
must be reachable by path from all executors (a mounted file system).
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import json as pajson
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "larkspan_folder"
RAW = "path string, length long, content binary"
#: Bytes of a partition, and bytes of a part of a raw read's batch.
PART_BYTES = 32 << 20


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Folder)


@dataclass(frozen=True)
class File:
    path: str
    key: str | None
    size: int


def files(root: str, key: str | None) -> list[File]:
    """All files below ``root`` in the order of their paths, with the value of ``key`` in them."""
    out = []
    for at, _, names in os.walk(root):
        found = None
        for part in Path(at).relative_to(root).parts:
            if key and part.startswith(f"{key}="):
                found = unquote(part.partition("=")[2])
        for n in names:
            if n[0] not in "._":
                out.append(File(f"{at}/{n}", found, os.stat(f"{at}/{n}").st_size))
    return sorted(out, key=lambda f: f.path)


@dataclass(frozen=True)
class Part(InputPartition):
    """Ranges of bytes (path, key, start, end)."""

    ranges: tuple[tuple[str, str | None, int, int], ...]


def packed(some: Sequence[File], size: int, split: bool) -> list[Part]:
    """Partitions of about ``size`` bytes; with ``split``, no larger than that."""
    cut = [(f.path, f.key, a, min(f.size, a + size)) for f in some for a in range(0, max(1, f.size), size if split else max(1, f.size))]
    out, mine, total = [], [], 0
    for r in cut:
        if mine and total + r[3] - r[2] > size:
            out.append(Part(tuple(mine)))
            mine, total = [], 0
        mine.append(r)
        total += r[3] - r[2]
    return out + ([Part(tuple(mine))] if mine else [])


def lines(path: str, start: int, end: int) -> bytes:
    """The lines that begin in a range of bytes."""
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()
        at = f.tell()
        if at >= end:
            return b""
        data = f.read(end - at)
        return data if data.endswith(b"\n") else data + f.readline()


class _Reading:
    """What batch and stream have in common."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.schema, self.key, self.raw = schema, options.get("key"), options.get("kind", "json") == "raw"
        self.root = urlparse(options["path"]).path.rstrip("/") if options["path"].startswith("file:") else options["path"].rstrip("/")
        self.size = int(options.get("partbytes", PART_BYTES))

    def parts(self, some: Sequence[File]) -> list[Part]:
        return packed(some, self.size, not self.raw)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark plans where there are no partitions
            return
        schema = to_arrow_schema(self.schema)
        inner = pa.schema([f for f in schema if f.name != self.key])
        for path, key, start, end in partition.ranges:
            if self.raw:
                data = {"path": path, "length": end, "content": Path(path).read_bytes(), self.key: key}
                yield pa.RecordBatch.from_arrays([pa.array([data[f.name]]).cast(f.type) for f in schema], schema=schema)
                continue
            data = lines(path, start, end)
            if not data.strip():
                continue
            # A field of another type than declared is an error.
            options = pajson.ParseOptions(explicit_schema=inner, unexpected_field_behavior="ignore")
            table = pajson.read_json(pa.BufferReader(data), read_options=pajson.ReadOptions(block_size=max(1 << 20, len(data))), parse_options=options)
            columns = [pa.array([key] * len(table), pa.string()).cast(f.type) if f.name == self.key else table.column(f.name) for f in schema]
            yield from pa.table(columns, schema=schema).to_batches(max_chunksize=10_000)


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class _Reader(_Reading, DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep the conditions on the key; the others are left to Spark."""
        for f in filters:
            ours = self.key and getattr(f, "attribute", None) == (self.key,)
            if ours and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                self.tests.append((type(f), getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, key: str | None) -> bool:
        kind = next((f.dataType for f in self.schema if f.name == self.key), None)
        value = None if key is None or kind is None else pa.array([key]).cast(to_arrow_schema(StructType([f for f in self.schema if f.name == self.key])).field(0).type)[0].as_py()
        return not self.tests or value is not None and all(t is IsNotNull or _TESTS[t](value, v) for t, v in self.tests)

    def partitions(self) -> Sequence[Part]:
        return self.parts([f for f in files(self.root, self.key) if self._wanted(f.key)])


class _Stream(_Reading, DataSourceStreamReader):
    """An offset is the path of the last file taken; names must ascend, as those of days or batches do."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        some = files(self.root, self.key)
        return {"after": some[-1].path if some else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        return self.parts([f for f in files(self.root, self.key) if start["after"] < f.path <= end["after"]])


class Folder(DataSource):
    """Options: path, key (the folders' key), kind (json or raw), partBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        if self.options.get("kind", "json") != "raw":
            raise ValueError("JSON lines need a declared schema")
        return RAW + (f", {self.options['key']} string" if "key" in self.options else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, dict(self.options))
