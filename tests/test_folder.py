"""The folder source: planning, pushed conditions, byte ranges, raw files and streams."""

import datetime as dt
import json

import pytest

from larkspan import streaming
from larkspan.sources import folder

SCHEMA = "i long, s string, day date"


@pytest.fixture
def days(spark, tmp_path):
    folder.register(spark)
    root = tmp_path / "days"
    for d in range(1, 11):
        at = root / f"day=2024-01-{d:02}"
        at.mkdir(parents=True)
        (at / "a.json").write_text("".join(json.dumps({"i": 100 * d + k, "s": "é" * (k % 7), "more": [k]}) + "\n" for k in range(50)))
    (root / "day=2024-01-03" / "b.json").write_text('{"s": null}\n\n{"i": 7}')
    (root / "day=2024-01-04" / "_SUCCESS").write_text("")
    (root / "day=2024-01-05" / "empty.json").write_text("")
    return root


def load(spark, root, schema=SCHEMA, **options):
    return spark.read.format(folder.NAME).schema(schema).options(key="day", **options).load(str(root))


def test_rows_and_partitions(spark, days):
    rows = load(spark, days, partBytes=400)
    assert rows.count() == 502
    got = {(r["i"], r["s"]) for r in load(spark, days).where("day = DATE '2024-01-03'").collect()}
    assert got == {(300 + k, "é" * (k % 7)) for k in range(50)} | {(None, None), (7, None)}


@pytest.mark.parametrize(("condition", "days_read"), [("day = DATE '2024-01-03'", 1), ("day >= DATE '2024-01-08'", 3), ("day IN (DATE '2024-01-01', DATE '2024-01-09')", 2), ("day > DATE '2024-01-02' AND day < DATE '2024-01-05' AND i > 0", 2), ("i > 0", 10), ("day <= DATE '2023-01-01'", 0), ("day <> DATE '2024-01-01'", 10)])
def test_conditions_on_the_key_choose_files(spark, days, condition, days_read):
    rows = load(spark, days, partBytes=10_000_000)
    plan = folder._Reader(rows.schema, {"path": str(days), "key": "day"})
    everything = [tuple(r) for r in rows.collect()]
    got = load(spark, days).where(condition)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, spark.createDataFrame(everything, SCHEMA).where(condition).collect()), key=str)
    one_a_file = load(spark, days, partBytes=1_000_000_000).where(condition)
    assert one_a_file.rdd.getNumPartitions() <= 1 and plan.partitions()
    small = load(spark, days, partBytes=900).where(condition).rdd.getNumPartitions()
    assert max(1, days_read) <= small <= 5 * days_read + 1


def test_every_line_is_in_one_range(tmp_path):
    text = "".join("x" * (k % 13) + "\n" for k in range(200)) + "last"
    path = tmp_path / "f"
    path.write_text(text)
    for size in (1, 2, 7, 64, 10_000):
        parts = folder.packed([folder.File(str(path), None, len(text))], size, True)
        data = b"".join(folder.lines(p, a, b) for part in parts for p, _, a, b in part.ranges)
        assert data.decode() == text
        assert all(sum(b - a for _, _, a, b in part.ranges) <= size for part in parts)


def test_large_files_are_cut(spark, tmp_path):
    folder.register(spark)
    (tmp_path / "one.json").write_text("".join(json.dumps({"i": k, "s": "y" * (k % 50)}) + "\n" for k in range(5000)))
    rows = spark.read.format(folder.NAME).schema("i long, s string").option("partBytes", 20_000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 5
    assert rows.count() == 5000 and rows.selectExpr("sum(i)").head()[0] == 5000 * 4999 // 2


def test_other_types_than_declared_are_errors(spark, tmp_path):
    folder.register(spark)
    (tmp_path / "bad.json").write_text('{"i": "text"}\n')
    with pytest.raises(Exception, match="(?i)json|convert"):
        spark.read.format(folder.NAME).schema("i long").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="declared schema"):
        spark.read.format(folder.NAME).load(str(tmp_path)).collect()


def test_raw_files(spark, tmp_path):
    folder.register(spark)
    for kind, data in (("a", b"\x00\x01"), ("b", b"")):
        (tmp_path / f"kind={kind}").mkdir()
        (tmp_path / f"kind={kind}" / "x.pdf").write_bytes(data)
    rows = spark.read.format(folder.NAME).options(kind="raw", key="kind").load(str(tmp_path))
    assert {(r["kind"], bytes(r["content"]), r["length"]) for r in rows.collect()} == {("a", b"\x00\x01", 2), ("b", b"", 0)}
    assert [r["path"] for r in rows.where("kind = 'b'").collect()] == [str(tmp_path / "kind=b" / "x.pdf")]


def test_stream_takes_each_file_once(spark, days, tmp_path):
    def run():
        stream = spark.readStream.format(folder.NAME).schema(SCHEMA).option("key", "day").load(str(days))
        streaming.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        return sorted(r["i"] for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect() if r["i"] is not None)

    first = run()
    assert len(first) == 501 and run() == first
    (days / "day=2024-01-11").mkdir()
    (days / "day=2024-01-11" / "a.json").write_text('{"i": 5000}\n')
    assert run() == [*first, 5000]
    assert spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).where(f"day = DATE '{dt.date(2024, 1, 11)}'").count() == 1
