"""Edge cases on hand-made rows: nulls, ties, band edges, empty input, years, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspan import sources, streaming
from larkspan.operators import lookup, temporal


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_bands_are_half_open(spark):
    bands = spark.createDataFrame([(0.0, 10.0, 1), (10.0, 20.0, 2)], "lo double, hi double, g int")
    values = spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,), (20.0,), (None,)], "v double")
    out = lookup.band_join(values, "v", bands, "lo", "hi", 4.0).select("v", "g")
    assert rows(out, "v") == [(0.0, 1), (9.99, 1), (10.0, 2)]


def test_years_never_mix(spark):
    a = spark.createDataFrame([("u", 2027, 1), ("u", 2028, 2)], "k string, y int, a int")
    b = spark.createDataFrame([("u", 2028, 5)], "k string, y int, b int")
    assert rows(lookup.same_year(a, b, ["k"], "y"), "y") == [("u", 2028, 2, 5)]
    with pytest.raises(ValueError, match="y"):
        lookup.same_year(a, b.drop("y"), ["k"], "y")


def test_missing_stays_missing(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, 7), (2, None)], "k int, v int")
    out = {r["k"]: (r["v"], r["no_data"]) for r in lookup.with_flag(a, b, ["k"], "v").collect()}
    assert out == {1: (7, False), 2: (None, True), None: (None, True)}
    assert lookup.gaps(a, b, ["k"]).count() == 1


def test_rules_that_break_are_errors(spark):
    df = spark.createDataFrame([(1,), (-1,)], "v int")
    assert lookup.checked(df.where("v > 0"), F.col("v") > 0, "bad").count() == 1
    with pytest.raises(Exception, match="bad"):
        lookup.checked(df, F.col("v") > 0, "bad").collect()


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert rows(lookup.profile(df), "column_name") == [("a", 0, 0, 0), ("b", 0, 0, 0)]


def test_previous_takes_strictly_earlier_rows(spark):
    df = spark.createDataFrame([(1, 1, "p", 5.0), (1, 2, "v", 6.0), (1, 3, "p", 7.0), (1, 4, "v", 8.0)], "k int, t int, e string, x double")
    out = temporal.previous(df, "k", ["t"], F.col("e") == "p", "x", "last")
    assert [r["last"] for r in out.orderBy("t").collect()] == [None, 5.0, 5.0, 7.0]


def test_asof_join_of_two_tables(spark):
    at = [dt.datetime(2024, 1, d) for d in range(1, 8)]
    left = spark.createDataFrame([(1, 10, at[0]), (1, 11, at[2]), (1, 12, at[5]), (2, 13, at[5]), (None, 14, at[5]), (1, 15, None)], "k int, i int, t timestamp")
    right = spark.createDataFrame([(1, "a", at[2]), (1, "b", at[4]), (1, None, at[6]), (None, "x", at[0]), (3, "y", at[0])], "k int, v string, t timestamp")
    out = temporal.asof(left, right, "k", "t", "t", ["v"])
    assert out.columns == ["k", "i", "t", "v"]
    assert {r["i"]: r["v"] for r in out.collect()} == {10: None, 11: "a", 12: "b", 13: None, 14: None, 15: None}
    assert temporal.asof(left, right.limit(0), "k", "t", "t", ["v"]).where("v IS NOT NULL").count() == 0


def test_eligible_with_null_cutoffs_ties_and_reversed_scales(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None), (4, 3.5), (4, 3.0)], "k int, cut double")
    assert rows(lookup.eligible(df, "cut", 3.0).select("k"), "k") == [(1,), (2,), (4,)]
    assert rows(lookup.eligible(df, "cut", 3.0, lower_is_better=True).select("k"), "k") == [(2,), (4,), (4,)]


def test_systems_of_years_are_mixed_on_request_only(spark):
    a = spark.createDataFrame([("u", 2027, 1), ("u", 2028, 2), ("u", 2030, 3)], "k string, y int, a int")
    b = spark.createDataFrame([("u", 2026, 5), ("u", 2028, 6), ("u", None, 7)], "k string, z int, b int")
    systems = {2026: "old", 2027: "old", 2028: "new"}
    assert rows(lookup.same_system(a, b, ["k"], "y", "z", systems).select("a", "b"), "a") == [(1, 5), (2, 6)]
    mixed = lookup.same_system(a, b, ["k"], "y", "z", systems, across=True)
    assert rows(mixed.select("a", "b", "mixed"), "a", "b") == [(1, 5, False), (1, 6, True), (2, 5, True), (2, 6, False)]


def test_pairs_within_an_hour(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, base + dt.timedelta(minutes=m)) for i, m in enumerate((0, 60, 61, 400))], "u int, i int, t timestamp")
    out = temporal.within(df, "u", "t", "i", 3600).select("left_id", "right_id")
    assert rows(out, "left_id", "right_id") == [(0, 1), (1, 2)]


def test_json_round_trip_and_drift(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    sources.write_json(df, str(tmp_path / "j"))
    assert rows(sources.read_json(spark, str(tmp_path / "j"), "a int, b string", whole_files=False), "a") == [(1, "x"), (2, None)]
    (tmp_path / "bad.json").write_text('{"a": "no number"}')
    with pytest.raises(Exception):  # noqa: B017
        sources.read_json(spark, str(tmp_path / "bad.json"), "a int", whole_files=False).collect()


def test_other_formats_and_drift(spark, tmp_path):
    df = spark.createDataFrame([(1, "x, y"), (2, None)], "a int, b string")
    for write, read, name in ((sources.write_csv, sources.read_csv, "c"), (sources.write_orc, sources.read_orc, "o")):
        write(df, str(tmp_path / name))
        assert rows(read(spark, str(tmp_path / name), "a int, b string"), "a") == [(1, "x, y"), (2, None)]
    with pytest.raises(Exception):  # noqa: B017
        sources.read_csv(spark, str(tmp_path / "c"), "b string, a int").collect()
    sources.write_parquet(df, str(tmp_path / "p"), "a")
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["a=1", "a=2"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.bin").write_bytes(b"\x00\x01")
    (tmp_path / "raw" / "two.txt").write_text("t")
    assert [bytes(r["content"]) for r in sources.read_raw(spark, str(tmp_path / "raw"), "*.bin").collect()] == [b"\x00\x01"]


def _events(spark, path, minutes, first=0):
    base = dt.datetime(2024, 1, 1)
    data = [(first + i, base + dt.timedelta(minutes=m), 1, "view", 1.0, "{}") for i, m in enumerate(minutes)]
    spark.createDataFrame(data, sources.SCHEMAS["events"].replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(path))


def test_late_rows_of_reordered_files_are_dropped(spark, tmp_path):
    def run(step):
        stream = streaming.tumbling(streaming.events(spark, str(tmp_path / "in")), "10 minutes", "5 minutes")
        streaming.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        return sorted((r["start"].hour * 60 + r["start"].minute, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for k, minutes in enumerate(([1, 2, 31], [8, 28, 33], [70], [75])):  # minute 8 comes after the watermark has passed its window
        _events(spark, tmp_path / "in", minutes, 10 * k)
        got = run(k)
    assert got == [(0, 2), (20, 1), (30, 2)]


def test_sliding_windows_and_lookups_of_a_stream(spark, tmp_path):
    _events(spark, tmp_path / "in", (1, 6, 12, 100))
    stream = streaming.events(spark, str(tmp_path / "in"))
    streaming.drain(streaming.sliding(stream, "10 minutes", "5 minutes", "1 minute"), str(tmp_path / "s"), str(tmp_path / "c1"))
    got = {(r["start"].hour * 60 + r["start"].minute): r["n"] for r in spark.read.parquet(str(tmp_path / "s")).collect() if r["start"].day == 1}
    assert got == {0: 2, 5: 2, 10: 1}
    routes = spark.createDataFrame([(1, 0.5), (1, 3.0), (1, None), (2, 0.1)], "user_id long, cutoff double")
    streaming.drain(streaming.reached(stream, routes, "user_id", "value", "cutoff"), str(tmp_path / "r"), str(tmp_path / "c2"))
    assert sorted((r["event_id"], r["cutoff"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [(i, 0.5) for i in range(4)]


def test_stream_equals_batch_up_to_open_windows(spark, sf_dir, tmp_path):
    events = sources.table(spark, sf_dir, "events")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = streaming.tumbling(streaming.events(spark, str(tmp_path / "in"), 10), "1 day", "10 minutes")
    streaming.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").count()
    want = {(r["window"]["start"], r["event_type"]): r["count"] for r in batch.collect()}
    last = max(k[0] for k in want)
    assert got == {k: v for k, v in want.items() if k[0] < last}


def test_sessions_and_duplicates_of_a_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(minutes=m), 1, "view", 1.0, "{}") for i, m in enumerate((0, 10, 10, 300, 900))]
    spark.createDataFrame(data, sources.SCHEMAS["events"].replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "in"))
    streaming.drain(streaming.sessions(streaming.events(spark, str(tmp_path / "in")), "30 minutes", "1 minute"), str(tmp_path / "s"), str(tmp_path / "c1"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 3]
    streaming.drain(streaming.distinct(streaming.events(spark, str(tmp_path / "in")), ["user_id"], "1 minute"), str(tmp_path / "d"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 4


def _walked(left, right):
    """The last value of each row's key by then; rows are (key, id, time) and (key, value, time)."""
    out = {}
    for k, i, t in left:
        mine = [(u, v) for m, v, u in right if m == k and k is not None and t is not None and u is not None and u <= t]
        out[i] = max(mine, key=lambda x: x[0])[1] if mine else None
    return out


@pytest.mark.parametrize("hot", [5, 40, 1_000_000])
def test_asof_join_with_hot_keys_cut_into_cells(spark, hot):
    import random

    r = random.Random(hot)
    base = dt.datetime(2024, 1, 1)
    left = [(0 if i % 3 else r.randrange(1, 9), i, base + dt.timedelta(seconds=r.randrange(3000) ** 2 // 900)) for i in range(500)] + [(None, 900, base), (0, 901, None)]
    times = r.sample(range(9000), 120)
    right = [(0 if j % 2 else r.randrange(1, 9), None if j % 11 == 0 else f"v{j}", base + dt.timedelta(seconds=t)) for j, t in enumerate(times)] + [(None, "x", base), (0, "y", None)]
    a = spark.createDataFrame(left, "k int, i int, t timestamp").withColumns({"side": F.lit("s"), "cell": F.lit(1), "found": F.lit(2.0), "row": F.lit(3)})
    b = spark.createDataFrame(right, "k int, v string, t timestamp")
    got = {x["i"]: x["v"] for x in temporal.asof(a, b, "k", "t", "t", ["v"], hot=hot).collect()}
    assert got == _walked(left, right)


def test_cells_of_a_hot_key_are_even(spark):
    base = dt.datetime(2024, 1, 1)
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 1000 + 10).cast("int")).alias("k"), (F.lit(base) + F.make_dt_interval(secs=F.pow("id", F.lit(2.0)) % 1_000_003)).alias("t"))
    cells = {r["hot_k"]: r["cuts"] for r in temporal._cells(rows, 300).collect()}
    assert set(cells) == {7} and len(cells[7]) >= 9
    cut = rows.where("k = 7").withColumn("cell", F.size(F.filter(F.array(*map(F.lit, cells[7])), lambda c: c <= F.unix_micros("t"))))
    sizes = sorted(r["count"] for r in cut.groupBy("cell").count().collect())
    assert sum(sizes) == 3000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
