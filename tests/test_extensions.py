"""Databases, variants and sketches on hand-made rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from larkspan.functions import sketches, variants
from larkspan.operators import lookup
from larkspan.sources import database


@pytest.fixture
def db():
    return database.Database(f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true")


def parts(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().collect()


def test_ranges_follow_the_rows_of_a_skewed_key(spark, db):
    """Most keys are crowded at the low end, a few are far away; nulls and extremes are read too."""
    rows = [(i % 500, f"a{i}") for i in range(4000)] + [(10_000 + 1_000 * i, "far") for i in range(200)] + [(None, "none"), (-7, "low")]
    df = spark.createDataFrame(rows, "k int, v string")
    database.write(df, db, "t", connections=2, batch=100)
    back = database.read(spark, db, "t", "k", rows=900)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    crowded = database.ranges(spark, db, "t", "k", 900)
    assert len(crowded) >= 2 and "IS NULL" in crowded[0]
    even = spark.createDataFrame([(i, "x") for i in range(3000)], "k long, v string")
    database.write(even, db, "e")
    sizes = [r["count"] for r in parts(database.read(spark, db, "e", "k", rows=500))]
    assert len(sizes) >= 6 and max(sizes) <= 500


def test_conditions_and_columns_reach_the_database(spark, db):
    df = spark.createDataFrame([(i, float(i % 100), "x" * 10) for i in range(1000)], "k long, cut double, v string")
    database.write(df, db, "t")
    found = lookup.eligible(database.read(spark, db, "t", "k", rows=300), "cut", 10.0).select("k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(cut), *LessThanOrEqual(cut,10.0)]" in plan and "ReadSchema: struct<k:bigint>" in plan and "Filter " not in plan
    assert found.count() == 110
    total = database.run(spark, db, 'SELECT COUNT(*) AS n FROM t WHERE "cut" > 50').head()
    assert total["N" if "N" in total.asDict() else "n"] == 490


def test_empty_tables_null_keys_and_existing_tables(spark, db):
    none = spark.createDataFrame([], "k long, v string")
    database.write(none, db, "empty_one")
    assert database.ranges(spark, db, "empty_one", "k", 10) == ["1 = 1"] and database.read(spark, db, "empty_one", "k").count() == 0
    database.write(spark.createDataFrame([(None, "a"), (None, None)], "k long, v string"), db, "with_gaps")
    assert database.read(spark, db, "with_gaps", "k", rows=1).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        database.write(none, db, "empty_one")
    database.write(spark.createDataFrame([(1, "b")], "k long, v string"), db, "with_gaps", mode="append")
    assert {(r["k"], r["v"]) for r in database.read(spark, db, "with_gaps", "k", rows=1).collect()} == {(None, "a"), (None, None), (1, "b")}


JSON = ['{"k": 1}', '{"k": "2", "z": null}', '{"k": {"v": 3.0}}', "[4]", "null", "7", "{broken", None, "", '{"k": 99999999999}', '{"a b": true}']


def test_fields_of_variants(spark, tmp_path):
    df = variants.parsed(spark.createDataFrame(list(enumerate(JSON)), "i int, j string"), "j", "v")
    df.select("i", "v").write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert dict(back.dtypes)["v"] == "variant"
    for table in (df, back):
        got = {r["i"]: (r["k"], r["none"]) for r in table.select("i", variants.first_of("v", ["$.k", "$.k.v", "$[0]"], "int").alias("k"), F.col("v").isNull().alias("none")).collect()}
        assert {i: k for i, (k, _) in got.items() if k is not None} == {0: 1, 1: 2, 2: 3, 3: 4}
        assert {i for i, (_, none) in got.items() if none} == {6, 7, 8}
    names = {(r["i"], r["name"], r["x"]) for r in variants.members(back, "v", "i").select("i", "name", F.to_json("value").alias("x")).collect()}
    assert names == {(0, "k", "1"), (1, "k", '"2"'), (1, "z", "null"), (2, "k", '{"v":3}'), (9, "k", "99999999999"), (10, "a b", "true")}


def test_shapes_of_variants(spark):
    df = variants.parsed(spark.createDataFrame([("g", '{"a": 1}'), ("g", '{"b": [1, 2]}'), ("g", "{"), ("h", '{"a": {"c": "x"}}')], "g string, j string"), "j", "v")
    got = {r["g"]: (r["n"], r["n_invalid"], r["shape"]) for r in variants.shapes(df, "v", "g").collect()}
    assert got == {"g": (3, 1, "OBJECT<a: BIGINT, b: ARRAY<BIGINT>>"), "h": (1, 0, "OBJECT<a: OBJECT<c: STRING>>")}


def test_united_sketches(spark, tmp_path):
    """Groups from one item to 60,000, over 20 days, some items on all of them."""
    rows = spark.range(300_000).select((F.col("id") % 20).alias("day"), F.when(F.col("id") < 200_000, "big").when(F.col("id") < 299_990, "mid").when(F.col("id") < 299_999, "few").otherwise("one").alias("g"), F.when(F.col("id") < 200_000, F.col("id") % 60_000).otherwise(F.col("id") % 777).alias("item"), (F.col("id") * 7919 % 1000).cast("double").alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(1, "nulls", None, None)], "day long, g string, item long, x double"))
    sketches.summaries(rows, ["day", "g"], "item", "x").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    united = {r["g"]: r for r in sketches.united(stored, "g").select("g", "n", sketches.distinct().alias("d"), F.theta_sketch_estimate("members").alias("t")).collect()}
    one = {r["g"]: r["d"] for r in rows.groupBy("g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("item", sketches.REGISTERS)).alias("d")).collect()}
    exact = {r["g"]: (r["n"], r["d"]) for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("item").alias("d")).collect()}
    assert set(united) == set(exact) and exact["big"][1] == 60_000
    for g, (n, d) in exact.items():
        assert united[g]["n"] == n
        assert abs(united[g]["d"] - d) <= sketches.count_error() * d and abs(united[g]["t"] - d) <= sketches.count_error(sketches.ENTRIES) * d
        assert abs(united[g]["d"] - one[g]) <= 0.002 * d
    again = sketches.united(sketches.united(stored.where("day < 7"), "g").unionByName(sketches.united(stored.where("day >= 7"), "g")), "g")
    assert {r["g"]: r["d"] for r in again.select("g", sketches.distinct().alias("d")).collect()} == {g: r["d"] for g, r in united.items()}
    for q in (0.05, 0.5, 0.95):
        found = {r["g"]: r["x"] for r in sketches.united(stored.where("g <> 'nulls'"), "g").select("g", sketches.quantile(q).alias("x")).collect()}
        for g in ("big", "mid"):
            share = rows.where(f"g = '{g}'").agg(F.avg((F.col("x") <= found[g]).cast("int"))).head()[0]
            assert abs(share - q) <= sketches.rank_error() + 0.001  # a value is a thousandth of the rows


def test_items_that_sets_share(spark):
    rows = spark.range(40_000).select(F.lit("a").alias("g"), F.col("id").alias("item"), F.lit(1.0).alias("x")).unionByName(spark.range(30_000, 90_000).select(F.lit("b").alias("g"), F.col("id").alias("item"), F.lit(1.0).alias("x")))
    sets = {r["g"]: r["members"] for r in sketches.summaries(rows, ["g"], "item", "x").collect()}
    both = spark.createDataFrame([(sets["a"], sets["b"])], "a binary, b binary")
    assert abs(both.select(sketches.common("a", "b")).head()[0] - 10_000) <= 2_000
