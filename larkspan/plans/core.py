"""Rule-based lookups over the tables: eligibility, bands, years, gaps, profiles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan import sources
from larkspan.operators import lookup
from larkspan.plans.registry import query
from larkspan.sources import table

THRESHOLD = 100000.0
#: Half-open bands of quantity and their grades.
BANDS = [(1.0, 10.0, 9), (10.0, 20.0, 7), (20.0, 35.0, 5), (35.0, 50.0, 2)]

_ELIGIBLE = f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice <= {THRESHOLD}"


@query(_ELIGIBLE)
def eligible_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.eligible(table(spark, sf_dir, "orders"), "o_totalprice", THRESHOLD).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT *, 'for reference' AS advisory FROM ({_ELIGIBLE})")
def advisory_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.advised(eligible_lookup(spark, sf_dir))


@query("SELECT c_custkey, count(*) AS n_parts, max(p_retailprice) AS best FROM customer JOIN part ON c_acctbal >= p_retailprice AND p_size < 3 GROUP BY c_custkey")
def eligible_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many small parts each balance reaches.

    A running count over the different prices and balances in one order: no customer
    meets a part.  Values are dealt to cells between quantiles, counted inside each cell,
    and each cell's total is added to the later ones.
    """
    cells = 64
    prices = table(spark, sf_dir, "part").where("p_size < 3 AND p_retailprice IS NOT NULL").groupBy(F.col("p_retailprice").alias("v")).agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").where("c_acctbal IS NOT NULL")
    balances = customers.select(F.col("c_acctbal").alias("v")).distinct()
    values = prices.select("v", "n", F.col("v").alias("price")).unionByName(balances.select("v", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("price")))
    bounds = values.agg(F.percentile_approx("v", [i / cells for i in range(1, cells)]).alias("q")).head()["q"] or []  # at most ``cells`` numbers
    cell = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col("v"))) if bounds else F.lit(0)
    values = values.withColumn("cell", cell)
    upto = Window.partitionBy("cell").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = values.select("v", "cell", "price", F.sum("n").over(upto).alias("n_in"), F.max("price").over(upto).alias("max_in")).where("price IS NULL")
    totals = values.groupBy("cell").agg(F.sum("n").alias("n"), F.max("price").alias("price"))
    later = totals.select("n", "price", F.explode(F.sequence(F.col("cell") + 1, F.lit(cells))).alias("later"))
    before = later.groupBy("later").agg(F.sum("n").alias("n_before"), F.max("price").alias("max_before"))
    found = inside.join(F.broadcast(before), F.col("cell") == F.col("later"), "left")  # a row per cell
    found = found.select("v", (F.col("n_in") + F.coalesce("n_before", F.lit(0))).alias("n_parts"), F.greatest("max_before", "max_in").alias("best")).where("n_parts > 0")
    return customers.join(found, F.col("c_acctbal") == F.col("v")).select("c_custkey", "n_parts", "best")


@query("SELECT grade, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem JOIN (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {g})" for a, b, g in BANDS) + ") t(b_lo, b_hi, grade) ON l_quantity >= b_lo AND l_quantity < b_hi GROUP BY grade")
def band_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "b_lo double, b_hi double, grade int")
    # Many lines share a quantity: count them first, convert the distinct values.
    values = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("c"))
    found = lookup.band_join(values, "l_quantity", bands, "b_lo", "b_hi", 5.0)
    return found.groupBy("grade").agg(F.sum("c").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


_SCORE = "CASE WHEN l_discount >= 0.05 THEN 3 ELSE 1 END + CASE WHEN l_tax <= 0.02 THEN 2 ELSE 0 END + CASE WHEN l_quantity > 30 THEN 4 WHEN l_quantity > 10 THEN 2 ELSE 1 END"


@query(f"SELECT score, count(*) AS n FROM (SELECT CAST({_SCORE} AS INTEGER) AS score FROM lineitem) GROUP BY score")
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (
        F.when(F.col("l_discount") >= 0.05, 3).otherwise(1)
        + F.when(F.col("l_tax") <= 0.02, 2).otherwise(0)
        + F.when(F.col("l_quantity") > 30, 4).when(F.col("l_quantity") > 10, 2).otherwise(1)
    )
    return table(spark, sf_dir, "lineitem").select(score.alias("score")).groupBy("score").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL")
def by_kind_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("o_year")).agg(F.count("*").alias("n"), total.alias("total"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.gaps(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT d.doc_id, quality, toxic, quality IS NULL AS no_data FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_flag(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], "quality")


_YEARS = "SELECT CAST(year({d}) AS INTEGER) AS y, count(*) AS {n} FROM {t} GROUP BY 1"


@query(f"SELECT a.y, n_orders, n_lines FROM ({_YEARS.format(d='o_orderdate', n='n_orders', t='orders')}) a JOIN ({_YEARS.format(d='l_shipdate', n='n_lines', t='lineitem')}) b ON a.y = b.y")
def same_year_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n_orders"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n_lines"))
    return lookup.same_year(orders, lines, [], "y")


def _profile_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM {name}" for c in columns)


@query(_profile_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.profile(table(spark, sf_dir, "customer"))


@query("SELECT *, 'supplier' AS source_name FROM supplier")
def raw_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").withColumn("source_name", F.lit("supplier"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 0")
def checked_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.checked(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 0, "an order without a price").select("o_orderkey")


def _written(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    """``df`` as read back from files of another format."""
    path = sources.shared_path(spark, kind)
    write, read = {"json": (sources.write_json, partial(sources.read_json, whole_files=False)), "csv": (sources.write_csv, sources.read_csv), "orc": (sources.write_orc, sources.read_orc)}[kind]
    write(df, path)
    return read(spark, path, ", ".join(f"{n} {t}" for n, t in df.dtypes))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, table(spark, sf_dir, "supplier"), "json")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, table(spark, sf_dir, "supplier"), "csv")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def orc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, table(spark, sf_dir, "supplier"), "orc")


@query("""SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE year(o_orderdate) BETWEEN 1992 AND 1998 AND year(l_shipdate) BETWEEN 1992 AND 1998 AND (year(o_orderdate) < 1995) = (year(l_shipdate) < 1995)""")
def same_system_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were shipped under the system their order was placed under."""
    systems = {y: "old" if y < 1995 else "new" for y in range(1992, 1999)}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("placed"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.year("l_shipdate").alias("shipped"))
    return lookup.same_system(orders, lines, ["o_orderkey"], "placed", "shipped", systems).select("o_orderkey", "l_linenumber")
