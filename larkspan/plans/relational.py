"""Joins, aggregates, sets and multi-table queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import temporal
from larkspan.plans.registry import query
from larkspan.sources import register, table


def _money(expr: str) -> Column:
    """An exact sum of amounts, as a double."""
    return F.expr(f"CAST(sum(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)")


_NET = "l_extendedprice * (1 - l_discount)"


@query(f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty,
  CAST(sum(CAST({_NET} AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(_money("l_quantity").alias("sum_qty"), _money(_NET).alias("revenue"), F.count("*").alias("n"))


_FORECAST = "l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24"


@query(f"SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND {_FORECAST}")
def revenue_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(f"l_shipdate >= TIMESTAMP_NTZ '1997-01-01' AND l_shipdate < TIMESTAMP_NTZ '1998-01-01' AND {_FORECAST}")
    return rows.agg(_money("l_extendedprice * l_discount").alias("revenue"))


@query(f"""SELECT o_orderkey, o_orderdate, CAST(sum(CAST({_NET} AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
  GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ '1998-03-15'").join(customers, "o_custkey", "left_semi")
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate > TIMESTAMP_NTZ '1998-03-15'").groupBy("l_orderkey").agg(_money(_NET).alias("revenue"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", "o_orderdate", "revenue").orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query(f"""SELECT n_name, CAST(sum(CAST({_NET} AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name""")
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 2")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.where("c_nationkey = s_nationkey").groupBy("n_name").agg(_money(_NET).alias("revenue"))


@query(f"SELECT round(100.0 * CAST(sum(CASE WHEN p_type = 'PROMO' THEN CAST({_NET} AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST({_NET} AS DECIMAL(18,4))) AS DOUBLE), 6) AS promo_share FROM lineitem JOIN part ON l_partkey = p_partkey")
def promo_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    share = F.try_divide(_money(f"CASE WHEN p_type = 'PROMO' THEN {_NET} ELSE 0 END"), _money(_NET))
    return joined.agg(F.round(share * 100.0, 6).alias("promo_share"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN
  (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)""")
def large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).where("q > 150")
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(dear, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey IS NULL AS no_order, n_lines IS NULL AS no_lines, count(*) AS n FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY ALL")
def full_outer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    return joined.groupBy(F.col("o_orderkey").isNull().alias("no_order"), F.col("n_lines").isNull().alias("no_lines")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""")
def asof_prev_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.previous(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "value", "last_purchase")
    return found.select("event_id", "user_id", "event_type", "last_purchase")


@query("""SELECT e.event_id, e.user_id, o.last_order FROM events e ASOF LEFT JOIN
  (SELECT o_custkey, o_orderdate, max(o_orderkey) AS last_order FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def asof_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last order its user had placed by then."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("last_order"))
    return temporal.asof(events, orders, "user_id", "ts", "o_orderdate", ["last_order"]).select("event_id", "user_id", "last_order")


@query("SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.within(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600).select("user_id", "left_id", "right_id")


_CUBE = "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY {0}"


@query(_CUBE.format("CUBE (l_returnflag, l_linestatus)"))
def cube_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("n"))


@query("SELECT r_name, n_name, CAST(grouping_id(r_name, n_name) AS BIGINT) AS gid, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "n_name").agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("n"))


@query(_CUBE.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "lineitem")
    return spark.sql(_CUBE.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def distinct_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))


_DEAR = "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000"


@query(f"SELECT c_custkey AS k FROM customer UNION ALL {_DEAR}")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.unionByName(b)


@query(f"SELECT c_custkey AS k FROM customer INTERSECT {_DEAR}")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query(f"SELECT c_custkey AS k FROM customer EXCEPT {_DEAR}")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.subtract(b)


_TREE = """WITH RECURSIVE e AS (
  SELECT concat('r', CAST(n_regionkey AS STRING)) AS parent, concat('n', CAST(n_nationkey AS STRING)) AS child FROM nation
  UNION ALL SELECT concat('n', CAST(s_nationkey AS STRING)), concat('s', CAST(s_suppkey AS STRING)) FROM supplier
  UNION ALL SELECT concat('n', CAST(c_nationkey AS STRING)), concat('c', CAST(c_custkey AS STRING)) FROM customer
), t(root, node, depth) AS (
  SELECT concat('r', CAST(r_regionkey AS STRING)), concat('r', CAST(r_regionkey AS STRING)), 0 FROM region
  UNION ALL SELECT t.root, e.child, t.depth + 1 FROM t JOIN e ON t.node = e.parent
)
SELECT root, depth, count(*) AS n FROM t GROUP BY root, depth"""


@query(_TREE)
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places, suppliers and customers are below each region, level by level."""
    register(spark, sf_dir, "region", "nation", "supplier", "customer")
    return spark.sql(_TREE)


_LATERAL = "SELECT n_nationkey, n_name, m.top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey) m"


@query(_LATERAL)
def lateral_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "nation", "customer")
    return spark.sql(_LATERAL)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimension tables of a fixed size (5 and 25 rows)."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))
