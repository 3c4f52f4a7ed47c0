"""Scalar, array, map and JSON functions, vectors and user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan import sources
from larkspan.functions import udfs, vectors
from larkspan.operators import nearest
from larkspan.plans.registry import query
from larkspan.sources import register, table


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS INTEGER) AS len, substring(c_name, 1, 4) AS head, replace(c_mktsegment, 'E', '3') AS leet, reverse(c_mktsegment) AS back, concat_ws('-', c_mktsegment, c_name) AS both FROM customer")
def string_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper(name).alias("up"), F.lower(segment).alias("low"), F.length(name).alias("len"), F.substring(name, 1, 4).alias("head"), F.replace(segment, F.lit("E"), F.lit("3")).alias("leet"), F.reverse(segment).alias("back"), F.concat_ws("-", segment, name).alias("both"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS age FROM orders")
def date_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofweek(day).alias("dow"), F.trunc(day, "month").alias("first_day"), F.date_add(day, 30).alias("due"), F.date_diff(day, F.lit("1995-01-01").cast("date")).alias("age"))


@query("SELECT p_partkey, abs(p_retailprice - 1000) AS dist, CAST(floor(p_retailprice) AS BIGINT) AS lo, CAST(ceil(p_retailprice) AS BIGINT) AS hi, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS logged, CAST(p_size % 7 AS INTEGER) AS rest, round(power(p_size, 2), 2) AS square FROM part")
def math_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.abs(price - 1000).alias("dist"), F.floor(price).alias("lo"), F.ceil(price).alias("hi"), F.round(F.sqrt(price), 6).alias("root"), F.round(F.ln(price), 6).alias("logged"), (F.col("p_size") % 7).alias("rest"), F.round(F.pow("p_size", F.lit(2)), 2).alias("square"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def array_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


_SIM = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[]))"


@query(f"""SELECT query_id, vec_id, round(exact, 5) AS sim FROM (
  SELECT z.vec_id AS query_id, e.vec_id, {_SIM} AS exact, row_number() OVER (PARTITION BY z.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS place
  FROM embeddings e, embeddings z WHERE z.vec_id % 100 = 0 AND e.vec_id <> z.vec_id) WHERE place <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to each vector whose id is divisible by 100.

    The queries are a stated set, held against all rows in strips.
    """
    rows = nearest.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = nearest.exact(rows.where("id % 100 = 0"), rows, 5)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("sim", 5).alias("sim"))


@query("SELECT vec_id AS query_id, CAST(5 AS BIGINT) AS n, TRUE AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by inverted lists over every row; all queries together find 0.9 of the exact answers at least."""
    rows = nearest.units(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = nearest.build(rows, sources.shared_path(spark, "index"))
    queries = rows.where("id % 100 = 0")
    right = nearest.exact(queries, rows, 5).select("query_id", F.col("id").alias("right_id"))
    found = nearest.search(index, queries, 5)
    both = found.join(right.withColumnRenamed("query_id", "q"), (F.col("query_id") == F.col("q")) & (F.col("id") == F.col("right_id")), "left")
    each = both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("right_id").alias("hits"))
    recall = each.agg((F.sum("hits") >= 0.9 * F.sum("n")).alias("enough"))
    return each.join(F.broadcast(recall)).select("query_id", "n", "enough")


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select(F.from_json("props", "k int").alias("p"))
    return parsed.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, k, v FROM (SELECT p_partkey, 'size' AS k, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part)")
def map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array(F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v")), F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.map_from_entries(entries)).alias("k", "v"))


@query("SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the text itself stays on the map side, its digest is shuffled."""
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return rows.where("n > 1").select("first_id", "n")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = udfs.discounted("l_extendedprice", "l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", net.alias("net"))


@query("SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_mktsegment")
def udaf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate in Arrow batches: partial in each task, merged by Spark."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    parts = rows.mapInArrow(udfs.partial_extremes("c_mktsegment", "c_acctbal"), "c_mktsegment string, lo double, hi double")
    return parts.groupBy("c_mktsegment").agg((F.max("hi") - F.min("lo")).alias("spread"))


@query("SELECT item_id, word, CAST(length(word) AS BIGINT) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM benchmark) WHERE word <> ''")
def udtf_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "benchmark")
    spark.udtf.register("word_lengths", udfs.WordLengths)
    return spark.sql("SELECT item_id, w.word, w.n FROM benchmark, LATERAL word_lengths(text) w")
