"""Query op1 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substring_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup.dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 49), lambda i: {'i': i, 'h': md5(array_to_string(w[i : i + 49], ' '))})) AS u
  FROM d WHERE len(w) >= 50
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, u.i AS i, min(doc_id) OVER (PARTITION BY u.h) AS m FROM g) WHERE m < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS p FROM r) GROUP BY doc_id
), x AS (
  SELECT d.doc_id, w, ps FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT a.doc_id, a.word, a.i FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0) a
        ANTI JOIN (SELECT doc_id, unnest(ps) AS i FROM gone) b ON a.doc_id = b.doc_id AND a.i = b.i)
  GROUP BY doc_id
)
SELECT x.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM x LEFT JOIN k ON x.doc_id = k.doc_id
"""
