"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import queries_a, queries_b, queries_c, queries_d, queries_e
from .shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


def shipped(query: Query) -> Query:
    """The query, with this package sent to the executors first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_substring_dedup": shipped(queries_b.op1_substring_dedup),
    "op2_language_id": shipped(queries_c.op2_language_id),
    "op3_quality_classifier": shipped(queries_c.op3_quality_classifier),
    "op4_benchmark_decontamination": shipped(queries_a.op4_benchmark_decontamination),
    "op5_lm_score": shipped(queries_c.op5_lm_score),
    "op6_quality_rules": shipped(queries_c.op6_quality_rules),
    "op7_sharding": shipped(queries_a.op7_sharding),
    "op8_line_dedup": shipped(queries_d.op8_line_dedup),
    "op9_packing": shipped(queries_c.op9_packing),
    "op10_minhash_near_dedup": shipped(queries_d.op10_minhash_near_dedup),
    "op11_hard_negatives": shipped(queries_e.op11_hard_negatives),
    "op12_vector_dedup": shipped(queries_e.op12_vector_dedup),
    "op13_filter_audit": shipped(queries_e.op13_filter_audit),
}

ORACLES = {
    "op1_substring_dedup": queries_b.OP1_SQL,
    "op4_benchmark_decontamination": queries_a.OP4_SQL,
    "op11_hard_negatives": queries_e.OP11_SQL,
    "op12_vector_dedup": queries_e.OP12_SQL,
    "op13_filter_audit": queries_e.OP13_SQL,
}
