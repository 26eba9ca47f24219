"""Queries of problem 2: the most similar vectors of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm.vectors import nearest
from mailloom.session import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(read_table(spark, d, "mail_vectors"))
    return near.select(F.least("query_id", "vec_id").alias("vec_id_a"), F.greatest("query_id", "vec_id").alias("vec_id_b")).distinct()


def p2_similarity_features(spark: SparkSession, d: str) -> DataFrame:
    """max_similarity and top_k_mean_similarity of every vector that takes part."""
    near = nearest(read_table(spark, d, "mail_vectors"))
    return near.groupBy(F.col("query_id").alias("vec_id")).agg(F.round(F.max("similarity"), 4).alias("max_similarity"), F.round(F.avg("similarity"), 4).alias("top_k_mean_similarity"))


QUERIES = {"p2_found": p2_found, "p2_similarity_features": p2_similarity_features}
_UNIT = "WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM mail_vectors WHERE len(embedding) = 64), u AS (SELECT * FROM v WHERE list_sum(list_transform(e::DOUBLE[], lambda x: x * x)) > 0)"
_TOP = f"{_UNIT}, s AS (SELECT a.vec_id AS q, b.vec_id AS r, array_cosine_similarity(a.e, b.e) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS n FROM s)"
ORACLE = {
    "p2_found": f"{_TOP} SELECT DISTINCT least(q, r) AS vec_id_a, greatest(q, r) AS vec_id_b FROM t WHERE n <= 10",
    "p2_similarity_features": f"{_TOP} SELECT q AS vec_id, round(max(sim), 4) AS max_similarity, round(avg(sim), 4) AS top_k_mean_similarity FROM t WHERE n <= 10 GROUP BY q",
}
