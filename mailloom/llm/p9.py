"""Queries of problem 9: documents in containers of fixed token capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm.packing import packed
from mailloom.llm.tokens import token_counts
from mailloom.session import read_table, written


def _packed(spark: SparkSession, d: str) -> DataFrame:
    capacities = [(r[0], r[1]) for r in read_table(spark, d, "pack_capacity").select("container", "capacity_tokens").dropna().dropDuplicates(["container"]).collect()]  # fixed: 3 rows
    return packed(written(token_counts(read_table(spark, d, "documents")), "counts"), sorted(capacities))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: its bins, the tokens in them, and the share of room used."""
    room = read_table(spark, d, "pack_capacity").select("container", "capacity_tokens")
    per = _packed(spark, d).groupBy("container").agg((F.max("bin_no") + 1).alias("n_bins"), F.sum("tokens").alias("n_tokens"))
    return per.join(F.broadcast(room), "container").select("container", "n_bins", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("fill"))


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: documents held, and how often a rule is broken: bins over capacity, documents cut though they fit, pieces beyond those a document needs, bin numbers without a bin."""
    room = read_table(spark, d, "pack_capacity").select("container", "capacity_tokens")
    rows = written(_packed(spark, d), "packed")
    held = rows.groupBy("container", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces")).join(F.broadcast(room), "container")
    needed = F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), F.lit(1))
    documents = held.groupBy("container").agg(F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("n_cut"), F.sum(F.col("pieces") - needed).alias("n_spare_pieces"))
    load = rows.groupBy("container", "bin_no").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(room), "container")
    bins = load.groupBy("container").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("n_overfull"), (F.max("bin_no") + 1 - F.count("*")).alias("n_missing_bins"))
    return documents.join(bins, "container")


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill, "p9_rules": p9_rules}
ORACLE: dict[str, str] = {
    "p9_rules": "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0::BIGINT AS n_cut, 0::BIGINT AS n_spare_pieces, 0::BIGINT AS n_overfull, 0::BIGINT AS n_missing_bins FROM pack_capacity",
}
