"""Queries of problem 10: reading bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm.reading import reading_bands, trained
from mailloom.session import read_table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents")
    return reading_bands(documents, trained(documents, read_table(spark, d, "reading_labels")))


def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy by source, of folds that share no source."""
    model = trained(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels"))
    rows = spark.createDataFrame(model.nested if model else [], "source string, band int, predicted int")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("band") == F.col("predicted")).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.abs(F.col("band") - F.col("predicted"))), 6).alias("mean_error"))


QUERIES = {"p10_found": p10_found, "p10_validation": p10_validation}
ORACLE: dict[str, str] = {}
