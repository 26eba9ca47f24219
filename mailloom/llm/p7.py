"""Queries of problem 7: newly written text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailloom.llm.newtext import new_texts, old_lines
from mailloom.session import read_table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return old_lines(read_table(spark, d, "emails"))


def p7_new_text(spark: SparkSession, d: str) -> DataFrame:
    return new_texts(read_table(spark, d, "emails"))


QUERIES = {"p7_found": p7_found, "p7_new_text": p7_new_text}
ORACLE: dict[str, str] = {}
