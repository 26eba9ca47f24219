"""Queries of problem 8: token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailloom.llm.tokens import decoded, encoded
from mailloom.session import read_table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(read_table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): every text as its ids give it back; null ones are empty."""
    return decoded(p8_ids(spark, d))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
ORACLE: dict[str, str] = {"p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
