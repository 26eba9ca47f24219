"""Queries of problem 6: personal information."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession

from mailloom.llm.personal import collected_people, mentions, rewritten
from mailloom.session import read_table



def secret(spark: SparkSession) -> bytes:
    """The key of the session (mailloom.surrogate.key) or the environment (SURROGATE_KEY); without either a new random one, which nobody can apply again."""
    return (spark.conf.get("mailloom.surrogate.key", None) or os.environ.get("SURROGATE_KEY") or secrets.token_hex(32)).encode()


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    emails = read_table(spark, d, "emails")
    return emails, collected_people(emails, read_table(spark, d, "mailboxes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mentions(*_tables(spark, d))


def p6_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return rewritten(*_tables(spark, d))


def p6_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return rewritten(*_tables(spark, d), secret(spark))


QUERIES = {"p6_found": p6_found, "p6_placeholders": p6_placeholders, "p6_surrogates": p6_surrogates}
ORACLE: dict[str, str] = {}
