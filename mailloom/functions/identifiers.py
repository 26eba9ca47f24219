"""Message identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_identifier(message_id: Column) -> Column:
    """message_id without surrounding blanks and angle brackets; letter case counts; null, empty or blank: null."""
    bare = F.regexp_replace(message_id, r"(?U)^[\s<]+|[\s>]+$", "")
    return F.when(bare != "", bare)
