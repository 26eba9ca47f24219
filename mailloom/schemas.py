"""Record schemas and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))])


EMAIL = _struct(
    "id long, message_id string, date timestamp, sender string, to_list array<string>, cc_list array<string>, bcc_list array<string>, subject string, body string, "
    "x_from string, x_to string, x_cc string, x_bcc string, x_folder string, x_origin string, x_filename string, source_file string"
)
THREAD = T.StructType(EMAIL.fields + _struct("thread_id string, parent_id string, sequence int, is_forward boolean, is_reply boolean, sender_domain string, recipient_domain array<string>").fields)
META = _struct(
    "message_id string, response_time long, time_since_last_email long, sent_hour int, sent_weekday int, is_after_hours boolean, is_weekend boolean, "
    "n_recipient int, n_recipient_domains int, n_words int, n_sentences int, is_internal boolean, is_external boolean"
)
SIMILARITY = [f"{n}_similarity" for n in ("max", "mean", "std", "top_k_mean", "top_k_std", "top_k_pos", "top_k_neg", "gap")]


def require(df: DataFrame, *columns: str) -> None:
    """Raises ValueError if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing required columns: {missing}")


def conform(df: DataFrame, schema: T.StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """The schema's columns in its order: aliases renamed, missing ones null, unknown ones dropped, values cast (null where a cast fails)."""
    for old, new in (aliases or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    have = set(df.columns)
    return df.select([(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations) in one pass; a rule that is null counts as violated."""
    counted = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "n_violations"))


def aligned(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly these columns in this order; a missing one is filled."""
    return df.select([F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def same_features(df: DataFrame, columns: list[str]) -> bool:
    """Whether a feature table has exactly these columns in this order."""
    return df.columns == columns
