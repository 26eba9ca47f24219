"""File sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailloom.schemas import EMAIL, conform
from mailloom.session import Documents, written


def records(spark: SparkSession, path: str, schema: StructType = EMAIL, strict: bool = True) -> DataFrame:
    """JSON lines by schema: strict raises on a malformed record, else it comes out in _corrupt_record. `from` is read as sender."""
    wide = StructType([*schema.fields, *StructType().add("from", "string").fields, *([] if strict else StructType().add("_corrupt_record", "string").fields)])
    raw = spark.read.schema(wide).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    raw = raw.withColumn("sender", F.coalesce("sender", "from")).drop("from")
    return raw if not strict else conform(raw, schema)


def table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A parquet file or folder; only the columns named are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def headed_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def plain_lines(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Headerless CSV, every field text, no text read as null."""
    df = spark.read.option("header", False).option("nullValue", "\0").option("emptyValue", "").csv(path)
    return df.toDF(*names) if names else df


def lexicon_folder(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder with the file's stem as lexicon; empty files are skipped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("pathGlobFilter", "*.csv").csv(path).select("*", F.col("_metadata.file_name").alias("_file"))
    # A file is read whole by one task, so its rows come in their order; files are ordered by name.
    placed = raw.withColumn("_row", F.monotonically_increasing_id())
    row = F.row_number().over(Window.partitionBy("_file").orderBy("_row"))  # a file is a small dictionary
    return placed.withColumn("lexicon", F.regexp_extract("_file", r"^(.*)\.csv$", 1)).withColumn("_ordinal", F.dense_rank().over(Window.orderBy("_file")) * (1 << 32) + row).drop("_file", "_row")


def existing(path: str) -> str:
    """The path, or its parquet sibling if only that exists."""
    folder, _, name = path.rpartition("/")
    here, other = Documents(SparkSession.active(), folder), f"{name.rpartition('.')[0] or name}.parquet"
    return path if here.exists(name) or not here.exists(other) else f"{folder}/{other}"


def save(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, which an empty table has too."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def save_document(value: dict, path: str) -> None:
    """A metrics or snapshot document."""
    folder, _, name = path.rpartition("/")
    Documents(SparkSession.active(), folder).write(name, json.dumps(value, indent=2, default=str))


def resumed(spark: SparkSession, incoming: DataFrame, path: str, key: str = "id") -> int:
    """Appends only rows whose key the folder doesn't hold yet; returns how many. An empty batch writes nothing."""
    folder, _, name = path.rpartition("/")
    if Documents(spark, folder).exists(name):
        known = spark.read.schema(incoming.schema).parquet(path).select(key)
        incoming = incoming.join(known, key, "left_anti")
    fresh = written(incoming, "chunk")
    n = fresh.count()
    if n:
        fresh.write.mode("append").option("compression", "zstd").parquet(path)
    return n
