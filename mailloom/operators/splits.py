"""Deterministic splits: digests instead of a generator, so the result depends on neither partitions nor order, and other engines can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "\0"  # stands for a null stratum


def _digest(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")), 256)


def numbered(df: DataFrame, by: Column, key: str, seed: int = 42, name: str = "_number") -> DataFrame:
    """Adds each row's number from 0 within `by` in the order of (digest of key and seed, key), and _rows, the number of rows there.

    The leading two digits of the digest are parts of a stratum, numbered apart and moved by the counts of the parts
    before, so a stratum with most of the rows is no hot group.
    """
    rows = df.withColumns({"_by": F.coalesce(by.cast("string"), F.lit(NONE)), "_digest": _digest(F.col(key), seed)}).withColumn("_part", F.substring("_digest", 1, 2))
    counts = rows.groupBy("_by", "_part").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("_by").orderBy("_part")  # at most 256 rows a stratum
    places = counts.select("_by", "_part", (F.sum("_n").over(inside) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_by")).alias("_rows"))
    place = F.row_number().over(Window.partitionBy("_by", "_part").orderBy("_digest", key)) - 1
    return rows.withColumn("_place", place).join(places, ["_by", "_part"]).withColumn(name, F.col("_before") + F.col("_place")).drop("_by", "_digest", "_part", "_before", "_place")


def thread_split(df: DataFrame, share: float = 0.2, seed: int = 42, thread: str = "thread_id", gold: str | None = None, strict: bool = False) -> DataFrame:
    """Adds split, train or test: a `share` of the threads, rounded up, is test, and all rows of a thread fall on one side.

    With `gold`, threads with and without a gold label are split apart, so that both sides hold their share of labels.
    strict splits the rows with gold labels and the rest independently, so that a thread can lie on both sides. Rows
    without a thread count as threads of their own name "". An empty table gives no rows.
    """
    has = F.col(gold).isNotNull() if gold else F.lit(False)
    marked = df.withColumns({"_thread": F.coalesce(F.col(thread).cast("string"), F.lit("")), "_has": has})
    groups = ["_thread", "_has"] if strict else ["_thread"]
    threads = marked.groupBy("_thread", *(["_has"] if strict else [])).agg(*([] if strict else [F.max("_has").alias("_has")]), F.count("*").alias("_mails"))
    chosen = numbered(threads, F.col("_has"), "_thread", seed).select(*groups, F.when(F.col("_number") < F.ceil(F.col("_rows") * F.lit(share) - 1e-9), "test").otherwise("train").alias("split"))
    return marked.join(chosen, groups).drop("_thread", "_has")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 4, seed: int = 42) -> DataFrame:
    """Adds fold 0 to folds - 1: the folds of every label differ by one row at most. Null labels are a stratum of their own."""
    return numbered(df, F.col(label), key, seed).withColumn("fold", F.pmod("_number", F.lit(folds)).cast("int")).drop("_number", "_rows")
