"""Grouped, pivoted and top-k summaries of mail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, **keys: Column) -> DataFrame:
    """Number of rows per key expression."""
    return df.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, rows: Column, row_name: str, columns: dict[str, Column]) -> DataFrame:
    """Counts of each condition per row key, zero where none holds: a pivot whose columns are known."""
    return df.groupBy(rows.alias(row_name)).agg(*[F.count_if(c).alias(n) for n, c in columns.items()])


def dense(df: DataFrame, key: str, stop: int, *values: str) -> DataFrame:
    """All keys 0 to stop - 1, missing ones with zero."""
    domain = df.sparkSession.range(stop).select(F.col("id").cast("int").alias(key))
    return domain.join(df, key, "left").na.fill(0, list(values))


def activity(threaded: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Forwards, replies, thread origins and single messages per key, and their total; the `top` largest totals if given (ties by key)."""
    per = threaded.groupBy(key).agg(F.count_if("is_forward").alias("forwards"), F.count_if("is_reply").alias("replies"), F.countDistinct("thread_id").alias("threads"), F.countDistinct("message_id").alias("messages"))
    per = per.select(key, "forwards", "replies", F.greatest(F.col("threads") - F.col("replies") - F.col("forwards"), F.lit(0)).alias("thread_origin_mails"), (F.col("messages") - F.col("threads")).alias("single_messages"))
    per = per.withColumn("total_volume", F.col("forwards") + F.col("replies") + F.col("thread_origin_mails") + F.col("single_messages"))
    return per.orderBy(F.desc("total_volume"), key).limit(top) if top else per


def two_ends(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k smallest and k largest rows."""
    return df.orderBy(F.desc(by), key).limit(k).unionByName(df.orderBy(by, key).limit(k)).distinct()


def clipped_histogram(df: DataFrame, value: str, share: float, bins: int) -> DataFrame:
    """Counts per equal-width bin of the values clipped at a quantile (linear interpolation); bins run from the minimum."""
    limit = df.agg(F.percentile(value, F.lit(share)).alias("high"), F.min(value).alias("low"))
    x = df.crossJoin(F.broadcast(limit)).select(F.least(F.col(value), F.col("high")).alias("v"), "low", "high")  # one row: the limits
    bucket = F.least(F.floor((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)) * bins), F.lit(bins - 1))
    return x.filter("v is not null").groupBy(F.coalesce(bucket, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def feature_summary(df: DataFrame, label: str, features: list[str], digits: int = 3) -> DataFrame:
    """Mean, median and sample deviation of each feature per label."""
    aggregates = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))]
    out = df.groupBy(label).agg(*aggregates)
    return out.select(label, *[F.bround(c, digits).alias(c) for c in out.columns if c != label])


def quartiles(df: DataFrame, label: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(label).agg(q.alias("q")).select(label, *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])


def top_per_group(df: DataFrame, group: str, k: int, key: str, *by: str) -> DataFrame:
    """The k rows of each group with the largest `by` (ties by key), and their rank; bounded buffers of k rows are combined before the shuffle."""
    order = F.struct(*[(-F.col(b)).alias(f"_{i}") for i, b in enumerate(by)], F.col(key).alias("_key"))
    rows = df.select(group, order.alias("o"), F.struct(*[c for c in df.columns if c != group]).alias("r"))
    # Rows of a salted part first, so that a group with a third of all rows is split.
    part = F.pmod(F.xxhash64("o"), F.lit(64))
    local = rows.withColumn("n", F.row_number().over(Window.partitionBy(group, part).orderBy("o"))).filter(F.col("n") <= k)
    best = local.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("o"))).filter(F.col("rank") <= k)
    return best.select(group, "rank", "r.*")


def multi_folder(mail: DataFrame, keys: list[str], folder: str = "x_folder") -> DataFrame:
    """Adds in_folders: whether the row's key occurs in more than one distinct folder; a key with a null part never does.

    The distinct folders are combined before the shuffle (min and max of the folder name differ if there are two).
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    several = mail.filter(known).groupBy(*keys).agg((F.min(folder) < F.max(folder)).alias("_several")).filter("_several")
    return mail.join(several, keys, "left").withColumn("in_folders", F.coalesce("_several", F.lit(False))).drop("_several")
