"""Order-dependent operators over a whole table without a single-partition window.

The table is range-partitioned by its order and written once; each range works by itself, and what crosses
ranges (the row before, the sums before) is one small row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.session import written


def ranged(df: DataFrame, *order: Column, partitions: int | None = None) -> DataFrame:
    """The rows with _range, ascending along the order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def with_previous(df: DataFrame, value: str, out: str, *order: str) -> DataFrame:
    """Adds `out`: the value of the row before in the order (which should be unique); null for the first."""
    rows = ranged(df, *map(F.col, order))
    within = Window.partitionBy("_range").orderBy(*order)
    last = rows.groupBy("_range").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("last"))
    carried = last.withColumn("carried", F.lag("last").over(Window.orderBy("_range"))).select("_range", F.struct("carried.v").alias("carried"))  # one row per range
    first = F.row_number().over(within) == 1
    return rows.withColumns({"_before": F.lag(value).over(within), "_first": first}).join(F.broadcast(carried), "_range").withColumn(out, F.when(F.col("_first"), F.col("carried.v")).otherwise(F.col("_before"))).drop("_before", "_first", "carried", "_range")


def with_running(df: DataFrame, sums: dict[str, str], *order: Column) -> DataFrame:
    """Adds running sums (inclusive) of columns along a unique order: out name -> column."""
    rows = ranged(df, *order)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in sums])  # one row per range
    out = rows.withColumns({o: F.sum(c).over(within) for o, c in sums.items()}).join(F.broadcast(offsets), "_range")
    return out.withColumns({o: F.col(o) + F.col(f"_o_{o}") for o in sums}).drop("_range", *[f"_o_{o}" for o in sums])


def with_position(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """Adds the row's position from 1 in the order."""
    return with_running(df.withColumn("_one", F.lit(1).cast("long")), {out: "_one"}, *order).drop("_one")


def with_neighbours(df: DataFrame, group: str, value: str, previous: str, sequence: str | None, *order: str) -> DataFrame:
    """Adds the value of the row before within its group, and the row's number from 1 in it; null groups are one group.

    Rows are range-partitioned by group and order together, so a group with a third of all rows is spread over
    many ranges. What crosses ranges is one row per range: its last row, and how many rows of its first group
    stand in earlier ranges. Give it narrow rows: they are written once. The order must be unique in a group.
    """
    key = F.coalesce(F.col(group).cast("string"), F.lit("\0"))
    rows = ranged(df.withColumn("_g", key), F.col("_g"), *map(F.col, order))
    within = Window.partitionBy("_range").orderBy("_g", *order)
    pair = F.struct("_g", F.col(value).alias("v"))
    ends = rows.groupBy("_range").agg(F.max_by(pair, F.struct("_g", *order)).alias("last"), F.min("_g").alias("first"))
    carried = ends.select("_range", F.lag("last").over(Window.orderBy("_range")).alias("_carried"))  # one row per range
    # Only a range's first group can have begun before it.
    held = rows.join(F.broadcast(ends.select(F.col("first").alias("_g")).distinct()), "_g").groupBy("_g", "_range").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select("_range", "_g", earlier.alias("_offset")).filter("_offset > 0")
    out = rows.withColumns({"_before": F.lag(pair).over(within), "_number": F.row_number().over(Window.partitionBy("_range", "_g").orderBy(*order))})
    out = out.join(F.broadcast(carried), "_range").join(F.broadcast(offsets), ["_range", "_g"], "left")
    before = F.coalesce("_before", "_carried")
    out = out.withColumn(previous, F.when(before["_g"] == F.col("_g"), before["v"]))
    if sequence:
        out = out.withColumn(sequence, (F.col("_number") + F.coalesce("_offset", F.lit(0))).cast("int"))
    return out.drop("_g", "_range", "_before", "_number", "_carried", "_offset")


def keep_first(df: DataFrame, keys: list[str], *order: str, nulls_match: bool = True) -> DataFrame:
    """One row per key: the first in the order. Combined before the shuffle, so no key is a hot group."""
    if not nulls_match:
        df = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)
