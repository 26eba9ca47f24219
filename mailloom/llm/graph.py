"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.session import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): root is the smallest node of the component. Takes a logarithmic number of rounds.

    Each round hangs every neighbour on the smallest node around, first the larger, then the smaller
    neighbours; the tables are cut in the shared folder, and a round that changes no edge ends it.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = written(now, "edges")
    while True:
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        after = written(small, "edges")
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
