"""Scores against labels: confusion, curves, thresholds. Tables of (label 0 or 1, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators.ordered import with_previous, with_running


def over(numerator: Column, denominator: Column) -> Column:
    """A ratio, zero where the denominator is."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def predicted(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return df.withColumn("pred", (F.col(score) >= threshold).cast("int"))


def confusion(df: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn of pred against label."""
    cell = lambda p, y: F.count_if((F.col("pred") == p) & (F.col("label") == y))
    cells = [cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn")]
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def rates(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and f1 to tp, fp, fn, tn; zero where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"accuracy": over(tp + tn, tp + fp + fn + tn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn)})


def per_class(df: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class."""
    return (
        df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "label", "pred").groupBy("class")
        .agg(F.count_if((F.col("label") == F.col("class")) & (F.col("pred") == F.col("class"))).alias("tp"), F.count_if((F.col("label") != F.col("class")) & (F.col("pred") == F.col("class"))).alias("fp"), F.count_if((F.col("label") == F.col("class")) & (F.col("pred") != F.col("class"))).alias("fn"))
        .select("class", over(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), over(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))
    )


def cumulative(df: DataFrame) -> DataFrame:
    """(score, tp, fp, p, n): hits and false alarms at or above each distinct score, by range-partitioned running sums, and the totals."""
    per = df.filter("score is not null and label in (0, 1)").groupBy("score").agg(F.sum("label").cast("long").alias("_p"), F.sum(1 - F.col("label")).cast("long").alias("_n"))
    running = with_running(per, {"tp": "_p", "fp": "_n"}, F.desc("score"))
    totals = per.agg(F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    return running.crossJoin(F.broadcast(totals)).select("score", "tp", "fp", "p", "n")  # one row of totals


def roc_points(df: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, and the origin at a null threshold."""
    points = cumulative(df).select(F.col("score").alias("threshold"), over(F.col("fp"), F.col("n")).alias("fpr"), over(F.col("tp"), F.col("p")).alias("tpr"))
    return points.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def roc_corners(df: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) of roc_points() without those on a straight line between their neighbours; the first and the last score stay."""
    c = cumulative(df).withColumns({"_k": -F.col("score"), "_at": F.struct("tp", "fp")})
    c = with_previous(with_previous(c, "_at", "_was", "_k"), "_at", "_next", "score")
    bent = [F.col(f"_was.{x}") + F.col(f"_next.{x}") != 2 * F.col(x) for x in ("tp", "fp")]
    kept = c.filter(F.col("_was").isNull() | F.col("_next").isNull() | bent[0] | bent[1])
    points = kept.select(F.col("score").alias("threshold"), over(F.col("fp"), F.col("n")).alias("fpr"), over(F.col("tp"), F.col("p")).alias("tpr"))
    return points.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def auc(df: DataFrame) -> DataFrame:
    """(auc_roc): the trapezoid area; zero with a single class."""
    c = cumulative(df).withColumn("_k", -F.col("score"))
    steps = with_previous(c.withColumn("_at", F.struct("tp", "fp")), "_at", "_was", "_k")
    area = (F.col("fp") - F.coalesce(F.col("_was.fp"), F.lit(0))) * (F.col("tp") + F.coalesce(F.col("_was.tp"), F.lit(0))) / 2.0
    total = steps.agg(F.sum(area).alias("a"), F.first("p").alias("p"), F.first("n").alias("n"))
    return total.select(F.coalesce(F.when(F.col("p") * F.col("n") > 0, F.col("a") / (F.col("p") * F.col("n"))), F.lit(0.0)).alias("auc_roc"))


def pr_points(df: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1) at each distinct score."""
    c = cumulative(df)
    p, r = over(F.col("tp"), F.col("tp") + F.col("fp")), over(F.col("tp"), F.col("p"))
    return c.select(F.col("score").alias("threshold"), p.alias("precision"), r.alias("recall"), over(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")).alias("f1"))


def average_precision(df: DataFrame) -> DataFrame:
    """(average_precision): sum of precision times the gain in recall."""
    c = with_previous(cumulative(df).withColumn("_k", -F.col("score")), "tp", "_was", "_k")
    gain = (F.col("tp") - F.coalesce("_was", F.lit(0))) / F.nullif(F.col("p"), F.lit(0))
    return c.agg(F.coalesce(F.sum(gain * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("average_precision"))


def threshold_sweep(df: DataFrame, low: int = 10, high: int = 90) -> DataFrame:
    """(threshold, precision, recall, f1) of the cut-offs low/100 to high/100, in one pass: each score is counted at the highest cut-off it reaches, then sums run over the cut-offs."""
    from pyspark.sql import Window

    rows = df.filter("score is not null and label in (0, 1)")
    # The highest cut-off k / 100 that the score reaches, exact at the cut-offs themselves.
    guess = F.floor(F.col("score") * 100).cast("int")
    step = F.greatest(F.lit(low - 1), F.least(F.lit(high), F.when(F.col("score") >= (guess + 1) / F.lit(100.0), guess + 1).when(F.col("score") < guess / F.lit(100.0), guess - 1).otherwise(guess)))
    counts = rows.groupBy(step.alias("k")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    every = df.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").na.fill(0)
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # one row per cut-off
    sums = every.select("k", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(Window.partitionBy()).alias("all")).filter(F.col("k") >= low)
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("all")
    return sums.select((F.col("k") / 100.0).alias("threshold"), over(tp, tp + fp).alias("precision"), over(tp, p).alias("recall"), over(2 * tp, tp + fp + p).alias("f1"))


def best_threshold(df: DataFrame) -> float:
    """The lowest cut-off of the largest f1."""
    row = threshold_sweep(df).orderBy(F.desc("f1"), "threshold").first()
    return float(row["threshold"]) if row else 0.5


def metric_row(df: DataFrame, name: str) -> DataFrame:
    """Accuracy, precision, recall, f1, auc and positive rates of one scored set, as one row."""
    rows = rates(confusion(df)).select(F.lit(name).alias("split"), "accuracy", "precision", "recall", "f1")
    share = df.agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("positive_rate"), F.avg(F.col("pred").cast("double")).alias("predicted_rate"))
    return rows.crossJoin(F.broadcast(share)).crossJoin(F.broadcast(auc(df)))  # single rows
