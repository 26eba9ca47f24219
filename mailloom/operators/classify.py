"""Balanced logistic regression, out-of-fold scores, threshold search."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.operators.evaluate import best_threshold
from mailloom.operators.splits import stratified_folds
from mailloom.session import written


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows over twice the rows of the own class."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # two classes
    total = sum(counts.values())
    return df.withColumn("weight", reduce(lambda a, kv: F.when(F.col(label) == kv[0], total / (len(counts) * kv[1])).otherwise(a), counts.items(), F.lit(1.0)))


def fitted(df: DataFrame, features: list[str], label: str = "label", config: EngineConfig = EngineConfig()) -> PipelineModel:
    """L2-penalised logistic regression without scaling; nulls count as 0. The penalty is that of C on the sum of losses."""
    rows = balanced(df.filter(F.col(label).isin(0, 1)).na.fill(0, features), label)
    n = max(rows.count(), 1)
    steps = [VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1 / (config.inverse_regularisation * n), elasticNetParam=0.0, standardization=False, maxIter=config.iterations, tol=config.tolerance)]
    return Pipeline(stages=steps).fit(rows)


def gradient(df: DataFrame, model: PipelineModel, features: list[str], label: str = "label") -> DataFrame:
    """(feature, gradient) of the penalised mean loss at the model's coefficients, and of the intercept (feature "1"): zero at the optimum."""
    rows = scored(balanced(df.filter(F.col(label).isin(0, 1)).na.fill(0, features), label), model, features, "_p")
    fitted_ = model.stages[-1]
    rest = F.col("weight") * (F.col("_p") - F.col(label))
    sums = rows.agg(F.sum("weight").alias("w"), *[F.sum(rest * F.col(c)).alias(c) for c in features], F.sum(rest).alias("1"))
    penalty = {c: float(b) * fitted_.getRegParam() for c, b in zip(features, fitted_.coefficients)} | {"1": 0.0}
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"`{c}`") / F.col("w") + p).alias("gradient")) for c, p in penalty.items()])).alias("g")).select("g.*")


def scored(df: DataFrame, model: PipelineModel, features: list[str], out: str = "proba", fill: float = 0.0) -> DataFrame:
    """Adds P(class 1). Features the table lacks count as `fill`."""
    missing = {c: F.lit(fill) for c in features if c not in df.columns}
    rows = (df.withColumns(missing) if missing else df).na.fill(0, features)
    done = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return done.drop("features", "rawPrediction", "probability", "prediction", *missing)


def out_of_fold(df: DataFrame, features: list[str], key: str, label: str = "label", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Adds fold and cv_proba: each fold's rows scored by the model of the others."""
    rows = written(stratified_folds(df, label, key, config.folds, config.seed), "folds")
    parts = [scored(rows.filter(F.col("fold") == k), fitted(rows.filter(F.col("fold") != k), features, label, config), features, "cv_proba") for k in range(config.folds)]
    return reduce(DataFrame.unionByName, parts)


def tuned_threshold(df: DataFrame, label: str = "label") -> float:
    return best_threshold(df.select(F.col(label).alias("label"), F.col("cv_proba").alias("score")))


def importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, coefficient, importance), and the group before the first underscore."""
    from pyspark.sql import SparkSession

    rows = [(f, float(c), abs(float(c)), f.split("_")[0]) for f, c in zip(features, model.stages[-1].coefficients)]
    return SparkSession.active().createDataFrame(rows, "feature string, coefficient double, importance double, group string")


def group_importance(coefficients: DataFrame) -> DataFrame:
    return coefficients.groupBy("group").agg(F.count("*").alias("n"), F.avg("importance").alias("mean"), F.sum("importance").alias("sum"))
