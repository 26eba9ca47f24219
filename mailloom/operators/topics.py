"""Topics of vectors: principal components, bisecting k-means, noise beyond a distance, names by class-based term weights."""

from __future__ import annotations

import json
import logging
from itertools import product
from operator import add

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, BisectingKMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators.analytics import top_per_group
from mailloom.session import Documents

log = logging.getLogger(__name__)


class TopicModel:
    """fit, then assign: topic -1 is noise, its probability 0 to 1 falls with the distance to the centre."""

    def __init__(self, topics: int = 10, components: int = 5, noise: float = 0.98, seed: int = 42, tries: int = 3) -> None:
        self.topics, self.components, self.noise, self.seed, self.tries = topics, components, noise, seed, tries
        self.names: dict[int, str] = {}  # by topic, saved with the model

    def fit(self, vectors: DataFrame) -> TopicModel:
        """(id, embedding). Relaxes the noise cut-off while every row is noise; raises if none is left that isn't."""
        rows = vectors.filter("embedding is not null").select("id", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("v"))
        width = rows.select(F.size(vector_to_array("v")).alias("w")).first()
        if width is None:
            raise ValueError("no vectors to fit topics on")
        self.reduce = PCA(k=min(self.components, width["w"]), inputCol="v", outputCol="x").fit(rows)
        self.cluster = BisectingKMeans(k=self.topics, seed=self.seed, featuresCol="x", predictionCol="topic").fit(self.reduce.transform(rows))
        self.centres = [np.asarray(c) for c in self.cluster.clusterCenters()]
        for attempt in range(self.tries):
            share = 1 - (1 - self.noise) / (attempt + 1)
            cut = self._placed(vectors).agg(F.percentile_approx("distance", share, 10_000).alias("c")).first()["c"]
            self.cut = float(cut) if cut is not None else 0.0
            if not self.assign(vectors).filter("topic >= 0").isEmpty():
                return self
        raise ValueError("every row is noise")

    def _placed(self, vectors: DataFrame) -> DataFrame:
        rows = vectors.select("id", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("v")).filter("v is not null")
        placed = self.cluster.transform(self.reduce.transform(rows))
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centres])
        gaps = F.zip_with(vector_to_array("x"), F.get(centres, F.col("topic")), lambda a, b: (a - b) * (a - b))
        return placed.select("id", "topic", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v)).alias("distance"))

    def assign(self, vectors: DataFrame) -> DataFrame:
        """(id, topic, topic_probability)."""
        return self._placed(vectors).select("id", F.when(F.col("distance") <= self.cut, F.col("topic")).otherwise(-1).alias("topic"), F.exp(-F.col("distance") / max(self.cut, 1e-9)).alias("topic_probability"))

    def save(self, folder: str) -> None:
        self.reduce.write().overwrite().save(f"{folder}/components")
        self.cluster.write().overwrite().save(f"{folder}/clusters")
        Documents(SparkSession.active(), folder).write("topics.json", json.dumps({"cut": self.cut, "centres": [c.tolist() for c in self.centres], "topics": self.topics, "seed": self.seed, "names": self.names}))

    @classmethod
    def load(cls, folder: str) -> TopicModel:
        info = json.loads(Documents(SparkSession.active(), folder).read("topics.json"))
        model = cls(info["topics"], seed=info["seed"])
        model.reduce, model.cluster = PCAModel.load(f"{folder}/components"), BisectingKMeansModel.load(f"{folder}/clusters")
        model.cut, model.centres = info["cut"], [np.asarray(c) for c in info["centres"]]
        model.names = {int(k): v for k, v in info.get("names", {}).items()}
        return model


CELLS = 50_000  # dense cells that the driver may join to topics


class DensityTopics:
    """Topics of any shape and number: connected dense cells of a grid over the principal components; rows of other cells are noise.

    A cell is dense with at least `least` rows; dense cells that touch, at corners too, are one topic, numbered by size. While no
    cell is dense the cells grow (`growth` times, `tries` times in all); if none is dense then, fit raises ValueError.
    Rows are counted per cell by aggregates combined before the shuffle; only dense cells, of which more than CELLS
    are refused, come to the driver. The probability is a cell's share of its topic's largest count.
    """

    def __init__(self, components: int = 5, least: int = 5, cell: float | None = None, growth: float = 2.0, tries: int = 3) -> None:
        self.components, self.least, self.cell, self.growth, self.tries = components, least, cell, growth, tries

    def _rows(self, vectors: DataFrame) -> DataFrame:
        return vectors.filter("embedding is not null").select("id", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("v"))

    def _celled(self, vectors: DataFrame) -> DataFrame:
        reduced = self.reduce.transform(self._rows(vectors)).select("id", vector_to_array("x").alias("x"))
        return reduced.select("id", F.transform("x", lambda v: F.floor(v / self.cell)).alias("cell"))

    def fit(self, vectors: DataFrame) -> DensityTopics:
        rows = self._rows(vectors)
        first = rows.select(F.size(vector_to_array("v")).alias("w")).first()
        if first is None:
            raise ValueError("no vectors to fit topics on")
        self.reduce = PCA(k=min(self.components, first["w"]), inputCol="v", outputCol="x").fit(rows)
        if self.cell is None:
            x = vector_to_array("x")
            spread = self.reduce.transform(rows).select(*[F.stddev_pop(x[i]).alias(str(i)) for i in range(self.reduce.getK())]).first()
            self.cell = max(float(np.mean(spread)) / 2, 1e-9)
        for attempt in range(self.tries):
            self.cell *= self.growth if attempt else 1.0
            dense = self._celled(vectors).groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= self.least).limit(CELLS + 1).collect()
            if len(dense) > CELLS:
                raise ValueError(f"more than {CELLS} dense cells: fewer components or larger cells are needed")
            if dense:
                self.cells = self._joined({tuple(r["cell"]): r["n"] for r in dense})
                return self
        raise ValueError("every row is noise")

    @staticmethod
    def _joined(dense: dict[tuple[int, ...], int]) -> list[tuple[list[int], int, float]]:
        """(cell, topic, probability) of the dense cells, by a walk over touching cells."""
        groups, seen = [], set()
        steps = [s for s in product((-1, 0, 1), repeat=len(next(iter(dense)))) if any(s)]
        for start in sorted(dense):
            if start in seen:
                continue
            seen.add(start)
            group, todo = [], [start]
            while todo:
                cell = todo.pop()
                group.append(cell)
                for step in steps:
                    other = tuple(map(add, cell, step))
                    if other in dense and other not in seen:
                        seen.add(other)
                        todo.append(other)
            groups.append(group)
        groups.sort(key=lambda g: (-sum(dense[c] for c in g), g[0]))
        return [(list(c), t, dense[c] / max(dense[x] for x in g)) for t, g in enumerate(groups) for c in g]

    def assign(self, vectors: DataFrame) -> DataFrame:
        """(id, topic, topic_probability) of the rows with a vector; -1 and 0 outside dense cells."""
        cells = vectors.sparkSession.createDataFrame(self.cells, "cell array<long>, topic int, topic_probability double")
        return self._celled(vectors).join(F.broadcast(cells), "cell", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce("topic_probability", F.lit(0.0)).alias("topic_probability"))  # CELLS rows at most

    def save(self, folder: str) -> None:
        self.reduce.write().overwrite().save(f"{folder}/components")
        Documents(SparkSession.active(), folder).write("density.json", json.dumps({"cell": self.cell, "cells": self.cells}))

    @classmethod
    def load(cls, folder: str) -> DensityTopics:
        info = json.loads(Documents(SparkSession.active(), folder).read("density.json"))
        model = cls(cell=info["cell"])
        model.reduce, model.cells = PCAModel.load(f"{folder}/components"), [tuple(c) for c in info["cells"]]
        return model


def topic_features(rows: DataFrame, model: TopicModel | DensityTopics | None, vectors: DataFrame) -> DataFrame:
    """(id) with topic and topic_probability; rows without a vector, or a missing model, get -1 and 0."""
    if model is None:
        log.warning("no topic model: all rows are noise")
        return rows.withColumns({"topic": F.lit(-1), "topic_probability": F.lit(0.0)})
    return rows.join(model.assign(vectors), "id", "left").na.fill({"topic": -1, "topic_probability": 0.0})


def topic_names(docs: DataFrame, top: int = 4) -> DataFrame:
    """(topic, name) of (topic, text): the terms of largest class-based weight, joined by underscores; noise is not named."""
    words = docs.filter("topic >= 0").select("topic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("w"))
    tf = words.groupBy("topic", "w").agg(F.count("*").alias("tf"))
    per = tf.groupBy("w").agg(F.sum("tf").alias("f"))
    mean = tf.groupBy("topic").agg(F.sum("tf").alias("s")).agg(F.avg("s").alias("a"))
    scored = tf.join(per, "w").crossJoin(F.broadcast(mean)).withColumn("score", F.col("tf") * F.log(1 + F.col("a") / F.col("f")))  # one row: the mean
    best = top_per_group(scored.select("topic", "w", "score"), "topic", top, "w", "score").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("t"))  # `top` terms each
    return best.select("topic", F.array_join(F.transform("t", lambda x: x["w"]), "_").alias("name"))


def named(df: DataFrame, names: DataFrame) -> DataFrame:
    """Adds the topic's name; noise where there is none."""
    return df.join(names, "topic", "left").withColumn("name", F.coalesce("name", F.lit("noise")))


def topic_summary(df: DataFrame) -> DataFrame:
    """(topic, name, n and means of label, pred, proba and topic_probability)."""
    return df.groupBy("topic", "name").agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in ("label", "pred", "proba", "topic_probability")])
