"""The end-to-end flows: build a dataset, train, evaluate, monitor, score. Models and tables live in one folder."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.functions import text as X
from mailloom.operators import classify as C
from mailloom.operators import evaluate as E
from mailloom.operators import knn as K
from mailloom.operators import mail as M
from mailloom.operators import monitor
from mailloom.operators.deliveries import exactly_once
from mailloom.operators.lexicon import Embed, embedded, grown, hashed_embedding, seed_lexicon
from mailloom.operators.splits import thread_split
from mailloom.operators.topics import DensityTopics, TopicModel, topic_features
from mailloom.operators.weak import LabelModel, final_label, labelling_functions, searched, silver, voted
from mailloom.schemas import SIMILARITY
from mailloom.session import Documents, written
from mailloom.sources.files import save, save_csv, save_document

log = logging.getLogger(__name__)
META = ["response_time", "time_since_last_email", "sent_hour", "sent_weekday", "is_after_hours", "is_weekend", "n_recipient", "n_recipient_domains", "n_words", "n_sentences", "is_internal", "is_external"]


@dataclass
class Models:
    """What training leaves behind."""

    folder: str
    label_model: LabelModel
    classifier: PipelineModel
    features: list[str]
    threshold: float
    topics: TopicModel | DensityTopics | None = None

    @classmethod
    def load(cls, folder: str) -> Models:
        """Raises FileNotFoundError if the folder holds no trained models."""
        info = json.loads(Documents(SparkSession.active(), folder).read("model.json"))
        kind = DensityTopics if Documents(SparkSession.active(), f"{folder}/topics").exists("density.json") else TopicModel
        return cls(folder, LabelModel.load(f"{folder}/labels.json"), PipelineModel.load(f"{folder}/classifier"), info["features"], info["threshold"], kind.load(f"{folder}/topics"))


def build_dataset(emails: DataFrame, gold: DataFrame, folder: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Deliveries once, threads, gold labels and a split by thread; written as train.parquet and test.parquet if a folder is given.

    Gold labels are reduced to one per message id (the largest) before the join, so no row is multiplied.
    """
    one = gold.filter("message_id is not null").groupBy("message_id").agg(F.max("gold_labels").alias("gold_labels"))
    mail = M.threads(M.mail_view(exactly_once(emails)))
    out = thread_split(mail.join(one, "message_id", "left"), config.test_share, config.seed)
    if folder:
        out = written(out, "dataset")
        for split in ("train", "test"):
            save(out.filter(F.col("split") == split), f"{folder}/{split}.parquet")
    return out


def features(mail: DataFrame, vectors: DataFrame, reference: DataFrame, labels: DataFrame, topics: TopicModel | DensityTopics | None, config: EngineConfig, in_sample: bool) -> DataFrame:
    """Meta, similarity and topic features and the vector's values, joined by _ordinal, nulls as 0; the vectors are (id, embedding)."""
    meta = M.meta_features(mail, config).drop("message_id").select(F.col("_ordinal").alias("id"), *[F.col(c).cast("double").alias(c) for c in META])
    near = K.in_sample_features(vectors, labels, config.neighbours) if in_sample else K.out_of_sample_features(vectors, reference, labels, config.neighbours)
    width = vectors.select(F.size("embedding").alias("w")).first()
    wide = vectors.select("id", *[F.col("embedding")[i].alias(f"lora_{i}") for i in range(width["w"] if width else 0)])
    out = meta.join(near.select("id", *SIMILARITY), "id", "left").join(topic_features(vectors.select("id"), topics, vectors), "id", "left").join(wide, "id", "left")
    return out.na.fill(0.0).na.fill({"topic": -1})


def cleaned(mail: DataFrame, config: EngineConfig) -> DataFrame:
    subject, body = X.clean_subject(F.col("subject")), X.clean_body(F.col("body"), strict=config.strict_reference)
    return mail.withColumn("_clean", F.substring(F.concat_ws(" ", subject, body), 1, config.text_length))


def with_semantic(mail: DataFrame, vectors: DataFrame, lexicon: DataFrame, embed: Embed) -> DataFrame:
    """Adds semantic: each lexicon's largest similarity to the mail, as the semantic labelling functions read it."""
    terms = embedded(lexicon.select("lexicon", "prototype"), "prototype", embed=embed)
    return mail.join(K.semantic_scores(vectors, terms).withColumnRenamed("id", "_ordinal"), "_ordinal", "left")


def train(mail: DataFrame, folder: str, config: EngineConfig = EngineConfig(), embed: Embed = hashed_embedding, grow: bool = False, reuse: bool = False, topic_model: TopicModel | DensityTopics | None = None) -> tuple[DataFrame, Models]:
    """Lexicons, weak labels, features, out-of-fold scores, threshold and final model; writes dataset.parquet and the models. reuse keeps a saved classifier of the same features; topic_model is how topics are found (default: k-means with noise)."""
    spark = mail.sparkSession
    mail = written(cleaned(mail, config), "train-mail")
    vectors = written(embedded(mail.select(F.col("_ordinal").alias("id"), "_clean"), "_clean", embed=embed).select("id", "embedding"), "train-vectors")
    lexicon = seed_lexicon(spark)
    if grow:
        lexicon = written(grown(lexicon, mail, embed, config.lexicon_neighbours, config.lexicon_similarity, config.phrases), "lexicon")
    mail = written(with_semantic(mail, vectors, lexicon, embed), "semantic-mail")
    label_model = searched(mail, lexicon, "gold_labels", "semantic", config)
    voters = labelling_functions(lexicon, label_model.semantic, "semantic")
    marked = silver(voted(mail, voters), label_model, config.strict_reference)
    marked = written(marked.withColumn("label", F.coalesce(final_label(F.col("gold_labels"), F.col("silver_label")), F.lit(0))), "marked")
    labels = marked.select(F.col("_ordinal").alias("id"), "label")
    topics = (topic_model or TopicModel(seed=config.seed)).fit(vectors)
    table = written(features(mail, vectors, vectors, labels, topics, config, in_sample=True).join(labels, "id"), "features")
    names = [c for c in table.columns if c not in ("id", "label")]
    folds = written(C.out_of_fold(table, names, "id", config=config), "oof")
    threshold = C.tuned_threshold(folds)
    saved = Models.load(folder) if reuse and Documents(spark, folder).exists("model.json") else None
    if saved and saved.features == names:  # a saved model serves only the same features in the same order
        classifier, threshold = saved.classifier, saved.threshold
    else:
        classifier = C.fitted(table, names, config=config)
    done = C.scored(folds, classifier, names).withColumn("pred", (F.col("proba") >= threshold).cast("int")).withColumn("threshold", F.lit(threshold))
    out = marked.drop("label", "votes", "_clean", "semantic").join(done.withColumnRenamed("id", "_ordinal"), "_ordinal")
    save(out, f"{folder}/dataset.parquet")
    save(vectors.join(labels, "id"), f"{folder}/vectors.parquet")
    save(lexicon, f"{folder}/lexicon.parquet")
    label_model.save(f"{folder}/labels.json")
    topics.save(f"{folder}/topics")
    classifier.write().overwrite().save(f"{folder}/classifier")
    save_document({"features": names, "threshold": threshold}, f"{folder}/model.json")
    return spark.read.parquet(f"{folder}/dataset.parquet"), Models(folder, label_model, classifier, names, threshold, topics)


def score(mail: DataFrame, models: Models, config: EngineConfig = EngineConfig(), embed: Embed = hashed_embedding) -> DataFrame:
    """(_ordinal, message_id, urgent, proba, threshold, silver_label, label, topic, topic_probability) of new mail: the same function for a batch, a stream's micro-batch and a single row.

    label is the gold label if the mail has one (column gold_labels, 0 or 1), else the silver one. If the label model or
    its lexicon can't be used, silver labels are 0; without a topic model topics are -1 with probability 0; a model
    that doesn't name its features raises ValueError.
    """
    if not models.features:
        raise ValueError("the model does not name its features")
    spark = mail.sparkSession
    mail = written(cleaned(mail, config), "score-mail")
    vectors = written(embedded(mail.select(F.col("_ordinal").alias("id"), "_clean"), "_clean", embed=embed).select("id", "embedding"), "score-vectors")
    known = spark.read.parquet(f"{models.folder}/vectors.parquet")
    table = features(mail, vectors, known.select("id", "embedding"), known.select("id", "label"), models.topics, config, in_sample=False)
    done = C.scored(table, models.classifier, models.features)
    out = done.select(F.col("id").alias("_ordinal"), (F.col("proba") >= models.threshold).alias("urgent"), "proba", F.lit(models.threshold).alias("threshold"), "topic", "topic_probability")
    gold = F.col("gold_labels") if "gold_labels" in mail.columns else F.lit(None).cast("int")
    marked = silver_labels(mail, vectors, models, embed).withColumn("label", F.coalesce(final_label(gold, F.col("silver_label")), F.lit(0)))
    return marked.select("_ordinal", "message_id", "silver_label", "label").join(out, "_ordinal")


def silver_labels(mail: DataFrame, vectors: DataFrame, models: Models, embed: Embed) -> DataFrame:
    """Adds silver_label of the saved label model; 0 where it or its lexicon can't be used, or every function abstains."""
    try:
        lexicon = mail.sparkSession.read.parquet(f"{models.folder}/lexicon.parquet")
        voters = labelling_functions(lexicon, models.label_model.semantic, "semantic")
        if list(voters) != models.label_model.names:
            raise ValueError("the lexicon is not the one of the label model")
        marked = silver(voted(with_semantic(mail, vectors, lexicon, embed), voters), models.label_model)
        return marked.withColumn("silver_label", F.coalesce("silver_label", F.lit(0)))
    except Exception as e:  # noqa: BLE001
        log.warning("no silver labels: %s", str(e)[:200])
        return mail.withColumn("silver_label", F.lit(0))


def evaluate(scored: DataFrame, gold: DataFrame, folder: str | None = None) -> dict:
    """Metrics of scored mail against gold labels (0 or 1; others don't count), written as metrics.json."""
    one = gold.filter("gold_labels in (0, 1)").groupBy("message_id").agg(F.max("gold_labels").alias("label"))
    rows = scored.select("message_id", "proba", "urgent").join(one, "message_id").select("label", F.col("proba").alias("score"), F.col("urgent").cast("int").alias("pred"))
    metrics = E.metric_row(rows, "gold").first().asDict()
    if folder:
        save_document(metrics, f"{folder}/metrics.json")
    return metrics


def watch(rows: DataFrame, folder: str, baseline: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> dict:
    """Snapshot and review queue of scored rows (pred, proba, topic, topic_probability, message_id, body, _ordinal) against a baseline, else the rows marked baseline, else the first ones; writes snapshot.json and review_queue."""
    rows = monitor.defaults(rows)
    if baseline is None:
        if "baseline" in rows.columns:
            baseline, rows = rows.filter("baseline"), rows.filter("not coalesce(baseline, false)")
        else:
            baseline = monitor.first_rows(rows, max(100, config.min_samples))
    queue = written(monitor.review_queue(rows, config), "queue")
    save(monitor.baseline_profile(monitor.defaults(baseline)), f"{folder}/baseline.parquet")
    snap = monitor.snapshot(rows, baseline, config, F.lit(queue.count())).first().asDict(recursive=True)
    save_document(snap, f"{folder}/snapshot.json")
    save_csv(queue.drop("_ordinal"), f"{folder}/review_queue")
    return snap


def health(spark: SparkSession) -> dict:
    return {"status": "ok", "spark": spark.version}
