"""Queries on evaluation, monitoring, vectors and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.operators import classify as C
from mailloom.operators import evaluate as E
from mailloom.operators import knn as K
from mailloom.operators import monitor as M
from mailloom.operators.lexicon import seed_lexicon, sentence_index
from mailloom.operators.ordered import with_position, with_running
from mailloom.operators.topics import DensityTopics, TopicModel, named, topic_features, topic_names, topic_summary
from mailloom.operators.weak import LabelModel, labelling_functions, searched, silver, vote_patterns, voted
from mailloom.plans.mail import KEYS, SENTENCES_SQL, keyed, view
from mailloom.session import read_table

SMALL = EngineConfig(min_samples=10)
# Fixed example model: every function votes its class with probability 0.6, the other with 0.2.
EXAMPLE = [[[0.6, 0.2], [0.2, 0.6]]] * 21


def scored(s: SparkSession, d: str) -> DataFrame:
    """Labels and scores derived from columns of the orders table, with many ties."""
    o = read_table(s, d, "orders")
    score = (F.col("o_orderkey") * 37 % 101).cast("double") / 100
    return o.select(F.col("o_orderkey").alias("key"), ((F.col("o_orderkey") * 53 % 97 + F.col("o_orderkey") * 37 % 101) > 110).cast("int").alias("label"), score.alias("score"), (score >= 0.5).cast("int").alias("pred"))


def predictions(s: SparkSession, d: str) -> DataFrame:
    """Predictions, probabilities and topics of the mail vectors, in the order of vec_id."""
    v = read_table(s, d, "mail_vectors")
    proba = (F.col("vec_id") * 37 % 1000).cast("double") / 1000
    return v.select("vec_id", F.col("vec_id").alias("_ordinal"), F.col("message_id"), F.lit(None).cast("string").alias("body"), (proba >= 0.5).cast("int").alias("pred"), proba.alias("proba"), F.coalesce("label", F.lit(-1)).alias("topic"), ((F.col("vec_id") * 91 % 1000).cast("double") / 1000).alias("topic_probability"), F.timestamp_micros(F.col("vec_id") * 7919 % 1000 * 1_000_000).alias("date"))


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = predictions(s, d)
    return p.filter("topic % 2 <> 0 or proba < 0.7"), p.filter("topic % 2 = 0")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def labels(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("int").alias("label"))


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    baseline, current = halves(s, d)
    return M.snapshot(current, baseline, SMALL)


def _mail_vectors_by_mail(s: SparkSession, d: str) -> DataFrame:
    """A vector for each e-mail: pairs of neighbouring ids share one of the embeddings table."""
    n = max(1, read_table(s, d, "embeddings").count())
    return read_table(s, d, "emails").select(F.col("id"), F.floor(F.col("id") / 2 % n).cast("long").alias("vec_id")).join(read_table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id").select("id", "embedding")


def _near_removed(s: SparkSession, d: str) -> DataFrame:
    mail = keyed(s, d)
    return K.near_duplicates_removed(mail, _mail_vectors_by_mail(s, d), KEYS).select("_ordinal")


def _features(s: SparkSession, d: str) -> DataFrame:
    v = read_table(s, d, "embeddings")
    return v.select(F.col("vec_id"), (F.col("label") < 5).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"lora_{i}") for i in range(64)])


def _logistic(s: SparkSession, d: str) -> DataFrame:
    f = [f"lora_{i}" for i in range(64)]
    rows = _features(s, d)
    return C.scored(rows, C.fitted(rows, f), f).select("vec_id", "label", F.round("proba", 4).alias("proba"))


def _optimum(s: SparkSession, d: str) -> DataFrame:
    f = [f"lora_{i}" for i in range(64)]
    rows = _features(s, d)
    return C.gradient(rows, C.fitted(rows, f), f).select("feature", (F.abs("gradient") < 1e-3).alias("at_optimum"))


def _out_of_fold(s: SparkSession, d: str) -> DataFrame:
    f = [f"lora_{i}" for i in range(64)]
    return C.out_of_fold(_features(s, d), f, "vec_id").select("vec_id", "fold", F.round("cv_proba", 4).alias("cv_proba"))


def _importance(s: SparkSession, d: str) -> DataFrame:
    f = [f"lora_{i}" for i in range(64)]
    return C.group_importance(C.importance(C.fitted(_features(s, d), f), f))


def _topics(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    return topic_features(v.select("id"), TopicModel().fit(v), v)


def _topic_summary(s: SparkSession, d: str) -> DataFrame:
    p = predictions(s, d)
    subjects = read_table(s, d, "emails").select("message_id", "subject").filter("subject is not null")
    docs = p.join(subjects, "message_id").select("topic", F.col("subject").alias("text"))
    return topic_summary(named(p.withColumn("label", F.col("pred")), topic_names(docs)))


def _example(s: SparkSession) -> LabelModel:
    return LabelModel(list(labelling_functions(seed_lexicon(s))), EXAMPLE)


def _posterior(s: SparkSession, d: str) -> DataFrame:
    return rounded(silver(voted(view(s, d), labelling_functions(seed_lexicon(s))), _example(s)).select("_ordinal", "silver_proba", "silver_label"), "_ordinal", "silver_label")


def _label_model(s: SparkSession, d: str) -> DataFrame:
    lexicon = seed_lexicon(s)
    gold = read_table(s, d, "gold_labels").groupBy("message_id").agg(F.max("gold_labels").alias("gold"))
    mail = view(s, d).join(gold, "message_id", "left")
    model = searched(mail, lexicon, "gold")
    return silver(voted(mail, labelling_functions(lexicon, model.semantic)), model).groupBy("silver_label").agg(F.count("*").alias("n"))


QUERIES = {
    "confusion": lambda s, d: E.confusion(scored(s, d)),
    "prf_metrics": lambda s, d: rounded(E.rates(E.confusion(scored(s, d)))),
    "class_report": lambda s, d: rounded(E.per_class(scored(s, d)), "class", "support"),
    "roc_points": lambda s, d: rounded(E.roc_points(scored(s, d))),
    "roc_corners": lambda s, d: rounded(E.roc_corners(scored(s, d))),
    "similarity_features_strict": lambda s, d: rounded(K.in_sample_features(vectors(s, d), labels(s, d), strict=True), "id"),
    "pr_curve": lambda s, d: rounded(E.pr_points(scored(s, d))),
    "auc_rank": lambda s, d: rounded(E.auc(scored(s, d))),
    "average_precision": lambda s, d: rounded(E.average_precision(scored(s, d))),
    "threshold_sweep": lambda s, d: rounded(E.threshold_sweep(scored(s, d))),
    "metric_row": lambda s, d: rounded(E.metric_row(scored(s, d), "all"), "split", "n"),
    "running_total": lambda s, d: with_running(read_table(s, d, "orders").select("o_orderkey", F.lit(1).cast("long").alias("one")), {"n": "one"}, F.col("o_orderkey")).select("o_orderkey", "n"),
    "row_positions": lambda s, d: with_position(read_table(s, d, "events").select("event_id", "ts"), "position", F.col("ts").desc(), F.col("event_id")).select("event_id", "position"),
    "label_distribution": lambda s, d: rounded(M.distribution(predictions(s, d), F.col("topic").cast("string")), "key"),
    "prob_bucket_distribution": lambda s, d: rounded(M.distribution(predictions(s, d), M.bucketed(F.col("topic_probability")))),
    "drift_snapshot": lambda s, d: rounded(_snapshot(s, d).select("sample_size", "mean_confidence", "confidence_drift", "pred_drift", "topic_drift", "uncertainty_rate", F.size("alerts").alias("n_alerts")), "sample_size", "n_alerts"),
    "alerts": lambda s, d: M.alert_rows(_snapshot(s, d)).select("name", "severity", F.round("score", 6).alias("score"), "threshold"),
    "rare_topics": lambda s, d: M.rare_topics(predictions(s, d)),
    "review_queue": lambda s, d: M.review_queue(predictions(s, d)).select("_ordinal", "reason", "drift_score"),
    "baseline_split": lambda s, d: M.time_split(predictions(s, d)).select("vec_id", "baseline"),
    "share_comparison": lambda s, d: rounded(M.share_comparison(*[M.distribution(x, F.col("topic").cast("string")) for x in halves(s, d)][::-1]), "key"),
    "scalar_summary": lambda s, d: rounded(predictions(s, d).agg(F.count("*").alias("n"), F.avg("proba").alias("mean"), F.min("proba").alias("low"), F.max("proba").alias("high"), F.countDistinct("topic").alias("topics")), "n", "topics"),
    "value_counts": lambda s, d: predictions(s, d).groupBy("topic").agg(F.count("*").alias("n")),
    "last_rows": lambda s, d: predictions(s, d).orderBy(F.desc("_ordinal")).limit(100).select("vec_id"),
    "lenient_dates": lambda s, d: read_table(s, d, "emails").select("id", F.unix_micros(F.try_to_timestamp("date_text", F.lit("yyyy-MM-dd HH:mm:ss"))).alias("us")),
    "json_round_trip": lambda s, d: predictions(s, d).select("vec_id", F.from_json(F.to_json(F.struct("pred", "topic")), "pred int, topic int").alias("j")).select("vec_id", "j.pred", "j.topic"),
    "label_names": lambda s, d: predictions(s, d).select("vec_id", F.coalesce(F.element_at(F.create_map(F.lit(0), F.lit("calm"), F.lit(1), F.lit("urgent")), F.col("pred")), F.lit("unknown")).alias("name")),
    "sentence_chunks": lambda s, d: sentence_index(view(s, d)),
    "first_rows": lambda s, d: M.first_rows(predictions(s, d), 100).select("vec_id"),
    "knn_topk": lambda s, d: K.knn(vectors(s, d), vectors(s, d), 10, exclude_self=True).select("query_id", "rank", "neighbour_id", F.round("similarity", 6).alias("similarity")),
    "similarity_features": lambda s, d: rounded(K.in_sample_features(vectors(s, d), labels(s, d)), "id"),
    "similarity_features_new": lambda s, d: rounded(K.out_of_sample_features(vectors(s, d).filter("id % 5 = 0"), vectors(s, d).filter("id % 5 <> 0"), labels(s, d)), "id"),
    "semantic_max": lambda s, d: rounded(K.max_similarity(vectors(s, d), read_table(s, d, "embeddings").select(F.concat(F.lit("t"), F.col("vec_id") % 3).alias("lexicon"), F.col("vec_id").alias("id"), "embedding")), "id", "lexicon"),
    "near_dup_removed": _near_removed,
    "weak_posterior": _posterior,
    "label_model": _label_model,
    "logistic_scores": _logistic,
    "logistic_optimum": _optimum,
    "out_of_fold": _out_of_fold,
    "group_importance": _importance,
    "topics_fit": _topics,
    "topics_density": lambda s, d: DensityTopics().fit(vectors(s, d)).assign(vectors(s, d)),
    "topic_summary": _topic_summary,
    "fitted_patterns": lambda s, d: vote_patterns(voted(view(s, d), labelling_functions(seed_lexicon(s)))).groupBy().agg(F.sum("n").alias("n"), F.count("*").alias("patterns")),
}
SCORED = "WITH d AS (SELECT o_orderkey AS key, ((o_orderkey * 53 % 97 + o_orderkey * 37 % 101) > 110)::INT AS label, (o_orderkey * 37 % 101)::DOUBLE / 100 AS score FROM orders), p AS (SELECT *, (score >= 0.5)::INT AS pred FROM d), c AS (SELECT count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 0 AND label = 0) AS tn FROM p)"
RATES = "(tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1"
CURVE = f"{SCORED}, g AS (SELECT score, sum(label) AS p1, sum(1 - label) AS n1 FROM p GROUP BY 1), k AS (SELECT score, sum(p1) OVER w AS tp, sum(n1) OVER w AS fp, sum(p1) OVER () AS p, sum(n1) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC))"
AUC = "SELECT sum((fp - coalesce(fp0, 0)) * (tp + coalesce(tp0, 0)) / 2.0) / max(p * n) AS auc_roc FROM (SELECT *, lag(fp) OVER (ORDER BY score DESC) AS fp0, lag(tp) OVER (ORDER BY score DESC) AS tp0 FROM k)"
PRED = "WITH p AS (SELECT vec_id, message_id, ((vec_id * 37 % 1000)::DOUBLE / 1000 >= 0.5)::INT AS pred, (vec_id * 37 % 1000)::DOUBLE / 1000 AS proba, coalesce(label, -1) AS topic, (vec_id * 91 % 1000)::DOUBLE / 1000 AS topic_probability, vec_id * 7919 % 1000 AS date FROM mail_vectors)"
RARE = "r AS (SELECT topic, count(*) AS n FROM p GROUP BY 1 HAVING count(*) < (SELECT greatest(2, floor(count(*) * 0.05)) FROM p))"
HALVES = f"{PRED}, b AS (SELECT * FROM p WHERE topic % 2 <> 0 OR proba < 0.7), c AS (SELECT * FROM p WHERE topic % 2 = 0)"


def _drift(key: str) -> str:
    return f"(SELECT sqrt(sum(pow(coalesce(x.s, 0) - coalesce(y.s, 0), 2))) FROM (SELECT {key} AS k, count(*) / (SELECT count(*) FROM c) AS s FROM c GROUP BY 1) x FULL JOIN (SELECT {key} AS k, count(*) / (SELECT count(*) FROM b) AS s FROM b GROUP BY 1) y USING (k))"


SNAP = f"{HALVES}, s AS (SELECT count(*) AS sample_size, avg(proba) AS mean_confidence, abs(avg(proba) - (SELECT avg(proba) FROM b)) AS confidence_drift, {_drift('pred')} AS pred_drift, {_drift('topic')} AS topic_drift, avg((proba < 0.4)::INT) AS uncertainty_rate FROM c)"
ALERTS = "a AS (SELECT 'label_drift' AS name, CASE WHEN pred_drift > 0.15 * 1.5 THEN 'high' ELSE 'medium' END AS severity, pred_drift AS score, 0.15::DOUBLE AS threshold FROM s UNION ALL SELECT 'topic_drift', CASE WHEN topic_drift > 0.2 * 1.5 THEN 'high' ELSE 'medium' END, topic_drift, 0.2 FROM s UNION ALL SELECT 'confidence_drift', 'medium', confidence_drift, 0.15 FROM s UNION ALL SELECT 'uncertainty_spike', 'high', uncertainty_rate, 0.4 FROM s), f AS (SELECT * FROM a WHERE score > threshold)"


def _neighbours(queries: str, reference: str, k: int, other: bool) -> str:
    return f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[64] AS x FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, r.label, array_cosine_similarity(q.x, r.x) AS sim FROM e q JOIN e r ON {'q.vec_id <> r.vec_id' if other else 'true'} WHERE {queries} AND {reference}),
  t AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, neighbour_id) - 1)::INT AS rank FROM s), n AS (SELECT * FROM t WHERE rank < {k})"""


FEATURES = "SELECT query_id AS id, " + ", ".join(f"round({e}, 6) AS {n}_similarity" for n, e in (
    ("max", "max(sim)"), ("mean", "avg(sim)"), ("std", "stddev_pop(sim)"), ("top_k_mean", "avg(sim)"), ("top_k_std", "stddev_pop(sim)"),
    ("top_k_pos", "coalesce(avg(sim) FILTER (label < 5), 0)"), ("top_k_neg", "coalesce(avg(sim) FILTER (label >= 5), 0)"),
    ("gap", "coalesce(avg(sim) FILTER (label < 5), 0) - coalesce(avg(sim) FILTER (label >= 5), 0)"))) + " FROM n GROUP BY 1"


def _posterior_sql() -> str:
    from mailloom.plans.mail import VOTES_SQL

    odds = "list_sum(list_transform(votes, lambda v: CASE v WHEN 1 THEN ln(3) WHEN 0 THEN -ln(3) ELSE 0 END))"
    return f"{VOTES_SQL}, o AS (SELECT _ordinal, CASE WHEN len(list_filter(votes, lambda x: x >= 0)) > 0 THEN 1 / (1 + exp(-{odds})) END AS p FROM v) SELECT _ordinal, round(p, 6) AS silver_proba, (p >= 0.5 - 1e-12)::INT AS silver_label FROM o"


def _votes_sql() -> str:
    from mailloom.plans.mail import VOTES_SQL

    return VOTES_SQL


def _near_sql() -> str:
    from mailloom.plans.mail import KEYED

    return f"""{KEYED}, x AS (SELECT c._ordinal, e.embedding::DOUBLE[64] AS v FROM c JOIN embeddings e ON e.vec_id = (c._ordinal // 2) % (SELECT count(*) FROM embeddings) WHERE in_folders),
  z AS (SELECT a._ordinal, max(array_cosine_similarity(a.v, b.v)) AS s FROM x a JOIN x b ON a._ordinal <> b._ordinal GROUP BY 1), y AS (SELECT c.*, coalesce(z.s > 0.95, false) AS dup FROM c LEFT JOIN z USING (_ordinal)),
  w AS (SELECT *, row_number() OVER (PARTITION BY dup, sender, to_key, subject, date_text ORDER BY _ordinal) AS n FROM y) SELECT _ordinal FROM w WHERE NOT dup OR n = 1"""


ORACLE = {
    "confusion": f"{SCORED} SELECT * FROM c",
    "prf_metrics": f"{SCORED}, r AS (SELECT *, {RATES} FROM c) SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r",
    "class_report": f"{SCORED} SELECT k AS class, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS support FROM (SELECT 1 AS k, tp, fp, fn FROM c UNION ALL SELECT 0, tn, fn, fp FROM c)",
    "roc_points": f"{CURVE} SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM k UNION ALL SELECT NULL, 0, 0",
    "roc_corners": f"{CURVE}, l AS (SELECT *, lag(tp) OVER w AS tp0, lead(tp) OVER w AS tp2, lag(fp) OVER w AS fp0, lead(fp) OVER w AS fp2 FROM k WINDOW w AS (ORDER BY score DESC)) SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM l WHERE tp0 IS NULL OR tp2 IS NULL OR tp0 + tp2 <> 2 * tp OR fp0 + fp2 <> 2 * fp UNION ALL SELECT NULL, 0, 0",
    "similarity_features_strict": f"{_neighbours('true', 'true', 11, False).replace('rank < 11', 'rank BETWEEN 1 AND 10')} {FEATURES}",
    "pr_curve": f"{CURVE} SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (tp + fp + p), 6) AS f1 FROM k",
    "auc_rank": f"{CURVE} SELECT round(auc_roc, 6) AS auc_roc FROM ({AUC})",
    "average_precision": f"{CURVE} SELECT round(sum((tp - coalesce(tp0, 0)) / p * tp / (tp + fp)), 6) AS average_precision FROM (SELECT *, lag(tp) OVER (ORDER BY score DESC) AS tp0 FROM k)",
    "threshold_sweep": f"{SCORED}, t AS (SELECT range / 100 AS threshold FROM range(10, 91)), s AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (label = 1) AS p FROM t, p GROUP BY 1) SELECT round(threshold, 6) AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (tp + fp + p), 6) AS f1 FROM s",
    "metric_row": f"{CURVE}, r AS (SELECT {RATES} FROM c) SELECT 'all' AS split, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, (SELECT count(*) FROM p) AS n, (SELECT round(avg(label), 6) FROM p) AS positive_rate, (SELECT round(avg(pred), 6) FROM p) AS predicted_rate, (SELECT round(auc_roc, 6) FROM ({AUC})) AS auc_roc FROM r",
    "running_total": "SELECT o_orderkey, count(*) OVER (ORDER BY o_orderkey) AS n FROM orders",
    "row_positions": "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS position FROM events",
    "label_distribution": f"{PRED} SELECT topic::VARCHAR AS key, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1",
    "prob_bucket_distribution": f"{PRED} SELECT round(round_even(topic_probability * 100, 0) / 100, 6) AS key, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1",
    "drift_snapshot": f"{SNAP}, {ALERTS} SELECT sample_size, round(mean_confidence, 6) AS mean_confidence, round(confidence_drift, 6) AS confidence_drift, round(pred_drift, 6) AS pred_drift, round(topic_drift, 6) AS topic_drift, round(uncertainty_rate, 6) AS uncertainty_rate, (SELECT count(*) FROM f)::INT AS n_alerts FROM s",
    "alerts": f"{SNAP}, {ALERTS} SELECT name, severity, round(score, 6) AS score, threshold FROM f",
    "rare_topics": f"{PRED}, {RARE} SELECT topic, n FROM r",
    "review_queue": f"{PRED}, {RARE}, q AS (SELECT vec_id AS _ordinal, concat_ws('; ', CASE WHEN proba < 0.65 THEN 'low confidence' END, CASE WHEN topic_probability < 0.2 THEN 'uncertain topic' END, CASE WHEN topic IN (SELECT topic FROM r) THEN 'rare topic' END) AS reason, proba AS drift_score FROM p) SELECT * FROM q WHERE reason <> '' ORDER BY _ordinal LIMIT 50",
    "baseline_split": f"{PRED} SELECT vec_id, row_number() OVER (ORDER BY date, vec_id) <= (SELECT greatest(least(greatest(floor(count(*) * 0.3), 100), count(*) - 100), 1) FROM p) AS baseline FROM p",
    "share_comparison": f"{HALVES}, x AS (SELECT topic::VARCHAR AS key, count(*) / (SELECT count(*) FROM c) AS s FROM c GROUP BY 1), y AS (SELECT topic::VARCHAR AS key, count(*) / (SELECT count(*) FROM b) AS s FROM b GROUP BY 1) SELECT key, round(coalesce(x.s, 0), 6) AS current, round(coalesce(y.s, 0), 6) AS baseline FROM x FULL JOIN y USING (key)",
    "scalar_summary": f"{PRED} SELECT count(*) AS n, round(avg(proba), 6) AS mean, min(proba) AS low, max(proba) AS high, count(DISTINCT topic) AS topics FROM p",
    "value_counts": f"{PRED} SELECT topic, count(*) AS n FROM p GROUP BY 1",
    "last_rows": f"{PRED} SELECT vec_id FROM p ORDER BY vec_id DESC LIMIT 100",
    "lenient_dates": r"SELECT id, CASE WHEN regexp_matches(date_text, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$') THEN epoch_us(try_strptime(date_text, '%Y-%m-%d %H:%M:%S')) END AS us FROM emails",
    "json_round_trip": f"{PRED} SELECT vec_id, pred, topic FROM p",
    "label_names": f"{PRED} SELECT vec_id, CASE pred WHEN 0 THEN 'calm' ELSE 'urgent' END AS name FROM p",
    "first_rows": f"{PRED} SELECT vec_id FROM p ORDER BY vec_id LIMIT 100",
    "knn_topk": f"{_neighbours('true', 'true', 10, True)} SELECT query_id, rank, neighbour_id, round(sim, 6) AS similarity FROM n",
    "similarity_features": f"{_neighbours('true', 'true', 10, True)} {FEATURES}",
    "similarity_features_new": f"{_neighbours('q.vec_id % 5 = 0', 'r.vec_id % 5 <> 0', 10, False)} {FEATURES}",
    "semantic_max": "WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings) SELECT q.vec_id AS id, concat('t', r.vec_id % 3) AS lexicon, round(max(array_cosine_similarity(q.x, r.x)), 6) AS similarity FROM e q, e r GROUP BY ALL",
    "near_dup_removed": _near_sql(),
    "weak_posterior": _posterior_sql(),
    "sentence_chunks": SENTENCES_SQL,
    "logistic_optimum": "SELECT concat('lora_', range) AS feature, true AS at_optimum FROM range(64) UNION ALL SELECT '1', true",
    "topic_summary": rf"""{PRED}, d AS (SELECT topic, subject FROM p JOIN emails USING (message_id) WHERE subject IS NOT NULL AND topic >= 0), w AS (SELECT topic, unnest(regexp_extract_all(lower(subject), '\p{{L}}{{3,}}')) AS w FROM d),
      f AS (SELECT topic, w, count(*) AS tf FROM w GROUP BY ALL), x AS (SELECT *, sum(tf) OVER (PARTITION BY w) AS f FROM f), a AS (SELECT avg(s) AS a FROM (SELECT sum(tf) AS s FROM f GROUP BY topic)),
      r AS (SELECT topic, w, row_number() OVER (PARTITION BY topic ORDER BY tf * ln(1 + a / f) DESC, w) AS n FROM x, a), g AS (SELECT topic, string_agg(w, '_' ORDER BY n) AS name FROM r WHERE n <= 4 GROUP BY 1)
      SELECT topic, coalesce(name, 'noise') AS name, count(*) AS n, avg(pred::DOUBLE) AS mean_label, avg(pred::DOUBLE) AS mean_pred, avg(proba) AS mean_proba, avg(topic_probability) AS mean_topic_probability FROM p LEFT JOIN g USING (topic) GROUP BY ALL""",
    "fitted_patterns": f"{_votes_sql()} SELECT count(*) AS n, count(DISTINCT votes) AS patterns FROM v",
}
