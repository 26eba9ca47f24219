"""Reference behaviour of the core operators on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.functions import text as X
from mailloom.operators import analytics, classify, evaluate, knn, lexicon, mail, monitor, ordered, splits, topics, weak
from mailloom.schemas import EMAIL, aligned, conform, require, same_features, violations


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


def test_body_cleaning_golden(spark):
    raw = "<p>Hello!!!</p> mail me at x@example.com or https://x.test call 123-456-7890"
    for strict in (False, True):
        assert one(spark, X.clean_body(F.col("b"), strict=strict), b=raw) == "hello! mail me at or call"
    assert one(spark, X.clean_body(F.col("b")), b=None) == ""


def test_body_parts(spark):
    body = "Please check\nthe file.\nThanks\nAnn\n-----Original Message-----\nFrom: x"
    assert one(spark, X.clean_body(F.col("b")), b=body) == "please check the file."
    assert one(spark, X.clean_body(F.col("b"), boilerplate=["this mail is"]), b="Hi\nThis mail is secret") == "hi"
    assert one(spark, X.html_to_text(F.col("b")), b="<script>x()</script><b> a </b>&amp;<i>b</i>") == "a & b"
    assert one(spark, X.html_to_text(F.col("b")), b="1 < 2") == "1 < 2"
    assert one(spark, X.clean_subject(F.col("b")), b="RE: Fwd : re: Plan") == "plan"


def test_domains_and_recipients(spark):
    df = spark.createDataFrame([(["A <a@X.test>", "b@y.test"], None, ["b@y.test"])], "a array<string>, b array<string>, c array<string>")
    r = df.select(X.domains(F.col("a"), F.col("b"), F.col("c")).alias("d"), X.recipients(F.col("a"), F.col("b"), F.col("c")).alias("n"), X.recipients(F.col("a"), F.col("b"), F.col("c"), strict=True).alias("s")).first()
    assert (r["d"], r["n"], r["s"]) == (["X.test", "y.test"], 2, 3)
    assert one(spark, X.domain(F.col("b")), b="nobody") is None
    assert one(spark, X.addresses(F.col("b")), b="A <a@Example.com>; b@example.com; A <a@example.com>") == ["a@example.com", "b@example.com"]


def emails(spark, rows):
    return spark.createDataFrame(rows, "id long, message_id string, sender string, subject string, body string, to_list array<string>, cc_list array<string>, bcc_list array<string>, sec long").withColumn("received_at", F.timestamp_seconds("sec"))


def test_threads(spark):
    rows = [(1, "a", "x@p.test", "Plan", "", None, None, None, 1), (2, "b", "x@p.test", "RE: Plan", "", None, None, None, 3), (3, "c", "y@p.test", "fw: re: plan", "", None, None, None, 2), (4, "d", None, None, None, None, None, None, None)]
    got = {r["_ordinal"]: r for r in mail.threads(mail.mail_view(emails(spark, rows))).collect()}
    assert got[2]["thread_id"] == got[3]["thread_id"] != got[1]["thread_id"]
    assert (got[3]["sequence"], got[2]["sequence"], got[2]["parent_id"], got[3]["parent_id"]) == (1, 2, "c", None)
    assert got[3]["is_forward"] and not got[3]["is_reply"] and got[4]["sender_domain"] is None


def test_meta_features(spark):
    rows = [(1, "a", "x@p.test", "s", "One two. Three!", ["u@q.test"], [], [], 1000), (2, "b", "x@p.test", "s", None, ["v@p.test"], None, [], 1600), (3, "c", "y@p.test", "s", "", None, None, None, 1100)]
    got = {r["_ordinal"]: r for r in mail.meta_features(mail.mail_view(emails(spark, rows))).collect()}
    assert (got[1]["response_time"], got[3]["response_time"], got[2]["response_time"], got[2]["time_since_last_email"]) == (None, 100, 500, 600)
    assert (got[1]["n_words"], got[1]["n_sentences"], got[2]["n_words"]) == (3, 2, 0)
    assert (got[1]["is_external"], got[1]["is_internal"], got[2]["is_external"], got[2]["is_internal"]) == (True, False, False, True)
    strict = {r["_ordinal"]: r for r in mail.meta_features(mail.mail_view(emails(spark, rows)), EngineConfig(strict_reference=True)).collect()}
    assert strict[2]["n_recipient"] == 2 and strict[1]["is_after_hours"] and not strict[1]["is_external"]


def test_completed(spark):
    r = mail.completed(spark.createDataFrame([("S@Internal.test", ["a@Example.com", "b@vendor.test"])], "x_from string, to_list array<string>")).first()
    assert r["message_id"].startswith("api-") and len(r["message_id"]) == 36
    assert (r["sender_domain"], r["recipient_domain"], r["cc_list"], r["body"]) == ("internal.test", ["example.com", "vendor.test"], [], "")


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_ordered_matches_python(spark, partitions):
    rng = random.Random(partitions)
    values = [(i, rng.randrange(40), rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(values, "id long, k int, v int").repartition(partitions)
    order = sorted(values, key=lambda r: (r[1], r[0]))
    previous = {r["id"]: r["p"] for r in ordered.with_previous(df, "v", "p", "k", "id").collect()}
    assert previous == {r[0]: (order[i - 1][2] if i else None) for i, r in enumerate(order)}
    running, total = {}, 0
    for r in order:
        total += r[2]
        running[r[0]] = total
    assert {r["id"]: r["s"] for r in ordered.with_running(df, {"s": "v"}, F.col("k"), F.col("id")).collect()} == running
    assert {r["id"]: r["n"] for r in ordered.with_position(df, "n", F.col("k"), F.col("id")).collect()} == {r[0]: i + 1 for i, r in enumerate(order)}
    last, number = {}, {}
    seen = {}
    for r in sorted(values, key=lambda r: (r[2] if r[2] else -1, r[1], r[0])):
        g = r[2] or None
        last[r[0]], number[r[0]] = (seen[g][-1] if g in seen else None), len(seen.get(g, [])) + 1
        seen.setdefault(g, []).append(r[1])
    got = ordered.with_neighbours(df.withColumn("v", F.nullif("v", F.lit(0))), "v", "k", "p", "n", "k", "id").collect()
    assert {r["id"]: r["p"] for r in got} == last and {r["id"]: r["n"] for r in got} == number
    hot = ordered.with_neighbours(df.withColumn("v", F.lit("one")), "v", "id", "p", "n", "id").collect()
    assert {r["id"]: (r["p"], r["n"]) for r in hot} == {i: (i - 1 if i else None, i + 1) for i in range(200)}
    assert ordered.with_position(df.limit(0), "n", F.col("k")).count() == 0


def test_keep_first_and_folders(spark):
    df = spark.createDataFrame([(1, "a", "f"), (2, "a", "g"), (3, None, "f"), (4, None, "g"), (5, "b", "f"), (6, "b", "f")], "_ordinal long, k string, x_folder string")
    assert {r["_ordinal"] for r in ordered.keep_first(df, ["k"], "_ordinal").collect()} == {1, 3, 5}
    assert {r["_ordinal"] for r in analytics.multi_folder(df, ["k"]).filter("in_folders").collect()} == {1, 2}


def test_near_duplicates_removed(spark):
    df = spark.createDataFrame([(1, "a", "f"), (2, "a", "g"), (3, "b", "f"), (4, "b", "g"), (5, "c", "f")], "_ordinal long, k string, x_folder string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 1.0]), (4, [-1.0, 0.2]), (5, [1.0, 0.0])], "id long, embedding array<double>")
    kept = {r["_ordinal"] for r in knn.near_duplicates_removed(df, v, ["k"]).collect()}
    assert kept == {1, 3, 4, 5}


def test_knn_and_features(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "id long, embedding array<double>")
    got = [(r["query_id"], r["neighbour_id"]) for r in knn.knn(v, v, 1, exclude_self=True).orderBy("query_id").collect()]
    assert got == [(1, 3), (2, 1), (3, 1), (6, 1)]
    assert knn.knn(v.limit(0), v, 3).count() == 0 and knn.knn(v, v.limit(0), 3).count() == 0
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 7)], "id long, label int")
    f = knn.out_of_sample_features(spark.createDataFrame([(9, [1.0, 0.0])], "id long, embedding array<double>"), v.filter("id < 4"), labels, 3).first()
    assert (f["max_similarity"], f["top_k_neg_similarity"], f["top_k_pos_similarity"], f["gap_similarity"]) == (1.0, 1.0, 0.0, -1.0)
    with pytest.raises(ValueError):
        knn.out_of_sample_features(v, v.limit(0), labels)
    m = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], [0, 0, 0])], "t array<array<double>>, m array<int>, z array<int>")
    assert m.select(knn.masked_mean(F.col("t"), F.col("m"), 2).alias("a")).first()["a"] == [2.0, 3.0]
    assert m.select(knn.masked_mean(F.col("t"), F.col("z"), 2).alias("a")).first()["a"] == [0.0, 0.0]
    text = spark.createDataFrame([(1, [0.2, 0.8]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    term = spark.createDataFrame([("t", 1, [1.0, 0.0]), ("t", 2, [0.0, 1.0])], "lexicon string, id long, embedding array<double>")
    assert [round(r["similarity"], 2) for r in knn.max_similarity(text, term).orderBy("id").collect()] == [0.97, 1.0]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.4, 0), (1, 0.8, 1), (1, 0.9, 1)], "label int, score double, pred int")
    m = evaluate.metric_row(df, "x").first()
    assert all(m[k] == 1.0 for k in ("accuracy", "precision", "recall", "f1", "auc_roc"))
    single = df.filter("label = 0")
    assert evaluate.auc(single).first()["auc_roc"] == 0.0 and evaluate.rates(evaluate.confusion(single)).first()["f1"] == 0.0
    assert evaluate.best_threshold(df) == 0.41
    assert evaluate.predicted(df.drop("pred"), 0.4).agg(F.sum("pred")).first()[0] == 3
    assert evaluate.roc_points(df.limit(0)).count() == 1


def test_threshold_sweep_is_exact_at_the_cuts(spark):
    rng = random.Random(5)
    data = [(rng.randrange(2), rng.choice([k / 100 for k in range(101)] + [rng.random()])) for _ in range(500)]
    got = {round(r["threshold"], 2): r["f1"] for r in evaluate.threshold_sweep(spark.createDataFrame(data, "label int, score double")).collect()}
    for k in range(10, 91):
        tp = sum(y for y, s in data if s >= k / 100)
        said = sum(s >= k / 100 for _, s in data)
        assert got[k / 100] == pytest.approx(2 * tp / (said + sum(y for y, _ in data)))


def preds(spark, rows):
    return spark.createDataFrame([(i, f"m{i}", "t", *r) for i, r in enumerate(rows)], "_ordinal long, message_id string, body string, pred int, proba double, topic int, topic_probability double")


def test_monitoring(spark):
    base, now = preds(spark, [(0, 0.9, 0, 0.9), (0, 0.8, 0, 0.9)]), preds(spark, [(1, 0.3, 1, 0.9), (1, 0.2, 1, 0.9)])
    small = EngineConfig(min_samples=2)
    names = {r["name"] for r in monitor.alert_rows(monitor.snapshot(now, base, small)).collect()}
    assert {"label_drift", "confidence_drift"} <= names
    with pytest.raises(ValueError):
        monitor.snapshot(now, base)
    with pytest.raises(ValueError):
        monitor.snapshot(now.drop("topic"), base, small)
    queue = monitor.review_queue(preds(spark, [(0, 0.3, 1, 0.9), (1, 0.7, 2, 0.1)])).collect()
    assert [r["row_id"] for r in queue] == ["m0", "m1"] and queue[0]["reason"] == "low confidence; rare topic"
    assert monitor.review_queue(now.limit(0)).count() == 0


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.concat(F.lit("t"), F.col("id") % 90).alias("thread_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    a = {r["id"]: r["split"] for r in splits.thread_split(df).collect()}
    assert a == {r["id"]: r["split"] for r in splits.thread_split(df.repartition(7)).collect()} and set(a.values()) == {"train", "test"}
    folds = splits.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    assert len(folds) == 8
    assert {r["id"]: r["fold"] for r in splits.stratified_folds(df, "label", "id").collect()} == {r["id"]: r["fold"] for r in splits.stratified_folds(df.repartition(5), "label", "id").collect()}


def test_lexicon(spark):
    raw = spark.createDataFrame([("ASAP ", "Seed", "1"), ("asap", "Generated", "x"), (" ", "Seed", "1"), ("now", "generated", "bad")], "prototype string, source string, similarity string")
    lex = lexicon.normalised_lexicon(raw, F.lit("urgency"))
    assert {(r["prototype"], r["source"], r["similarity"]) for r in lex.collect()} == {("asap", "seed", 1.0), ("now", "generated", 0.0)}
    with pytest.raises(ValueError):
        lexicon.normalised_lexicon(raw.drop("source"), F.lit("x"))
    assert one(spark, lexicon.matches(F.col("b"), ["asap"]), b="need it ASAP!") and not one(spark, lexicon.matches(F.col("b"), ["asap"]), b="asphalt")
    phrases = lexicon.key_phrases(spark.createDataFrame([(1, "the open price model"), (2, None), (3, "")], "id long, text string"), lexicon.hashed_embedding).collect()
    assert {r["id"] for r in phrases} == {1} and 1 <= len(phrases) <= 5


def test_frequent_phrases_whole_equals_brute_force(spark):
    """The registered whole query takes 3 to 6 words, removes stop words and keeps more than 200 phrases."""
    import re
    from collections import Counter

    import pyarrow.parquet as pq

    from mailloom.plans.mail import QUERIES

    d = "/root/testdata/sf0.01"
    texts = [b or "" for b in pq.read_table(f"{d}/emails.parquet", columns=["body"])["body"].to_pylist()]
    count, docs = Counter(), Counter()
    for t in texts:
        w = [x for x in re.findall(r"\w{2,}", (t[:1000] + " " + t[-1000:]).lower()) if x not in set(lexicon.STOP_WORDS)]
        grams = Counter(" ".join(w[i : i + n]) for n in range(3, 7) for i in range(len(w) - n + 1))
        count.update(grams)
        docs.update(grams.keys())
    top = sorted((g for g in count if 10 <= docs[g] <= 0.8 * len(texts)), key=lambda g: (-count[g], g))[:50_000]
    want = {g: count[g] / len(texts) for g in top if count[g] / len(texts) > 0.01}
    got = {r["ngram"]: r["rate"] for r in QUERIES["frequent_phrases"](spark, d).collect()}
    assert {len(g.split()) for g in want} == {3, 4, 5, 6} and len(want) > 200 and len(lexicon.STOP_WORDS) == 318
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)


def test_whole_queries_read_whole_tables(spark):
    """All events count, and e-mails take vectors from the whole embeddings table."""
    from mailloom.plans import mail as plans
    from mailloom.plans import scores

    d = "/root/testdata/sf0.1"
    events = spark.read.parquet(f"{d}/events.parquet").filter("ts is not null").count()
    assert sum(r["n"] for r in plans.QUERIES["dense_hours"](spark, d).collect()) == events
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert vectors > 500 and scores._mail_vectors_by_mail(spark, d).select("embedding").distinct().count() > 500
    assert "near_dup_removed" in scores.QUERIES
    best = scores.QUERIES["semantic_max"](spark, d.replace("sf0.1", "sf0.01")).groupBy("id").agg(F.max("similarity").alias("s"))
    assert best.filter("s > 0.9999").count() == best.count() > 20  # each text is among the terms


def test_lexicon_growth(spark):
    m = spark.createDataFrame([(i, "s", f"Please send the file number {i}. Other words here entirely.") for i in range(20)], "_ordinal long, subject string, body string")
    seed = lexicon.seed_lexicon(spark)
    grown = lexicon.grown(seed, m, neighbours=5, least=0.1)
    assert grown.filter("source = 'Generated'").count() > seed.filter("source = 'Generated'").count()
    assert grown.groupBy("lexicon", "prototype").count().filter("count > 1").count() == 0


def test_label_model_recovers_accuracies():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        y = rng.randrange(2)
        votes = tuple(-1 if rng.random() < 0.4 else (y if rng.random() < acc else 1 - y) for acc in (0.9, 0.8, 0.7, 0.85))
        counts[votes] = counts.get(votes, 0) + 1
    model = weak.LabelModel(["a", "b", "c", "d"]).fit([(list(v), n) for v, n in counts.items()])
    odds = model.log_odds()
    assert all(o[1] > 0 > o[0] for o in odds) and odds[0][1] > odds[2][1]


def test_weak_labels(spark, tmp_path):
    m = spark.createDataFrame([(1, "Urgent", "please send the invoice"), (2, "x", "nothing"), (3, None, None)], "_ordinal long, subject string, body string")
    f = weak.labelling_functions(lexicon.seed_lexicon(spark))
    assert len(f) == 21
    model = weak.LabelModel(list(f), [[[0.6, 0.2], [0.2, 0.6]]] * 21)
    model.save(str(tmp_path / "m.json"))
    got = {r["_ordinal"]: r for r in weak.silver(weak.voted(m, f), weak.LabelModel.load(str(tmp_path / "m.json"))).collect()}
    assert got[1]["silver_label"] == 1 and got[2]["silver_label"] is None
    assert weak.silver(weak.voted(m, f), model, strict=True).filter("_ordinal = 2").first()["silver_label"] == 1


def test_classifier_and_topics(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, i % 2, rng.gauss(i % 2 * 4, 1), rng.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    model = classify.fitted(df, ["a", "b"])
    scored = classify.scored(df, model, ["a", "b"])
    assert scored.filter("(proba >= 0.5) = (label = 1)").count() > 180
    assert classify.scored(df.drop("b"), model, ["a", "b"]).count() == 200
    assert 0.1 <= classify.tuned_threshold(classify.out_of_fold(df, ["a", "b"], "id")) <= 0.9
    v = spark.createDataFrame([(i, [float(i % 4 == k) + rng.gauss(0, 0.01) for k in range(6)]) for i in range(80)], "id long, embedding array<double>")
    t = topics.TopicModel(topics=4).fit(v)
    got = topics.topic_features(v.select("id").union(spark.createDataFrame([(99,)], "id long")), t, v)
    assert got.filter("id = 99 and topic = -1 and topic_probability = 0").count() == 1
    assert got.filter("topic >= 0").select((F.col("id") % 4).alias("k"), "topic").distinct().count() == 4
    t.save(str(tmp_path))
    assert topics.TopicModel.load(str(tmp_path)).assign(v).exceptAll(t.assign(v)).isEmpty()
    assert topics.topic_features(v.select("id"), None, v).filter("topic <> -1").count() == 0


def test_schemas(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id int, `from` string, other string")
    out = conform(df, EMAIL, {"from": "sender"})
    assert out.columns == EMAIL.names and out.first()["sender"] == "x"
    with pytest.raises(ValueError):
        require(df, "missing")
    assert aligned(df, ["id", "z"]).first()["z"] == 0.0 and not same_features(df, ["other", "id", "from"])
    assert {r["rule"]: r["n_violations"] for r in violations(df, {"a": F.col("id") > 0, "b": F.col("id") > 5}).collect()} == {"a": 0, "b": 1}


def test_html_references(spark):
    import html

    texts = ["caf&eacute; &amp;lt; &#8217;x&#x2019; &mdash; &#150; &nosuch; &#0; &#xD800; & &; a&b &#1114112; &NotEqualTilde;", "none", "&", "", None, "&hellip;&hellip;", "&amp;amp;"]
    got = {r["t"]: r["u"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.unescaped(F.col("t")).alias("u")).collect()}
    want = lambda t: html.unescape(t)
    assert got == {t: None if t is None else want(t) for t in texts}
    assert spark.range(1).select(X.html_to_text(F.lit("<p>caf&eacute;</p><p>&#8217;</p>")).alias("t")).first()["t"] == "café ’"


def test_folds_differ_by_one_row_and_splits_keep_their_share(spark):
    rows = [(i, i % 7 == 0, None if i % 11 else "g", f"t{i // 3}") for i in range(205)]
    df = spark.createDataFrame(rows, "id long, label boolean, gold string, thread_id string")
    sizes = {}
    for r in splits.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(len(v) == 4 and max(v) - min(v) <= 1 for v in sizes.values()) and sum(map(sum, sizes.values())) == 205
    whole = splits.thread_split(df)
    assert whole.filter("split = 'test'").select("thread_id").distinct().count() == 14  # of 69
    by_gold = splits.thread_split(df, gold="gold").collect()
    has = {t for *_, g, t in rows if g}
    test = {r["thread_id"] for r in by_gold if r["split"] == "test"}
    assert len(test & has) == -(-len(has) // 5) and len(test - has) == -(-(69 - len(has)) // 5)
    assert not test & {r["thread_id"] for r in by_gold if r["split"] == "train"}
    strict = splits.thread_split(df, gold="gold", strict=True).collect()
    assert len(strict) == 205 and len({(r["thread_id"], r["gold"] is None, r["split"]) for r in strict}) == len({(t, g is None) for *_, g, t in rows})
    assert splits.thread_split(df.limit(0)).count() == 0 and splits.stratified_folds(df.limit(0), "label", "id").count() == 0


@pytest.mark.parametrize("block", [7, 1000])
def test_knn_equals_brute_force_with_ties(spark, block):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(15, 5)), 4, axis=0)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    want = {(i, r): int(j) for i in range(60) for r, j in enumerate(np.lexsort((np.arange(60), -s[i]))[:6])}
    assert {(r["query_id"], r["rank"]): r["neighbour_id"] for r in knn.knn(df, df, 6, exclude_self=True, block=block).collect()} == want
    terms = spark.createDataFrame([(f"l{i % 3}", v.tolist()) for i, v in enumerate(x[:9])] + [("l1", None)], "lexicon string, embedding array<double>")
    scores = {r["id"]: r["semantic"] for r in knn.semantic_scores(df, terms).collect()}
    assert len(scores) == 60 and all(abs(scores[i][f"l{g}"] - (u[i] @ u[:9][g::3].T).max()) < 1e-12 for i in range(60) for g in range(3))
    assert knn.max_similarity(df, terms.limit(0)).count() == 0


def test_semantic_and_weighted_votes(spark):
    m = spark.createDataFrame([(1, "x", "nothing", {"urgency": 0.7, "bulk": 0.5}), (2, "x", "nothing", None)], "_ordinal long, subject string, body string, semantic map<string,double>")
    f = weak.labelling_functions(lexicon.seed_lexicon(spark), 0.6, "semantic")
    votes = {r["_ordinal"]: dict(zip(f, r["votes"])) for r in weak.voted(m, f).collect()}
    assert votes[1]["lf_urgency_semantic"] == 1 and votes[1]["lf_bulk_semantic"] == -1 and set(votes[2].values()) == {-1}
    g = {"a": F.lit(1), "b": F.lit(0), "c": F.lit(0)}
    got = spark.range(1).select(weak.weighted_vote({"a": 3.0}, g).alias("x"), weak.weighted_vote({}, g).alias("y"), weak.weighted_vote({"a": 2.0}, g).alias("z"), weak.weighted_vote({}, {}).alias("n")).first()
    assert tuple(got) == (1, 0, -1, -1)


def test_baseline_profile_and_topic_fallback(spark):
    rows = spark.createDataFrame([(1, 0.9, 3, 0.812), (0, 0.1, 3, 0.8149), (0, 0.2, 7, None)], "pred int, proba double, topic int, topic_probability double")
    assert {(r["key"], round(r["share"], 3)) for r in monitor.topic_shares(rows).collect()} == {("3", 0.667), ("7", 0.333)}
    assert {(r["key"], r["share"]) for r in monitor.topic_shares(rows.drop("topic")).collect()} == {("0.81", 1.0)}
    assert monitor.topic_shares(rows.drop("topic", "topic_probability")).count() == 0
    profile = monitor.baseline_profile(rows)
    assert profile.filter("kind = 'mean'").first()["share"] == pytest.approx(0.4)
    same = monitor.profile_drift(rows, profile).first()
    assert same["label_drift"] == same["topic_drift"] == 0 and same["confidence_drift"] == pytest.approx(0)
    moved = monitor.profile_drift(rows.filter("pred = 1"), profile).first()
    assert moved["label_drift"] == pytest.approx((2 * (2 / 3) ** 2) ** 0.5) and moved["confidence_drift"] == pytest.approx(0.5)


def test_settings_from_session_and_environment(spark, monkeypatch):
    from mailloom.config import EngineConfig

    monkeypatch.setenv("MAILLOOM_FOLDS", "7")
    monkeypatch.setenv("MAILLOOM_AFTER_HOURS", "9,18")
    monkeypatch.setenv("MAILLOOM_SEED", "1")
    spark.conf.set("mailloom.strict_reference", "true")
    spark.conf.set("mailloom.seed", "5")
    try:
        c = EngineConfig.load(spark, test_share=0.5)
        assert (c.folds, c.after_hours, c.seed, c.strict_reference, c.test_share, c.neighbours) == (7, (9, 18), 5, True, 0.5, 10)
        spark.conf.set("mailloom.strict_reference", "perhaps")
        with pytest.raises(ValueError):
            EngineConfig.load(spark)
    finally:
        spark.conf.unset("mailloom.strict_reference")
        spark.conf.unset("mailloom.seed")


def test_density_topics(spark, tmp_path):
    rng = random.Random(2)
    ring = [(math.cos(k / 30) * 5, math.sin(k / 30) * 5, 0.0) for k in range(189)]  # no blob: k-means would cut it
    blob = [(rng.gauss(0, 0.1), rng.gauss(0, 0.1), 0.0) for _ in range(80)]
    alone = [(40.0, 0.0, 0.0), (0.0, 40.0, 0.0)]
    rows = [(i, list(p)) for i, p in enumerate(ring + blob + alone)] + [(900, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    model = topics.DensityTopics(components=2, least=3, cell=1.0).fit(v)
    got = {r["id"]: (r["topic"], r["topic_probability"]) for r in model.assign(v).collect()}
    main = [got[i][0] for i in range(189)]
    assert max(main.count(t) for t in set(main)) > 170 and len({got[i][0] for i in range(189, 269) if got[i][0] >= 0}) == 1
    assert got[269] == got[270] == (-1, 0.0) and 900 not in got
    assert not ({got[i][0] for i in range(189, 269)} & set(main)) - {-1}
    model.save(str(tmp_path))
    assert topics.DensityTopics.load(str(tmp_path)).assign(v).exceptAll(model.assign(v)).isEmpty()
    assert topics.topic_features(v.select("id"), model, v).filter("id = 900 and topic = -1").count() == 1
    # Every row is noise in small cells: the cells grow until some are dense, or it is an error.
    grown = topics.DensityTopics(components=2, least=3, cell=1e-3, growth=1000.0, tries=2).fit(v)
    assert grown.cell == pytest.approx(1.0) and grown.assign(v).filter("topic >= 0").count() > 200
    with pytest.raises(ValueError):
        topics.DensityTopics(components=2, least=3, cell=1e-6, growth=1.5, tries=3).fit(v)
    with pytest.raises(ValueError):
        topics.DensityTopics().fit(v.limit(0))
