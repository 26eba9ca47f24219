"""Sources, streaming and the end-to-end flows."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from mailloom import pipelines
from mailloom.config import EngineConfig
from mailloom.operators.deliveries import DeliveryIndex
from mailloom.sources import files
from mailloom.sources.rest import PagedRest
from mailloom.streaming import mail as streams

ROWS = [{"id": i, "message_id": f"m{i}", "from": f"u{i}@x.test", "date": "d", "subject": "s", "body": None} for i in range(25)]


@pytest.fixture(scope="module")
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path.startswith("/stats"):
                out = {"total_emails": len(ROWS)}
            else:
                q = dict(p.split("=") for p in self.path.split("?")[1].split("&"))
                out = ROWS[int(q["offset"]) : int(q["offset"]) + int(q["limit"])]
            body = json.dumps(out).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_rest_pages(spark, server):
    spark.dataSource.register(PagedRest)
    df = spark.read.format("pagedrest").option("url", server).option("page", "10").load()
    assert df.count() == 25 and df.rdd.getNumPartitions() == 3 and df.filter("id = 3").first()["sender"] == "u3@x.test"


def test_rest_stream_resumes(spark, server, tmp_path):
    spark.dataSource.register(PagedRest)

    def run():
        q = spark.readStream.format("pagedrest").option("url", server).option("page", "10").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 25 == run()


def test_files(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    files.save(df, f"{p}/t.parquet")
    assert files.table(spark, f"{p}/t.parquet", "x").columns == ["x"] and files.existing(f"{p}/t.csv") == f"{p}/t.parquet"
    files.save_csv(df.limit(0), f"{p}/empty")
    assert spark.read.text(f"{p}/empty").first()[0] == "id,x"
    files.save_json(df, f"{p}/j")
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex/one.csv").write_text("prototype,source,similarity\nnow,Seed,1\n")
    (tmp_path / "lex/none.csv").write_text("")
    assert [(r["lexicon"], r["prototype"]) for r in files.lexicon_folder(spark, f"{p}/lex").collect()] == [("one", "now")]
    (tmp_path / "s.csv").write_text("thanks\nNA\n")
    assert [r[0] for r in files.plain_lines(spark, f"{p}/s.csv", "term").collect()] == ["thanks", "NA"]
    assert files.resumed(spark, df, f"{p}/chunks") == 2 and files.resumed(spark, df, f"{p}/chunks") == 0
    (tmp_path / "r.json").write_text('{"id": 1, "from": "a@b.test", "unknown": 3}\n')
    assert files.records(spark, f"{p}/r.json").first()["sender"] == "a@b.test"
    (tmp_path / "bad.json").write_text("{nope\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.records(spark, f"{p}/bad.json").collect()
    assert [r["_corrupt_record"] for r in files.records(spark, f"{p}/bad.json", strict=False).collect()] == ["{nope"]


def mails(spark, n=160):
    rows = [(i, f"<k{i - i % 5 if i % 5 == 1 else i}>", f"u{i % 7}@x{i % 3}.test", ("RE: " if i % 4 == 0 else "") + f"topic {i % 9}", f"please price the invoice {i}." if i % 2 else f"maintenance notice {i} for the desk.", ["a@b.test"], None, None, "f", i) for i in range(n)]
    return spark.createDataFrame(rows, "id long, message_id string, sender string, subject string, body string, to_list array<string>, cc_list array<string>, bcc_list array<string>, x_folder string, batch_no int").withColumn("received_at", F.timestamp_seconds(F.col("id") * 100))


def stream(spark, df, path, parts=3):
    for k in range(parts):
        df.filter(F.col("id") % parts == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams(spark, tmp_path):
    df = mails(spark, 60)
    s = stream(spark, df, f"{tmp_path}/in")
    q = streams.first_deliveries(s).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("firsts").count() == df.select("message_id").distinct().count()
    seen = []
    q = streams.indexed_deliveries(s, DeliveryIndex(spark, prefixes=2), lambda rows, _: seen.extend(r["message_id"] for r in rows.collect()), f"{tmp_path}/cp")
    q.awaitTermination(90)
    assert set(seen) == {r[0] for r in df.select("message_id").distinct().collect()}
    q = streams.sender_gaps(s).writeStream.format("memory").queryName("gaps").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("gaps").count() == 60 and spark.table("gaps").filter("gap_seconds is null").count() == 21
    q = streams.daily_distribution(s, "x_folder", window="1 hour").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("days").agg(F.sum("n")).first()[0] == 60


def test_flow(spark, tmp_path):
    p = str(tmp_path)
    gold = spark.createDataFrame([(f"<k{i}>", i % 2) for i in range(0, 60, 2)] + [("<k3>", 1), ("<k3>", 1), ("<k5>", None)], "message_id string, gold_labels int")
    data = pipelines.build_dataset(mails(spark), gold, p)
    assert data.count() == 128 and data.groupBy("thread_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    train = spark.read.parquet(f"{p}/train.parquet")
    config = EngineConfig(folds=2, iterations=20, label_trials=2, min_samples=5)
    done, models = pipelines.train(train, f"{p}/model", config)
    assert done.count() == train.count() and {"fold", "cv_proba", "proba", "pred", "threshold"} <= set(done.columns)
    loaded = pipelines.Models.load(f"{p}/model")
    assert loaded.features == models.features and loaded.threshold == models.threshold
    scored = pipelines.score(spark.read.parquet(f"{p}/test.parquet"), loaded, config)
    assert scored.filter("urgent = (proba >= threshold)").count() == scored.count() > 0
    metrics = pipelines.evaluate(pipelines.score(train, models, config), gold, p)
    assert 0 <= metrics["f1"] <= 1
    rows = done.select("_ordinal", "message_id", "body", "pred", "proba", "topic", "topic_probability")
    snap = pipelines.watch(rows, f"{p}/watch", config=config)
    assert snap["sample_size"] == rows.count() and json.loads((tmp_path / "watch/snapshot.json").read_text())["review_queue_size"] >= 0
    with pytest.raises(FileNotFoundError):
        pipelines.Models.load(f"{p}/nothing")
    assert pipelines.health(spark)["status"] == "ok"


def test_entry_without_the_llm_package(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module
    monkeypatch.setattr(entry.importlib, "import_module", lambda m: (_ for _ in ()).throw(ModuleNotFoundError(name=m)) if m.startswith("mailloom.llm") else real(m))
    names = set(entry.queries())
    assert "p1_found" in names and "p3_found" not in names and set(entry.oracle_sql()) <= names


def test_gaps_of_mails_without_a_sender_and_bounded_state(spark, tmp_path):
    rows = [(1, None, "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:00:07"), (3, "a", "2024-01-01 00:00:01"), (4, "a", "2024-01-01 00:00:05")]
    spark.createDataFrame(rows, "id long, sender string, t string").select("id", "sender", F.col("t").cast("timestamp").alias("received_at")).write.parquet(f"{tmp_path}/in")
    for name, forget in (("gaps_all", None), ("gaps_bounded", "90 days")):
        s = spark.readStream.schema("id long, sender string, received_at timestamp").parquet(f"{tmp_path}/in")
        streams.sender_gaps(s, forget=forget).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        assert {(r["id"], r["gap_seconds"]) for r in spark.table(name).collect()} == {(1, None), (2, 7.0), (3, None), (4, 4.0)}


def test_a_model_is_loaded_again_when_its_version_changes():
    versions, loads = iter([1, 1, 2, 2]), []
    scored = streams.with_refreshed(lambda: loads.append(1) or len(loads), lambda: next(versions), lambda rows, model: (rows, model))
    assert [scored(k) for k in range(4)] == [(0, 1), (1, 1), (2, 2), (3, 2)]


def test_scoring_gives_silver_labels_or_zero(spark, tmp_path, caplog):
    from mailloom import pipelines
    from mailloom.operators.lexicon import hashed_embedding, seed_lexicon
    from mailloom.operators.weak import LabelModel, labelling_functions
    from mailloom.sources.files import save

    lexicon = seed_lexicon(spark)
    save(lexicon, f"{tmp_path}/lexicon.parquet")
    mail = spark.createDataFrame([(1, "Urgent", "please send the invoice"), (2, "x", "nothing")], "_ordinal long, subject string, body string")
    vectors = pipelines.embedded(mail.select(F.col("_ordinal").alias("id"), F.col("body").alias("t")), "t").select("id", "embedding")
    names = list(labelling_functions(lexicon))
    model = LabelModel(names, [[[0.6, 0.2], [0.2, 0.6]]] * len(names))
    models = pipelines.Models(str(tmp_path), model, None, ["a"], 0.5)
    got = {r["_ordinal"]: r["silver_label"] for r in pipelines.silver_labels(mail, vectors, models, hashed_embedding).collect()}
    assert got == {1: 1, 2: 0} and "no silver labels" not in caplog.text
    broken = pipelines.Models(str(tmp_path / "none"), model, None, ["a"], 0.5)
    assert {r["silver_label"] for r in pipelines.silver_labels(mail, vectors, broken, hashed_embedding).collect()} == {0} and "no silver labels" in caplog.text
    with pytest.raises(ValueError):
        pipelines.score(mail, pipelines.Models(str(tmp_path), model, None, [], 0.5))
