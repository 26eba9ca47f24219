"""The delivery index against a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from mailloom.operators.deliveries import DeliveryIndex, exactly_once, redundant_deliveries, replayed

SCHEMA = "id long, message_id string, received long, batch_no int, extra string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("received_at", F.timestamp_micros("received")).drop("received")


def brute(rows):
    best = {}
    for i, m, r, *_ in rows:
        k = (m or "").strip().strip("<>").strip()
        if k:
            best.setdefault(k, []).append((float("inf") if r is None else r, i))
    return {i for v in best.values() for _, i in sorted(v)[1:]}


def rows(n, seed=1):
    rng = random.Random(seed)
    ids = [None, "", "  ", "<>", "hot"] + [f"k{i}" for i in range(n // 4)]
    out = []
    for i in range(n):
        m = rng.choice(ids) if rng.random() > 0.33 else "hot"
        m = rng.choice(["{}", "<{}>", " <{}> ", "{} "]).format(m) if m else m
        out.append((i, m, rng.choice([None, rng.randrange(50)]), rng.choice([None, rng.randrange(9)]), "x"))
    return out


def test_drops_all_but_the_first(spark):
    data = rows(600)
    assert {r[0] for r in redundant_deliveries(table(spark, data)).collect()} == brute(data)


def test_batches_one_after_another(spark):
    data = rows(400, 2)
    index = DeliveryIndex(spark, prefixes=3, max_runs=2)
    for b in range(5):
        index.ingest(table(spark, [r for r in data if r[0] % 5 == b]))
    kept = {r["id"] for r in index.winners().collect()}
    with_key = {i for i, m, *_ in data if (m or "").strip().strip("<>").strip()}
    assert with_key - kept == brute(data)
    assert len(index.runs()) <= 4


def test_a_batch_returns_only_what_is_new(spark):
    index = DeliveryIndex(spark, prefixes=2)
    first = table(spark, [(1, "a", 5, 0, ""), (2, "b", 5, 0, "")])
    assert {r[0] for r in index.ingest(first).collect()} == {1, 2}
    again = table(spark, [(3, "<a>", 9, 1, ""), (4, "b", 1, 1, ""), (5, "c", 1, 1, "")])
    assert {r[0] for r in index.ingest(again).collect()} == {4, 5}


def pairs(df):
    return {(r["id"], r["replaces"]) for r in df.collect()}


def test_an_earlier_copy_replaces_the_one_given_before(spark):
    index = DeliveryIndex(spark, prefixes=2, max_runs=1)
    assert pairs(index.ingest(table(spark, [(1, "a", 5, 0, ""), (2, "b", 5, 0, "")]))) == {(1, None), (2, None)}
    assert pairs(index.ingest(table(spark, [(3, "a", 4, 1, ""), (4, "b", 6, 1, "")]))) == {(3, 1)}
    assert pairs(index.ingest(table(spark, [(5, "a", 1, 2, ""), (6, "b", 1, 2, "")]))) == {(5, 3), (6, 2)}
    data = rows(300, 7)
    kept = {r[0] for r in replayed(table(spark, data), index=DeliveryIndex(spark, prefixes=3, max_runs=2)).collect()}
    with_key = {i for i, m, *_ in data if (m or "").strip().strip("<>").strip()}
    assert with_key - kept == brute(data)


def test_a_retried_batch_gets_its_rows_again(spark):
    index = DeliveryIndex(spark, prefixes=2, max_runs=1)
    batch = table(spark, [(1, "a", 5, 0, ""), (2, "b", 5, 0, "")])
    assert pairs(index.ingest(batch, "s_0")) == pairs(index.ingest(batch, "s_0")) == {(1, None), (2, None)}
    later = table(spark, [(3, "a", 9, 0, ""), (4, "c", 5, 0, "")])
    assert pairs(index.ingest(later, "s_1")) == pairs(DeliveryIndex(spark, index.path).ingest(later, "s_1")) == {(4, None)}
    with pytest.raises(ValueError):
        index.ingest(later, "a-b")


def test_reopening_keeps_the_number_of_prefixes_and_ignores_dead_runs(spark):
    index = DeliveryIndex(spark, prefixes=5)
    index.ingest(table(spark, [(i, f"k{i}", 5, 0, "") for i in range(40)]))
    fs, at = index._fs()
    fs.mkdirs(at(f"{index.path}/part-dead/prefix=0"))  # what a died run leaves
    again = DeliveryIndex(spark, index.path, prefixes=3)
    assert again.prefixes == 5
    assert pairs(again.ingest(table(spark, [(100 + i, f"k{i}", 6, 0, "") for i in range(41)]))) == {(140, None)}
    small = DeliveryIndex(spark, index.path, max_runs=1, keys_a_prefix=2)
    assert pairs(small.ingest(table(spark, [(200, "k200", 6, 0, "")]))) == {(200, None)} and small.prefixes == 25  # merged into more prefixes
    assert pairs(DeliveryIndex(spark, index.path).ingest(table(spark, [(300 + i, f"k{i}", 7, 0, "") for i in range(42)]))) == {(341, None)}


def test_edges(spark):
    assert redundant_deliveries(table(spark, []).limit(0)).count() == 0
    data = [(1, "a", 3, 0, None), (2, "A", 3, 0, None), (3, "a", 3, 0, None), (4, None, None, None, None)]
    assert {r[0] for r in redundant_deliveries(table(spark, data)).collect()} == {3}
    kept = exactly_once(table(spark, data))
    assert {r["id"] for r in kept.collect()} == {1, 2, 4} and "extra" in kept.columns


def test_zoneless_times_do_not_depend_on_the_session(spark):
    """Two readings that New York's clock skips or shows twice keep their order."""
    rows = [(1, "a", "2024-03-10 02:45:00"), (2, "a", "2024-03-10 03:15:00"), (3, "b", "2024-03-10 03:15:00.000001"), (4, "b", "2024-03-10 02:59:59.5")]
    df = spark.createDataFrame(rows, "id long, message_id string, t string").select("id", "message_id", F.col("t").cast("timestamp_ntz").alias("received_at"), F.lit(0).alias("batch_no"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert {r[0] for r in redundant_deliveries(df).collect()} == {2, 3}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
