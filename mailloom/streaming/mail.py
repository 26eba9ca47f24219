"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailloom.functions.identifiers import bare_identifier
from mailloom.operators.deliveries import DeliveryIndex


def first_deliveries(stream: DataFrame, time: str = "received_at", late: str = "30 days") -> DataFrame:
    """One copy per identifier within the watermark; mails without an identifier all pass."""
    keyed = stream.withColumn("_key", F.coalesce(bare_identifier(F.col("message_id")), F.concat(F.lit("#"), F.col("id").cast("string"))))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def indexed_deliveries(stream: DataFrame, index: DeliveryIndex, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str = "stream"):  # noqa: ANN201
    """Micro-batches through a delivery index of any age: the sink gets each batch's new rows, with the id each replaces (null: none).

    A micro-batch that is tried again gets the rows of its first attempt, so a sink that overwrites by batch number,
    or merges by id, holds each message once. name tells the streams that share an index apart.
    """
    def batch(rows: DataFrame, number: int) -> None:
        sink(rows.join(index.ingest(rows, f"{name}_{number}"), "id"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sender_gaps(stream: DataFrame, time: str = "received_at", forget: str | None = None) -> DataFrame:
    """(sender, id, gap_seconds): time since the sender's mail before, in arrival order per micro-batch; state is one timestamp per sender.

    Mails without a sender form one group, as in the batch form. With `forget` (such as "90 days") a sender without mail
    for that long, by the watermark, is forgotten, so that the state is bounded; its next mail counts as its first.
    """
    def gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([time, "id"])
        us = rows[time].astype("datetime64[us]").astype("int64").tolist()
        before = [last, *us[:-1]]
        state.update((us[-1],))
        if span:
            state.setTimeoutTimestamp(max(us[-1] // 1000 + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"sender": [key[0]] * len(rows), "id": rows["id"].to_numpy(), "gap_seconds": [None if b is None else (u - b) // 1_000_000 for u, b in zip(us, before)]})

    span = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else 0
    rows = stream.select("sender", "id", time)
    rows = rows.withWatermark(time, "0 seconds") if span else rows
    timeout = GroupStateTimeout.EventTimeTimeout if span else GroupStateTimeout.NoTimeout
    return rows.groupBy("sender").applyInPandasWithState(gaps, "sender string, id long, gap_seconds double", "last long", "append", timeout)


def with_refreshed(load: Callable[[], object], version: Callable[[], object], score: Callable[[DataFrame, object], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A scoring function for scored_stream() that loads its model again whenever version() (such as a modification time) changes, between micro-batches."""
    held: list = [None, None]

    def scored(rows: DataFrame) -> DataFrame:
        now = version()
        if held[1] is None or now != held[0]:
            held[:] = now, load()
        return score(rows, held[1])

    return scored


def daily_distribution(stream: DataFrame, value: str, time: str = "received_at", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, value, n) of tumbling windows, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(value)).agg(F.count("*").alias("n"))


def scored_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Each micro-batch through the same function as a batch."""
    return stream.writeStream.foreachBatch(lambda rows, n: sink(score(rows), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


