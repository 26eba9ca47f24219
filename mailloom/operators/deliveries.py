"""Exactly one copy of each message out of at-least-once deliveries.

An index keeps, per hash prefix, immutable runs of sorted identifier keys with the copy that was
received first. A batch is reduced locally to its best copy per identifier, looked up in the runs
by binary search, and what is novel or was received earlier becomes the next run; runs are merged
once there are more than MAX_RUNS. Keys are SHA-256 digests, so equal keys mean equal identifiers.
A copy received earlier than the one given before comes out with the id it replaces, so that a sink
can withdraw that one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.identifiers import bare_identifier
from mailloom.functions.instants import micros
from mailloom.session import scratch_path, written

MAX_RUNS = 8
KEYS_A_PREFIX = 100_000
NEVER = np.iinfo(np.int64).max  # a copy without a time comes after all that have one


class Runs:
    """Sorted runs of one prefix in memory: parallel arrays of key, received, id."""

    def __init__(self, max_runs: int = MAX_RUNS) -> None:
        self.max_runs = max_runs
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.replaced = np.array([], np.int64)  # by what absorb() returned last: the id known before, or NEVER

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, received, ids = (np.concatenate(x) for x in zip(*self.runs)) if self.runs else (np.array([], "S32"), np.array([], np.int64), np.array([], np.int64))
        order = np.lexsort((ids, received, keys))
        keys, received, ids = keys[order], received[order], ids[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.runs = [(keys[first], received[first], ids[first])]
        return self.runs[0]

    def absorb(self, keys: np.ndarray, received: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes a batch with one copy per key; returns what was new or received earlier than the copy known."""
        order = np.argsort(keys, kind="stable")
        keys, received, ids = keys[order], received[order], ids[order]
        best, before = np.full(len(keys), NEVER), np.full(len(keys), NEVER)
        known = np.zeros(len(keys), bool)
        for run_keys, run_received, run_ids in self.runs:
            at = np.minimum(np.searchsorted(run_keys, keys), len(run_keys) - 1)
            if len(run_keys):
                hit = run_keys[at] == keys
                better = hit & (~known | (run_received[at] < best) | ((run_received[at] == best) & (run_ids[at] < before)))
                best[better], before[better] = run_received[at][better], run_ids[at][better]
                known |= hit
        wanted = ~known | (received < best) | ((received == best) & (ids < before))
        new = (keys[wanted], received[wanted], ids[wanted])
        self.replaced = np.where(known, before, NEVER)[wanted]
        if len(new[0]):
            self.runs.append(new)
            if len(self.runs) > self.max_runs:
                self.merge()
        return new


RUN_SCHEMA = "prefix long, key binary, received long, id long, replaces long"


def _rows(prefix: int, keys: np.ndarray, received: np.ndarray, ids: np.ndarray, replaces: np.ndarray | None = None) -> pd.DataFrame:
    known = pd.array([None] * len(keys) if replaces is None else [None if r == NEVER else int(r) for r in replaces], "Int64")
    return pd.DataFrame({"prefix": prefix, "key": [k.ljust(32, b"\0") for k in keys.tolist()], "received": received, "id": ids, "replaces": known})


def _sorted_run(path: str, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The sorted arrays that a finished run holds of one prefix; only that folder is read."""
    fs, root = pafs.FileSystem.from_uri(path)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/prefix={prefix}", allow_not_found=True)) if f.path.endswith(".parquet")]
    if not files:
        return None
    rows = pa.concat_tables([pq.read_table(f, columns=["key", "received", "id"], filesystem=fs, partitioning=None) for f in sorted(files)])
    keys = np.array(rows["key"].to_pylist(), "S32")
    order = np.argsort(keys, kind="stable")  # in order already, but for a run of several files
    return keys[order], rows["received"].to_numpy()[order], rows["id"].to_numpy()[order]


def _batches(arrivals: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    keys = np.array(arrivals["key"].tolist(), "S32")
    received, ids, batch = (arrivals[c].to_numpy(np.int64) for c in ("received", "id", "batch"))
    order = np.argsort(batch, kind="stable")
    cuts = np.flatnonzero(np.diff(batch[order])) + 1
    for at in np.split(order, cuts):
        yield keys[at], received[at], ids[at]


class DeliveryIndex:
    """The index as a folder of immutable runs: parquet tables of RUN_SCHEMA in folders by prefix, sorted by key.

    A run is written under another name and renamed when it is whole, so one that died leaves nothing that counts.
    Its name says its place in the order, the number of prefixes, whether it merges all before it, and the label of
    the batch it came from: the same label again returns what the first attempt added. The number of prefixes is the
    index's own; it grows when runs are merged (the prefix is a function of the key alone).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, prefixes: int = 64, max_runs: int = MAX_RUNS, keys_a_prefix: int = 8 * KEYS_A_PREFIX) -> None:
        self.spark, self.path, self.max_runs, self.keys_a_prefix = spark, path or scratch_path(spark, "deliveries"), max_runs, keys_a_prefix
        held = self.runs()
        self.prefixes = int(held[-1].split("-")[-3]) if held else prefixes  # an index that has runs keeps its own number

    def _fs(self) -> tuple:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _finished(self) -> list[str]:
        fs, path = self._fs()
        return sorted(str(s.getPath().toString()) for s in fs.globStatus(path(f"{self.path}/run-*")) or [])

    def runs(self) -> list[str]:
        """The finished runs that count, oldest first: the last merged one and all after it."""
        every = self._finished()
        merged = [i for i, r in enumerate(every) if r.split("-")[-2] == "merged"]
        return every[merged[-1] :] if merged else every

    def _next(self) -> int:
        every = self._finished()
        return int(every[-1].split("-")[-4]) + 1 if every else 0

    def _write(self, rows: DataFrame, kind: str, label: str) -> str:
        """rows of RUN_SCHEMA, whole prefixes per task, as the next run. A lost race for a place in the order raises."""
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("prefix", "key").write.partitionBy("prefix").parquet(part)
        path = f"{self.path}/run-{self._next():09d}-{self.prefixes}-{kind}-{label}"
        fs, at = self._fs()
        if not fs.rename(at(part), at(path)):
            raise OSError(f"can't finish {path}")
        return path

    def stored(self) -> DataFrame:
        return self._read(self.runs())

    def _read(self, runs: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(RUN_SCHEMA).parquet(r) for r in runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], RUN_SCHEMA)

    def winners(self) -> DataFrame:
        """key, received and id of the copy kept, per identifier."""
        return self.stored().groupBy("key").agg(F.min(F.struct("received", "id")).alias("w")).select("key", "w.received", "w.id")

    def _prefix(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.prefixes))

    def arrivals(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Best copy per identifier and batch, combined before the shuffle, so a hot identifier is no hot group."""
        known = rows.select(bare_identifier(F.col("message_id")).alias("i"), "id", micros(rows, "received_at").alias("r"), (F.coalesce(F.col(batch), F.lit(-1)) if batch else F.lit(0)).cast("long").alias("batch")).filter("i is not null")
        received = F.coalesce("r", F.lit(int(NEVER)))
        best = known.groupBy("i", "batch").agg(F.min(F.struct(received.alias("received"), "id")).alias("b"))
        keyed = best.select(F.unhex(F.sha2("i", 256)).alias("key"), "batch", "b.received", "b.id")
        return keyed.select(self._prefix(F.col("key")).alias("prefix"), "*")

    def bulk_load(self, rows: DataFrame, batch: str) -> DataFrame:
        """Replays all batches in order, prefix by prefix in parallel, into the first run of an empty index; returns the winners' ids."""
        if self.runs():
            raise ValueError("a bulk load needs an empty index")
        max_runs = self.max_runs

        def replay(arrivals: pd.DataFrame) -> pd.DataFrame:
            runs = Runs(max_runs)
            for one in _batches(arrivals):
                runs.absorb(*one)
            return _rows(int(arrivals["prefix"].iloc[0]), *runs.merge())

        path = self._write(self.arrivals(rows, batch).groupBy("prefix").applyInPandas(replay, RUN_SCHEMA), "merged", "bulk")
        return self._read([path]).select("id")

    def ingest(self, rows: DataFrame, label: str | None = None) -> DataFrame:
        """Takes one batch; returns (id, replaces): what it adds, and the id of the copy given before that an earlier-received one takes the place of (null: a new identifier).

        Only the batch is shuffled; each task reads its prefix's arrays and searches them. label (letters, digits and
        underscores) names the batch: a retry returns what its first attempt added, though the index knows it by now.
        """
        label = label or uuid.uuid4().hex
        if not re.fullmatch(r"\w+", label):
            raise ValueError(f"no label: {label!r}")
        done = [r for r in self._finished() if r.split("-")[-2] == "batch" and r.endswith(f"-{label}")]
        if not done:
            held = self.runs()

            def look_up(arrivals: pd.DataFrame) -> pd.DataFrame:
                prefix = int(arrivals["prefix"].iloc[0])
                runs = Runs(len(held) + 1)
                runs.runs = [r for h in held if (r := _sorted_run(h, prefix))]
                (batch,) = _batches(arrivals)
                return _rows(prefix, *runs.absorb(*batch), runs.replaced)

            done = [self._write(self.arrivals(rows).groupBy("prefix").applyInPandas(look_up, RUN_SCHEMA), "batch", label)]
        if len(self.runs()) > self.max_runs:
            self.merge()
        return self._read(done).select("id", "replaces")

    def merge(self) -> str:
        """Merges all runs into one, with more prefixes where they have grown too large, and removes what it merged but the last run, which a caller may still read or retry."""
        every = self._finished()
        best = self.winners().withColumn("replaces", F.lit(None).cast("long"))
        self.prefixes *= max(1, -(-best.count() // (self.prefixes * self.keys_a_prefix)))
        placed = best.select(self._prefix(F.col("key")).alias("prefix"), "*")
        path = self._write(placed.repartition("prefix"), "merged", "all")
        fs, at = self._fs()
        for run in every[:-1]:
            fs.delete(at(run), True)
        return path


def redundant_deliveries(emails: DataFrame, index: DeliveryIndex | None = None) -> DataFrame:
    """id of each e-mail to drop, so that every identifier keeps the copy received first (ties: smallest id).

    E-mails without an identifier (null, empty, blank) are never dropped. A copy without received_at
    comes after all that have one. batch_no may be null (such rows count as the first batch); rows with
    an equal id count as one row. An empty table gives no rows; extra columns are ignored.
    """
    if index is None:
        prefixes = max(16, -(-emails.count() // KEYS_A_PREFIX))
        index = DeliveryIndex(emails.sparkSession, prefixes=prefixes)
    kept = index.bulk_load(emails, "batch_no")
    # Anti-join on the unique id, not on the identifier: no identifier can make a task hot.
    held = emails.filter(bare_identifier(F.col("message_id")).isNotNull()).select("id")
    return held.join(kept, "id", "left_anti").distinct()


def replayed(emails: DataFrame, batch: str = "batch_no", index: DeliveryIndex | None = None, loads: int = 8) -> DataFrame:
    """id of each e-mail kept when the batches come through the index in their order, in `loads` loads of successive batches, each load's additions applied to a sink; null batches come first.

    What the sink holds in the end is what was added less what was replaced.
    """
    index = index or DeliveryIndex(emails.sparkSession)
    numbers = [r[0] for r in emails.select(F.col(batch).cast("long")).distinct().sort(F.asc_nulls_first(batch)).collect()]  # one per batch
    size = max(1, -(-len(numbers) // loads))
    added = []
    for k in range(0, len(numbers), size):
        part = numbers[k : k + size]
        inside = F.col(batch).isin([n for n in part if n is not None]) | (F.col(batch).isNull() if part[0] is None else F.lit(False))
        added.append(written(index.ingest(emails.filter(inside)), "added"))  # a later merge removes the run
    if not added:
        return emails.select("id").limit(0)
    every = reduce(DataFrame.unionByName, added)
    gone = every.filter("replaces is not null").select(F.col("replaces").alias("id"))
    return every.select("id").join(gone, "id", "left_anti")


def exactly_once(emails: DataFrame) -> DataFrame:
    """The e-mails without the redundant deliveries; all columns stay."""
    return emails.join(redundant_deliveries(emails), "id", "left_anti")
