"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's session is used instead."""
    builder = SparkSession.builder.master(master).appName("mailloom")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder; a local session without either gets an own one.

    A cluster without a shared folder is refused: a folder of the driver's machine would lose what executors write.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="mailloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/mailloom/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of the shared folder; frames that still read them fail afterwards."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mailloom")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores, for work that is heavy per row; a table of enough files isn't moved."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


class Documents:
    """Small texts (model settings, thresholds) in a folder of any file system Spark knows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _at(self, name: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def write(self, name: str, text: str) -> None:
        """Written under another name first, so that a reader never sees half a document."""
        fs, part = self._at(f".{name}.{uuid.uuid4().hex[:8]}")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, at = self._at(name)
        fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"can't write {at.toString()}")

    def read(self, name: str) -> str:
        """Raises FileNotFoundError if there is none."""
        fs, at = self._at(name)
        if not fs.exists(at):
            raise FileNotFoundError(at.toString())
        lines = self.spark._jvm.org.apache.commons.io.IOUtils
        stream = fs.open(at)
        try:
            return lines.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        fs, at = self._at(name)
        return bool(fs.exists(at))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
