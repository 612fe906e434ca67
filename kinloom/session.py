"""Session settings and durable intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "kinloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster `master` stays None (spark-submit decides) and the shuffle
    partition count is the cluster's own; AQE coalesces small partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediates: `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="kinloom-")
        context.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once to the workspace and read it back.

    Cuts the lineage like a checkpoint, but computes the plan only once and
    keeps the columnar form, so later readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """One run's intermediate tables: a name that is written again replaces what it held.

    Iterations alternate between two names, so a run keeps a fixed number of tables
    however many rounds it takes. `clear` empties the tables that nobody reads any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: dict[str, DataFrame] = {}

    def put(self, df: DataFrame, name: str, compression: str = "none") -> DataFrame:
        """Plain by default: keys and hashes hardly compress, and codecs hold memory outside the heap."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        self.held[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.held[name]

    def clear(self, keep: tuple[str, ...] = ()) -> None:
        for name in [n for n in self.held if n not in keep]:
            empty = self.spark.createDataFrame([], self.held.pop(name).schema)
            empty.write.mode("overwrite").parquet(f"{self.folder}/{name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
