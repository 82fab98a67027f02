"""Session settings and the shared scratch area that cuts lineage between steps."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []


def session(app: str = "lacuna", master: str | None = None, input_bytes: int | None = None,
            **conf: str) -> SparkSession:
    """A session with adaptive execution on and shuffles sized from the input.

    ``input_bytes`` is the size of the data to be read; a shuffle partition then holds about
    128 MB. Without it the deployment's own setting is kept.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.dataFrameQueryContext.enabled": "false",
    }
    if input_bytes:
        settings["spark.sql.shuffle.partitions"] = str(max(8, -(-input_bytes // (128 << 20))))
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on a cluster a
    machine-local folder would not be visible to the executors, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="lacuna-"))
        return _LOCAL_ROOT[0]
    raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")


def read(seen: Observation, df: DataFrame, wanted: list[Column]) -> dict:
    """What a finished job observed; if nothing, the same aggregates of ``df`` by a job of their own.

    Adaptive execution replaces the stages above an empty shuffle by an empty relation, and the observation is
    gone with them.
    """
    try:
        return seen.get
    except Py4JJavaError:
        return df.agg(*wanted).first().asDict()


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts that nothing refers to; else they stay until the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Parquet tables below the checkpoint folder, one folder per run.

    Every table is written once and read back, so a plan never grows over the iterations and a
    lost executor costs a re-read, not a recomputation of earlier iterations.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/lacuna/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_observed(self, df: DataFrame, name: str, keep: list[str] | None = None,
                       **metrics: str) -> tuple[DataFrame, dict]:
        """Write a table, or its ``keep`` columns, and collect SQL aggregates in the same job."""
        seen = Observation()
        wanted = [F.expr(sql).alias(key) for key, sql in metrics.items()]
        observed = df.observe(seen, *wanted)
        table = self.write(observed.select(*keep) if keep else observed, name)
        return table, read(seen, df, wanted)

    def drop(self, *names: str) -> None:
        """Free tables that a later step has replaced."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
