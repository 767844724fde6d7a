"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles that feed Python groups still use all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Stage tables written so far, in the order of writing.
_STAGES: list[str] = []


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app: str = "roomfold", driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false") \
        .config("spark.ui.showConsoleProgress", "false")
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(master: str, configured: str | None) -> str:
    """The folder for stage tables: the configured one, or a temporary one on a local master only.

    Anywhere else executors would write to disks of their own, so a missing setting is an error.
    """
    if configured:
        return configured
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="spark-roomfold-")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    context.setCheckpointDir(shared_folder(context.master, configured))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise an iterative intermediate as a table in the shared checkpoint folder.

    A written table drops both the lineage and the constraints the optimizer would carry
    from round to round, and later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = stage_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """``cut`` for tables that grow with the input: joins with them are merged.

    Rows take many times the bytes of their compressed files, by which the optimizer would have the driver broadcast them.
    """
    return cut(df).hint("merge")


def fresh(df: DataFrame) -> DataFrame:
    """Same columns under new identities, so two tables of one origin can be cogrouped."""
    return df.select(*[df[c].alias(c) for c in df.columns])


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stage table beneath the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGES.append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Delete the stage tables of this driver; results that still read from them must have been written before."""
    gone = 0
    while _STAGES:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        gone += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return gone
