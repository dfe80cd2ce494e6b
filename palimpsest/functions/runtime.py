"""Makes this package importable in Python workers."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the workers' path, as it is on the driver's."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is chosen only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared folder; drop() removes it."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4()}"


def drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
