"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What this process has written there, for clear_scratch(); and the temporary folder of each local session.
SCRATCH: list[str] = []
LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or its checkpoint folder. Without either a temporary one where all
    runs in one process, as in tests; on a cluster that would lose data, so it is an error there."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    session = spark.sparkContext.applicationId
    if session not in LOCAL:
        LOCAL[session] = tempfile.mkdtemp(prefix="driftloom-")
    return LOCAL[session]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, kept in mind for clear_scratch()."""
    SCRATCH.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what was written for results that are no longer needed: intermediate tables, streams and their output."""
    jvm = spark.sparkContext._jvm
    while SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back with its schema known."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
