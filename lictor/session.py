"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that a session for this library should be built with: skewed shuffle partitions are split at run time even
# when that costs one more exchange, and small partitions are merged. Operators and queries change no setting themselves.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """For programs that own their session."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: the session's own setting, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="lictor-checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write an iteration's state to the shared folder and read it back.

    The plan starts anew, a lost executor costs one round, and the planner sees the true size of the state. A
    checkpointed DataFrame would keep the size estimate of the plan behind it, which grows with every joined round.
    """
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/lictor/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Rounds:
    """States of one iteration: once a round is written, the table of the round before last is deleted."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        table, path = _written(df)
        self.paths.append(path)
        if len(self.paths) > 2:
            old = df.sparkSession._jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            old.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(old, True)
        return table
