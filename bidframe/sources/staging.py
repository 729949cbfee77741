"""Tables written once and read by several later steps."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Only a local session, as in tests, may do without; there it is a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="bidframe-"))
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps don't run its plan again."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, fmt: str) -> str:
    """The folder in shared storage that ``df`` was written to, in a format with a header where it has one."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path
