"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine a temporary one where that is unset."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        top = f"file://{tempfile.mkdtemp(prefix='sparkveil-')}"
        context.setCheckpointDir(top)
    return f"{str(top).rstrip('/')}/sparkveil-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Written and read again: the work is done once, and lost executors do not repeat it."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``shared_folder`` named, once what was read from it has been written."""
    if "/sparkveil-" not in folder:
        raise ValueError(f"not a folder of ours: {folder}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
