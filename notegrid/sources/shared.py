"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where a local
    session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="notegrid-")
    spark.sparkContext.setCheckpointDir(base)
    return shared_dir(spark)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/notegrid-tables/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that rounds over it
    neither repeat what made it nor depend on the executor that did. Its files are
    many times smaller than its rows, and Spark goes by the files, so its joins
    are asked to be sorted ones: none broadcasts it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
