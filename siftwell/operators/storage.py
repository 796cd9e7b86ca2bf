"""Tables in the folder that the driver and all executors share: cut lineage, kept results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one of this machine only where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siftwell-")
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/siftwell/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: for tables that a plan uses more than once."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: a checkpoint on shared storage, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
