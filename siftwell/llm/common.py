"""Helpers that the operators share: fixed patterns, shared storage, small sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words and pads lines, and the ASCII alphabet.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests) a folder of this machine is made and set as checkpoint folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siftwell-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/siftwell/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` or a writer made (through Hadoop's file systems)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, tag: str, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders by the columns ``by``, and read it back.

    This cuts the lineage and survives the loss of executors, unlike a cached or a
    locally checkpointed frame.
    """
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_of(base: int, least: int, most: int) -> int:
    """Smallest power of ``base`` that is at least ``least``, and ``most`` at most."""
    n = base
    while n < least and n * base <= most:
        n *= base
    return n


def count_bin(n: Column) -> Column:
    """A bin that grows with a count: itself below 1024, then 256 bins for each doubling."""
    return F.when(n < 1024, n).otherwise(1024 + F.floor((F.log2(n.cast("double")) - 10) * 256)).cast("long")


def heaviest(bins: DataFrame, most: int) -> int:
    """The least bin such that at most ``most`` entries lie in it and above, from (bin, entries).

    There are about 14,000 bins whatever the counts, so the driver gets as many rows at most;
    a sort with a limit would send ``most`` rows of every partition to it.
    """
    seen, least = 0, 1 << 62
    for b, n in bins.groupBy("bin").agg(F.sum("entries").alias("entries")).orderBy(F.col("bin").desc()).collect():
        seen += n
        if seen > most:
            break
        least = b
    return least


def each_part(rows: DataFrame, parts: int, run: Callable, schema: str) -> DataFrame:
    """``run`` (part, pandas frame) on all rows of each part (column ``part``, modulo ``parts``), each a task of its own.

    A group-by would hash the few part numbers, and give one task several parts and another none.
    """

    def whole(batches):
        held = [b for b in batches if len(b)]
        if held:
            pdf = pd.concat(held, ignore_index=True)
            yield run(int(pdf["part"].iloc[0]) % parts, pdf)

    return rows.repartitionById(parts, F.col("part") % parts).mapInPandas(whole, schema)
