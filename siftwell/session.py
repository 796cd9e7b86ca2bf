"""Session factory with the settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "siftwell", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster leave ``master`` to spark-submit.

    shuffle_partitions: leave None on a cluster that sets its own (a few for each core of
    the cluster, so that a partition stays near 128 MB).
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings | conf).getOrCreate()
