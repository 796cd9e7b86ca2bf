"""Structured Streaming forms of the crawl operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import crawl
from ..sources import readers


def frontier(messages: DataFrame, whitelist: DataFrame, n_shards: int) -> DataFrame:
    """A stream of queue messages to a stream of new entries (domain, path, shard).

    The whitelist is a static table.  What was seen is state by (domain, path): it grows with
    the URLs seen, as the semantics has no end of time; on a cluster use the RocksDB provider.
    """
    entries = crawl.frontier_entries(readers.messages(messages))
    kept = entries.join(whitelist.select("domain").distinct(), "domain", "left_semi")
    return crawl.routed(kept.dropDuplicates(["domain", "path"]), n_shards)


def done_state(entries: DataFrame) -> DataFrame:
    """A stream (domain, path, done) to the state of each URL: once done, always done."""
    return entries.groupBy("domain", "path").agg(F.max("done").alias("done"))


def crawl_delay(requests: DataFrame, delay_ms: int) -> DataFrame:
    """A stream (request_id, domain, at_ms) to (request_id, domain, at_ms, release_ms).

    A domain's requests are released in order of their times, each at least ``delay_ms``
    after the one before; the last release is the domain's state, one number for each domain.
    """

    def release(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values(["at_ms", "request_id"])
        # release(i) is the largest of at(j) + (i - j) * delay over all j up to i, and of the last release before.
        step = np.arange(1, len(rows) + 1) * delay_ms
        times = rows["at_ms"].to_numpy() - step
        if state.exists:
            times[0] = max(times[0], state.get[0])
        times = np.maximum.accumulate(times) + step
        state.update((int(times[-1]),))
        yield rows.assign(release_ms=times)[["request_id", "domain", "at_ms", "release_ms"]]

    return requests.groupBy("domain").applyInPandasWithState(release, "request_id long, domain string, at_ms long, release_ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def queues(queued: DataFrame) -> DataFrame:
    """A stream (domain, path, seq) to (turn, domain, path): queues by domain that take turns.

    A domain's state is the turn it has come to and what it has queued before; a URL that is queued again is passed
    over.  All of one turn come before any of the next, whatever the domain.
    """

    def place(key, batches, state: GroupState):
        turn, known = state.get if state.exists else (0, [])
        seen, out = set(known), []
        rows = pd.concat(list(batches)).sort_values(["seq", "path"])
        for path in rows["path"]:
            if path not in seen:
                seen.add(path)
                turn += 1
                out.append((turn, key[0], path))
        state.update((turn, sorted(seen)))
        yield pd.DataFrame(out, columns=["turn", "domain", "path"])

    return queued.groupBy("domain").applyInPandasWithState(place, "turn int, domain string, path string", "turn int, known array<string>", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there and stop; a restart with the same checkpoint goes on after it."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()


def keep_done_state(entries: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there of a stream (domain, path, done) into a table of states in ``folder``.

    Only the states that a batch changes leave the query (update mode); they are merged by key into
    the table of the batch before, written as a new version, which is complete or absent.  A
    batch that is run again after a failure writes the same version.
    """

    def merge(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        before = last_version(spark, folder, batch)
        rows = changed.select("domain", "path", "done")
        if before is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/v={before}")).groupBy("domain", "path").agg(F.max("done").alias("done"))
        rows.write.mode("overwrite").parquet(f"{folder}/v={batch}")
        for old in versions(spark, folder):
            if old < batch - 1:  # two stay: the newest, and the one before it
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={old}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    done_state(entries).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions of a table of states."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [s.getPath().getName() for s in system.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and system.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def last_version(spark: SparkSession, folder: str, below: int = 1 << 62) -> int | None:
    return max((v for v in versions(spark, folder) if v < below), default=None)


def read_done_state(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version: what a restarted crawl finds."""
    schema, last = "domain string, path string, done boolean", last_version(spark, folder)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{folder}/v={last}")


def replay(state: DataFrame) -> DataFrame:
    """After a restart: what was queued and is not done."""
    return state.where(~F.col("done")).select("domain", "path")
