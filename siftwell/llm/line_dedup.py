r"""Line dedup [native].

Every text is split at \n; a line's key is the line without ``[\x20\x09-\x0D]`` at both
ends and with A-Z lower-cased.  Keys of at least ``min_chars`` code points are exploded
with their positions as a 128-bit hash, distinct documents are counted for each hash, and
hashes in at least ``min_docs`` documents lose all their lines except in the largest id
that holds them.  The other lines are put together again by position.

Only (hash, id, position) is shuffled on the hash; documents are dealt into runs by a hash
of their id, counts are made for each run first, and the verdict goes back through (run,
hash), so that a line of a third of all documents is spread over all runs.  The text moves
once, on the id, to meet the positions that it loses.

Defined results
- null or empty text: one empty line, none dropped.
- Rows that repeat a doc_id count as one document; each row gets its own result.
- Rows with null doc_id neither count as documents nor lose lines.
- Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, power_of, shuffle_width, stored

KEY = ["k1", "k2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, most_runs: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_text."""
    spark = docs.sparkSession
    runs = power_of(4, max(64, shuffle_width(spark)), most_runs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    key = F.btrim(F.col("line"), F.lit(WHITE))
    lines = (
        rows.where("doc_id is not null")
        .select("doc_id", F.xxhash64("t").alias("h"), F.posexplode(split_lines(ascii_lower(F.col("t")))).alias("pos", "line"))
        .select("doc_id", "h", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "h", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))
        .withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))
    )
    lines = stored(lines, "line-keys")
    by_run = lines.groupBy("run", *KEY).agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    total = by_run.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs).select(*KEY, "last")
    verdict = by_run.select("run", *KEY).join(total, KEY)
    lost = (
        lines.join(verdict, ["run", *KEY])
        .where(F.col("doc_id") != F.col("last"))
        .groupBy("doc_id", "h")
        .agg(F.collect_set("pos").alias("lost"))
    )
    whole = rows.select("doc_id", "t", F.xxhash64("t").alias("h")).join(lost, ["doc_id", "h"], "left")
    parts = split_lines(F.col("t"))
    n_lines = F.size(parts)
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("parts"), i)), "\n"))
    return whole.withColumn("parts", parts).select(
        "doc_id",
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
