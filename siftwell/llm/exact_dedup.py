"""Exact dedup by a tree merge of sorted digest runs [native].

Documents are dealt into ``R = fan_in ** k`` runs by a hash of their id.  Each run is sorted
by digest and reduced to one entry for each distinct text in a single pass over it.  In round
``j`` the runs of ``fan_in`` neighbours are exchanged and merged: the nodes of such a
neighbourhood split the digest space among them (recursive halving), so every round keeps
``R`` nodes busy, and after ``k`` rounds one entry for each text is left.  A node sorts what it
has got from its neighbours by digest and merges equal neighbours in one pass, in constant
memory (a sort aggregate; Spark spills a sort, and a run of any length passes through).  A text that a third of all documents share
arrives at a merge at most ``fan_in`` times, never row by row.  The survivors go back down
in two joins, text to run and run to document, so that no join key is hotter than one run.

Defined results
- null text counts as empty; all empty texts are equal.
- An entry is verified at every level: entries merge only if SHA-256, length in bytes and
  an independent 64-bit hash all agree.
- Rows that repeat one doc_id with the same text each get a row, count in ``group_size``
  and share ``kept``; a null doc_id sorts below all others, and a text held only under
  null ids keeps them (``keep_id`` null, ``kept`` true).
- Other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, power_of, shuffle_width, stored

KEY = ["sha", "n_bytes", "alt"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, n_bytes, alt): what identifies a text after lower-casing A-Z."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("sha"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("alt"))


def merged_run(entries: DataFrame, keys: list[str], last: Column, n: Column) -> DataFrame:
    """One entry for each text of a run, by a pass over the run in the order of ``keys``.

    The id travels in a struct: Spark merges values of such a type in sorted order only, not
    in a hash table, so the sort by digest is part of the plan.
    """
    found = entries.groupBy(*keys).agg(F.max(F.struct(last.alias("id"))).alias("last"), F.sum(n).alias("n"))
    return found.select(*keys, F.col("last.id").alias("keep_id"), "n")


def merge_runs(level: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """Merge run entries (run, *KEY, keep_id, n) to one entry for each text, in rounds."""
    prefix = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long")
    width = fan_in
    while width <= runs:
        node = F.floor(F.col("run") / width) * width + prefix % width
        sent = level.withColumn("node", node.cast("long")).withColumn("run", F.floor(F.col("run") / width) * width).repartition(runs, "node")
        level = merged_run(sent, ["node", "run", *KEY], F.col("keep_id"), F.col("n")).drop("node")
        width *= fan_in
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4, most_runs: int = 4096) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    runs = power_of(fan_in, max(64, shuffle_width(spark)), most_runs)
    rows = digests(docs, id_col, text_col).withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    rows = stored(rows, "dedup-digests")
    level = merged_run(rows, ["run", *KEY], F.col("doc_id"), F.lit(1))
    merged = merge_runs(level, runs, fan_in).withColumnRenamed("n", "group_size")
    by_run = level.select("run", *KEY).join(merged, KEY)
    out = rows.join(by_run, ["run", *KEY])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``exact_dedup`` keeps, with all their columns: one row of each text.

    Of rows that repeat both id and text one stays (which one is not told, if other columns differ).
    """
    one = lambda sha, own: F.concat_ws("|", sha, own)  # noqa: E731  a null id leaves the digest alone
    keep = exact_dedup(docs, id_col, text_col).where("kept").select(one("text_sha256", F.col("doc_id").cast("string")).alias("_kept")).distinct()
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    marked = docs.withColumn("_own", one(sha, F.col(id_col).cast("long").cast("string")))
    # Rows of one id and text have met for the join, so telling them apart takes no further exchange.
    return marked.join(keep, F.col("_own") == F.col("_kept"), "left_semi").dropDuplicates(["_own"]).drop("_own")
