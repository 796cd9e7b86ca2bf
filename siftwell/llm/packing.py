"""Packing into optimal length buckets.

The global histogram of lengths is the only thing that reaches the driver: lengths up to
``exact`` (131,072) have a bin each, so bounds are optimal for them; longer ones share bins of
a relative width of 1/1024, which costs at most a thousandth of their tokens in padding.  So
the histogram has ``exact`` bins at most plus about a thousand for each doubling beyond it,
whatever the number of documents.  Dynamic programming over it chooses at most ``buckets`` upper
bounds that minimise padding; the cost is a Monge array, so each layer is solved by divide
and conquer.  A bucket is dealt into shards by a seeded hash; in a shard, documents in
seeded order fill batches of ``budget`` tokens (``budget // bound`` documents, one at
least).  So no task holds a whole bucket, and only the last batch of a shard is short.

Defined results
- Length of a document: its words, or the column given; null or empty text: length 0,
  which goes to the first bucket.
- A document longer than the budget is a batch of its own; nothing is cut or dropped.
- Repeated rows are packed as often as they stand; equal rows are interchangeable.
- Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .mixing import n_words, seeded


def bin_of(length: Column, exact: int) -> Column:
    """Upper bound of a length's bin: itself up to ``exact``, then rounded up at 11 bits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 10)
    return F.when(length <= exact, length).otherwise((F.ceil(length / step) * step).cast("long")).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (a subset of ``lengths``, ascending) of least total padding.

    totals: tokens in each bin.  Ties go to fewer buckets, then to the later cut.
    """
    m = len(lengths)
    if m == 0:
        return []
    n0 = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    t0 = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
    size = lengths.astype(np.int64)

    def cost(i, j):  # bins i..j-1 in one bucket
        return size[j - 1] * (n0[j] - n0[i]) - (t0[j] - t0[i])

    ends = np.arange(1, m + 1)
    best = cost(np.zeros(m, dtype=np.int64), ends)  # best[j-1]: bins 0..j-1 with one bucket
    layers, finals = [np.zeros(m, dtype=np.int64)], [int(best[-1])]
    for k in range(2, min(buckets, m) + 1):
        before, cut = np.concatenate([[0], best]), np.zeros(m, dtype=np.int64)
        new = np.empty(m, dtype=np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            value = before[i] + cost(i, j)
            at = len(i) - 1 - int(np.argmin(value[::-1]))
            new[j - 1], cut[j - 1] = value[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        best = new
        layers.append(cut)
        finals.append(int(best[-1]))
    k = int(np.argmin(finals))
    bounds, j = [], m
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j = int(layers[k][j - 1]) if k else 0
        k -= 1
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, buckets: int = 16, budget: int = 16384, exact: int = 1 << 17, shard_rows: int = 2048, seed: str = "pack") -> DataFrame:
    """One row for each document: doc_id, n_tokens, bucket, padded_to, shard, batch, slot, padding."""
    length = n_words(F.col(text_col)) if length_col is None else F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    # Rows without an id are told apart by their text, so that they don't all go to one shard.
    plain = F.concat(F.lit("|"), F.xxhash64(*[c for c in docs.columns if c in (text_col, length_col)]).cast("string"))
    name = F.coalesce(F.col(id_col).cast("long").cast("string"), plain)
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("n_tokens"), F.when(F.col(id_col).cast("long").isNull(), name).alias("plain")), "pack-lengths")
    histogram = rows.groupBy(bin_of(F.col("n_tokens"), exact).alias("bin")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).orderBy("bin").collect()
    lengths, counts, totals = (np.array([r[i] for r in histogram], dtype=np.int64) for i in range(3))
    bounds = best_bounds(lengths, counts, totals, buckets) or [0]
    in_bucket = [int(counts[(lengths <= hi) & (lengths > lo)].sum()) for lo, hi in zip([-1, *bounds], bounds)]
    bucket = F.lit(len(bounds) - 1)
    for k in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1).cast("long")

    capacity = [max(1, budget // max(1, b)) for b in bounds]
    # A shard holds several whole batches, so that few batches are short.
    shards = [max(1, round(n / max(shard_rows, 4 * c))) for n, c in zip(in_bucket, capacity)]
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("plain"))
    placed = rows.withColumn("bucket", bucket.cast("int")).withColumn("padded_to", of_bucket(bounds)).withColumn("capacity", of_bucket(capacity))
    placed = placed.withColumn("shard", seeded(name, seed=f"{seed}-shard") % of_bucket(shards))
    turn = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(seeded(name, seed=f"{seed}-order"), "doc_id", "plain", "n_tokens")) - 1
    placed = placed.withColumn("turn", turn)
    return placed.select(
        "doc_id", "n_tokens", "bucket", "padded_to", "shard",
        F.floor(F.col("turn") / F.col("capacity")).cast("long").alias("batch"),
        (F.col("turn") % F.col("capacity")).cast("long").alias("slot"),
        (F.col("padded_to") - F.col("n_tokens")).alias("padding"),
    )
