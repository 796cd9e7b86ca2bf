"""Exact top-k search by block-at-a-time pruning.

Vectors become integers, floor(256 * x) for each component.  They are sorted by id over
slices of the index, by rank, so ids may lie as far apart as they like.  In a slice, runs of
consecutive ids form blocks (the forward index: ids and an integer matrix) with the largest
and smallest value of each component (term); ``blocks_per_group`` blocks are one row of the
index table, in shared storage.  A query's bound for a block is the sum over its terms of
q * largest (q * smallest for negative q), so no vector of the block scores more.  A task has
a slice, of ``slice_values`` numbers at most as planned, and a stretch of queries.  Per query
it takes all blocks of the slice in descending order of their bounds; each is scored through
its forward index, until the next bound falls below the query's k-th score in the slice.  The
k best of each slice are merged in a last step.

All queries meet all slices: that is the task, a stated set of queries against all rows.

Defined results
- Vectors that are null, or hold a null, NaN, infinity, or a value whose integer is no
  bigint (2**63), take no part.  Vectors are compared with those of their own length only.
- Scores are exact; one that exceeds 2**62 is no bigint to rank by and stops the run.
- A query is not its own candidate: rows with the query's id are left out for it.  Rows
  that repeat an id are candidates each, and a query of theirs is asked once (the smallest
  vector by its components).
- Null ids take no part, as no result could name them.  Ties go to the smaller id.
- Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored


MOST = (1 << 62) - 1


def integers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v): valid vectors as arrays of integers."""
    value = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float(1 << 55)))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), value).alias("v"))
    return out.where("vec_id is not null and v is not null").withColumn("dim", F.size("v"))


def matrix_rows(pdf: pd.DataFrame, block_rows: int = 0) -> tuple[bytes, bytes, bytes, bytes]:
    """ids, matrix, and per block of ``block_rows`` the largest and the smallest values."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    ids = pdf["vec_id"].to_numpy(np.int64)
    m = np.stack([np.asarray(v, dtype=np.int64) for v in pdf["v"]]).reshape(len(ids), -1)
    if not block_rows:
        return ids.tobytes(), m.tobytes(), b"", b""
    at = np.arange(0, len(ids), block_rows)
    return ids.tobytes(), m.tobytes(), np.maximum.reduceat(m, at, axis=0).tobytes(), np.minimum.reduceat(m, at, axis=0).tobytes()


def product(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """a @ b.T in exact integers: by floating point where every sum stays below 2**53, as Python's beyond MOST."""
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def best_of_group(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, top: np.ndarray, low: np.ndarray, block_rows: int, k: int, cuts: np.ndarray | None = None):
    """(query row, score, id) of each query's k best, and how many blocks were scored.

    Block b is rows cuts[b] to cuts[b + 1]; without ``cuts`` blocks are of ``block_rows`` rows.
    """
    if cuts is None:
        cuts = np.minimum(np.arange(len(top) + 1) * block_rows, len(ids))
    n, blocks = len(qid), len(top)
    bound = float(np.abs(q).max(initial=1)) * float(np.abs(m).max(initial=1)) * max(1, m.shape[1])
    limits = product(np.maximum(q, 0), top, bound) + product(np.minimum(q, 0), low, bound)
    limits = np.minimum(np.maximum(limits, -MOST), MOST).astype(np.int64)
    order = np.argsort(-limits, axis=1, kind="stable")
    sorted_limits = np.take_along_axis(limits, order, axis=1)
    worst = -(1 << 62)  # its negative is a number too, unlike that of the least integer
    score, who = np.full((n, k), worst), np.zeros((n, k), dtype=np.int64)
    scored, rows = 0, np.arange(n)
    for turn in range(blocks):
        # A block whose bound equals the k-th score may still hold a smaller id.
        rows = rows[sorted_limits[rows, turn] >= score[rows, k - 1]]
        if not len(rows):
            break
        scored += len(rows)
        chosen = order[rows, turn]
        for b in np.unique(chosen):
            own = rows[chosen == b]
            part = slice(cuts[b], cuts[b + 1])
            s = product(q[own], m[part], bound)
            s[qid[own][:, None] == ids[part][None, :]] = worst
            if s.dtype == object:
                if (s > MOST).any() or (s < worst).any():
                    raise OverflowError("a score exceeds 2**62")
                s = s.astype(np.int64)
            if s.shape[1] > 4 * k:  # keep what can be among the k best, ties included
                kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                keep = (s >= np.maximum(kth, score[own, k - 1 : k])).any(axis=0)
                s, there = s[:, keep], ids[part][keep]
            else:
                there = ids[part]
            both = np.concatenate([score[own], s], axis=1)
            names = np.concatenate([who[own], np.broadcast_to(there, s.shape)], axis=1)
            first = np.lexsort((names, -both), axis=1)[:, :k]
            score[own], who[own] = np.take_along_axis(both, first, axis=1), np.take_along_axis(names, first, axis=1)
    at, place = np.nonzero(score != worst)
    return at, score[at, place], who[at, place], scored


def packed_runs(vectors: DataFrame, n: int, rows: int, block_rows: int) -> DataFrame:
    """(dim, slice, ids, m, top, low): vectors in ``n`` slices by rank of (dim, id), a row for each run of ``rows`` vectors of one length."""

    def cut(batches):
        context = TaskContext.get()
        own = context.partitionId() if context else 0
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            dims = held["dim"].to_numpy()
            ends = [*(np.flatnonzero(dims[1:] != dims[:-1]) + 1), len(dims)]
            start = 0
            for end in ends:
                while start < end and (end - start >= rows or end < len(dims)):
                    yield frame(own, held[start : min(end, start + rows)])
                    start = min(end, start + rows)
            held = held[start:]
        if held is not None and len(held):
            yield frame(own, held)

    def frame(own, pdf):
        return pd.DataFrame([(int(pdf["dim"].iloc[0]), own, *matrix_rows(pdf, block_rows))], columns=["dim", "slice", "ids", "m", "top", "low"])

    ordered = vectors.repartitionByRange(n, "dim", "vec_id").sortWithinPartitions("dim", "vec_id")
    return ordered.select("dim", "vec_id", "v").mapInPandas(cut, "dim int, slice int, ids binary, m binary, top binary, low binary")


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, block_rows: int = 128, blocks_per_group: int = 64, chunk: int = 1024, slice_values: int = 1 << 22) -> DataFrame:
    """Queries: ids divisible by ``every``.  Returns query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    vectors = stored(integers(rows, id_col, vector_col), "topk-vectors")
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    values, questions = vectors.agg(F.sum("dim"), F.sum(F.when(F.pmod("vec_id", F.lit(every)) == 0, F.col("dim")))).first()
    slices, stretches = max(shuffle_width(spark), -(-(values or 0) // slice_values)), max(1, -(-(questions or 0) // slice_values))
    index = stored(packed_runs(vectors, slices, block_rows * blocks_per_group, block_rows), "topk-index")
    # A stretch of queries meets each slice, and a slice each stretch: both sides are repeated as often as the other has parts.
    queries = packed_runs(asked, stretches, chunk, chunk).select("dim", F.col("slice").alias("stretch"), "ids", "m")
    queries = stored(queries, "topk-queries").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    index = index.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))))

    def search(key, blocks, asked):
        dim = int(key[0])
        matrix = lambda data: np.frombuffer(data, np.int64).reshape(-1, dim)
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        if len(blocks) and len(asked):
            ids, m = np.concatenate([np.frombuffer(x, np.int64) for x in blocks["ids"]]), np.concatenate([matrix(x) if dim else np.zeros((len(i) // 8, 0), np.int64) for x, i in zip(blocks["m"], blocks["ids"])])
            sizes = [min(block_rows, n - i) for n in (len(x) // 8 for x in blocks["ids"]) for i in range(0, n, block_rows)]
            top, low = (np.concatenate([matrix(x) for x in blocks[c]]) if dim else np.zeros((len(sizes), 0), np.int64) for c in ("top", "low"))
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            for qids, q in zip(asked["ids"], asked["m"]):
                qid = np.frombuffer(qids, np.int64)
                at, score, who, _ = best_of_group(qid, matrix(q) if dim else np.zeros((len(qid), 0), np.int64), ids, m, top, low, block_rows, k, cuts)
                out.append(pd.DataFrame({"query_id": qid[at], "vec_id": who, "score": score}))
        return pd.concat(out)

    on = ["dim", "slice", "stretch"]
    found = index.groupBy(*on).cogroup(queries.groupBy(*on)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
