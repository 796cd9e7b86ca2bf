"""Link analysis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions import scoring
from .occurrences import first_of, lists
from .storage import cut

# Links of a page in a row at most, and links that are put together at once.
TOGETHER, SLICE = 500, 2 << 20


def edges_of(adjacency: DataFrame) -> DataFrame:
    """(src, dsts) to (src, dst), repeated targets kept."""
    return adjacency.select("src", F.explode("dsts").alias("dst"))


def gathered(edges: DataFrame) -> DataFrame:
    """(src, n, out) of (src, dst): n links of a page; out: TOGETHER (dst, n) at most, n parallel links.

    Links move once; a slice of those that a task gets is sorted and packed in Arrow, so a page has a
    row or more for each slice, and memory does not grow with the links of a page.
    """
    entry = StructType([StructField("dst", edges.schema["dst"].dataType), StructField("n", LongType())])
    schema = StructType([StructField("src", edges.schema["src"].dataType), StructField("n", LongType()), StructField("out", ArrayType(entry))])

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        src, dst = (table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("src", "dst"))
        number = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst)]
        key, n = np.unique(number[0] * len(dst.dictionary) + number[1], return_counts=True)
        s, d = np.divmod(key, len(dst.dictionary))
        first = first_of(s)
        nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        heads = np.flatnonzero(nth % TOGETHER == 0)
        out = pa.StructArray.from_arrays([dst.dictionary.take(pa.array(d)), pa.array(n.astype(np.int64))], ["dst", "n"])
        return pa.RecordBatch.from_pydict({"src": src.dictionary.take(pa.array(s[heads])), "n": np.add.reduceat(n, heads).astype(np.int64), "out": lists(out, heads)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch] if len(batch) else held, size + len(batch)
            if size >= SLICE:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return edges.where("src is not null").select("src", "dst").repartition("src").mapInArrow(run, schema)


def pagerank(edges: DataFrame, iterations: int = 100, semantics: str = "intended", alpha: float = 1 / 7, tol: float | None = None, every: int = 10) -> DataFrame:
    """(id, rank) after ``iterations`` steps from rank 1.0 of all pages with links.

    A step sums rank / out-degree (parallel links count) over incoming links; pages without
    incoming links drop out after a step, and pages without links hold a rank but hand
    nothing on.  reference: plain sums; intended: sums damped by ``alpha``.  With ``tol``
    the steps end when no rank moves by more.  Links are put together, up to TOGETHER of a page
    in a row (``gathered``): a step joins these rows, not the links.  What a page hands to each
    link is worked out from its degree before that join, so that rows of links need not meet
    their degree, which would be another shuffle of them.  Lineage is cut ``every`` so many steps.
    """
    links = cut(gathered(edges))
    degrees = cut(links.groupBy("src").agg(F.sum("n").alias("degree")))
    ranks = degrees.select(F.col("src").alias("id"), F.lit(1.0).alias("rank"))
    for i in range(1, iterations + 1):
        shares = degrees.join(ranks, F.col("src") == F.col("id")).select("id", (F.col("rank") / F.col("degree")).alias("share"))
        given = links.select("src", "out").join(shares, F.col("src") == F.col("id")).select("share", F.inline("out")).select("dst", (F.col("share") * F.col("n")).alias("part"))
        total = F.sum("part")
        new = given.groupBy("dst").agg((scoring.damp(total, alpha) if semantics == "intended" else total).alias("rank")).withColumnRenamed("dst", "id")
        if tol is not None or i % every == 0 and i < iterations:
            new = cut(new)
        if tol is not None:
            both = new.join(ranks.withColumnRenamed("rank", "old"), "id", "full")
            moved = both.where(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))) > tol)
            if moved.isEmpty():
                return new
        ranks = new
    return ranks
