"""Writers of the record formats, and upserts to a key-value store."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import index

BATCH, FILE_RECORDS = 25, 2_000_000


def write_term_frequencies(frequencies: DataFrame, folder: str) -> None:
    index.term_frequency_lines(frequencies).write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def write_snippets(snippets: DataFrame, folder: str) -> None:
    snippets.select("line").write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def write_posting_lines(lines: DataFrame, folder: str) -> None:
    """Lines of tab-separated key and postings, sorted by word within each file."""
    lines.repartition("word").sortWithinPartitions("word").select("line").write.mode("overwrite").text(folder)


def write_index(postings: DataFrame, folder: str, by_word: bool = False) -> None:
    """Postings as Parquet, dealt and sorted by word, so that a lookup reads a few row groups.

    by_word: they come dealt by word (``index.document_postings``) and are only sorted, so a lookup
    reads some pages of each file, but no posting is shuffled again.
    """
    (postings if by_word else postings.repartitionByRange("word", "doc_id")).sortWithinPartitions("word", "doc_id").write.mode("overwrite").parquet(folder)


def write_packed_index(packed: DataFrame, folder: str) -> None:
    """Packed postings (``index.packed_postings``) as Parquet, sorted by word within the task that packed them.

    Nothing is shuffled or unpacked; a lookup reads some pages of each file.
    """
    packed.sortWithinPartitions("word").write.mode("overwrite").parquet(folder)


def write_page_files(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Each page as a file named by its fingerprint, unless the store has it; returns (doc_id, new).

    Files go through pyarrow's file systems, under a temporary name until they are complete, so
    a retried task leaves the same files.
    """
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("content"))

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base)
        for pdf in batches:
            new = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                path = f"{base}/{doc_id}"
                new.append(system.get_file_info(path).type == fs.FileType.NotFound)
                if new[-1]:
                    temp = f"{base}/.{doc_id}.{uuid.uuid4().hex}"
                    with system.open_output_stream(temp, compression=None) as out:
                        out.write(content)
                    system.move(temp, path)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "new": new})

    return rows.dropDuplicates(["doc_id"]).mapInPandas(write, "doc_id string, new boolean")


def write_adjacency(edges: DataFrame, folder: str) -> None:
    """Lines ``src dst dst`` of (src, dst), parallel links repeated."""
    edges.groupBy("src").agg(F.collect_list("dst").alias("dsts")).select(F.concat_ws(" ", "src", F.array_join("dsts", " ")).alias("value")).write.mode("overwrite").text(folder)


def write_ranks(ranks: DataFrame, folder: str) -> None:
    ranks.write.mode("overwrite").parquet(folder)


def write_messages(found: DataFrame, folder: str, per_message: int = 100) -> None:
    """URLs as queue messages of at most ``per_message``; a message is made within its partition."""

    numbered = found.select("url", F.floor(F.monotonically_increasing_id() / per_message).alias("m"), F.spark_partition_id().alias("p"))
    numbered.groupBy("p", "m").agg(F.collect_list("url").alias("u")).select(urls.message(F.col("u")).alias("value")).write.mode("append").text(folder)


def upsert(rows: DataFrame, put: Callable[[list[dict]], list[dict]], batch: int = BATCH) -> DataFrame:
    """Send rows to a store in batches from the executors; returns the rows that ``put`` gives back.

    put: takes up to ``batch`` rows as dicts, writes them idempotently by key and returns
    those it could not write (the dead letters).  A retried task sends its rows again.
    """
    names, schema = rows.columns, rows.schema

    def send(batches):
        import pandas as pd

        for pdf in batches:
            records = pdf.to_dict("records")
            failed = []
            for i in range(0, len(records), batch):
                failed += put(records[i : i + batch])
            yield pd.DataFrame(failed, columns=names)

    return rows.mapInPandas(send, schema)
