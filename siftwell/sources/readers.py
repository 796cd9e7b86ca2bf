"""Readers of the record formats that batch stages exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import index


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, content) of a folder of page files named by their fingerprint; system files are left out.

    Spark passes over files of no bytes, so an empty page file has no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(file_name(F.col("path")).alias("doc_id"), "content").where(~F.col("doc_id").contains("DS_Store"))


def whole_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, html): one record for each file, its content as text."""
    rows = spark.read.text(folder, wholetext=True).select(file_name(F.input_file_name()).alias("doc_id"), F.col("value").alias("html"))
    return rows.where(~F.col("doc_id").contains("DS_Store"))


def term_frequency_files(spark: SparkSession, folder: str) -> DataFrame:
    return index.parse_term_frequency_lines(spark.read.text(folder))


def posting_files(spark: SparkSession, folder: str, most_chars: int = index.MOST_LINE) -> DataFrame:
    """Postings of files of posting lines; longer lines are dropped."""
    lines = spark.read.text(folder).where(F.length("value") <= most_chars)
    return index.parse_posting_lines(lines, "value")


def adjacency_files(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dsts) of lines ``src dst dst``."""
    parts = F.filter(F.split("value", " "), lambda x: x != "")
    rows = spark.read.text(folder).select(parts.alias("p")).where(F.size("p") > 0)
    return rows.select(F.get("p", F.lit(0)).alias("src"), F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))).alias("dsts"))


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """(url): each line is a seed."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def messages(rows: DataFrame) -> DataFrame:
    """(url) of queue messages."""
    return rows.select(F.explode(urls.message_urls(F.col("value"))).alias("url"))


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Queue messages as a stream of text files; the checkpoint holds what was read, the limit holds back the rest."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
