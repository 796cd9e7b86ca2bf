"""A training corpus from ``documents``, in five stages of the training-data operators.

Each stage gets what its predecessor kept, written as Parquet to the shared folder and read
again.  All but the last return the columns of ``documents``.

Defined results
- toxicity: null and empty texts are scored like texts without any marker, and stay if that is
  below 0.5; labels that are null are ignored; without labels nothing is toxic.
- exact_dedup: null and empty texts are equal, one row stays; so does one row of those that
  repeat id and text.  A null id is smaller than any other.
- ngram_jaccard_join: texts without words link with nothing; rows without an id stay; of rows
  that repeat an id with different texts all go or stay together.
- mixing: documents without words are left out, as nothing can be taken of them; a null
  source is a source of its own.
- packing: a row for each stretch, whatever its length.
- Other columns, whatever their names, go through all stages but the last; empty tables give
  an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import stored
from siftwell.llm.exact_dedup import kept_documents
from siftwell.llm.jaccard_join import one_of_each
from siftwell.llm.mixing import mixed_documents
from siftwell.llm.packing import pack
from siftwell.llm.toxicity import keep_clean, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on ``labels`` (without the held-out fifth) scores below 0.5."""
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    return keep_clean(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=learn))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word shingles (five words, a Jaccard similarity of 0.8 or more) the one with the smallest doc_id."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: stretches taken, repeats included."""
    return mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each stretch: its bucket, batch and padding."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_batches),
]

# SQL can't express the first stage (a trained classifier).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
