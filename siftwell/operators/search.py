"""Keyword search: terms, candidates, blended ranking, pages of results."""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text, urls
from . import index as terms_index

CANDIDATES, PAGE, CACHED = 500, 10, 1000


def query_terms(spark: SparkSession, query: str, semantics: str = "intended") -> DataFrame:
    """(word) of a query, repeats kept."""
    return spark.range(1).select(F.explode(text.query_terms(F.lit(query), semantics)).alias("word"))


def candidates(postings: DataFrame, terms: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(doc_id, tfidf): the best documents by their sum over the terms; a repeated term counts again.

    The terms of one query are a handful of rows, bounded by its length, so they are broadcast
    and the postings are filtered where they are read.
    """
    found = postings.join(F.broadcast(terms), "word").groupBy("doc_id").agg(F.sum("tfidf").alias("tfidf"))
    return found.orderBy(F.round("tfidf", 5).desc(), "doc_id").limit(most)


def rank_items(ranks: DataFrame, pages: DataFrame) -> DataFrame:
    """(fingerprint, rank, urls) from (id, rank) and (id, url)."""
    by_id = pages.where(F.col("url").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    return ranks.join(by_id, "id").select(F.col("id").alias("fingerprint"), "rank", "urls")


def ranked(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """Candidates with rank, URL and blended score; those without a URL are dropped.

    found: (doc_id, tfidf), CANDIDATES rows at most, so it is broadcast to ranks
    (fingerprint, rank, urls).  The cut to the best candidates comes first by definition.
    """
    key = F.col("doc_id").try_cast("long")
    joined = ranks.join(F.broadcast(found), F.col("fingerprint") == key).where(F.size("urls") > 0)
    url = urls.shortest(F.col("urls"))
    return joined.select(
        "doc_id",
        url.alias("url"),
        F.col("rank").alias("page_rank"),
        "tfidf",
        scoring.blended(F.col("tfidf"), F.col("rank")).alias("weighted_value"),
        urls.preview_name(url).alias("preview_name"),
    )


def result_page(results: DataFrame, start: int = 0, size: int = PAGE) -> DataFrame:
    """Results [start, start + size) by score, then TF-IDF, then id; past the end: none."""
    return results.orderBy(F.col("weighted_value").desc(), F.col("tfidf").desc(), "doc_id").offset(start).limit(size)


def result_count(results: DataFrame, query: str) -> DataFrame:
    """One row (n, header) of all results of a query, not of a page."""
    found = F.when(F.col("n") > 0, F.lit("Showing results for")).otherwise(F.lit("No results found for"))
    return results.agg(F.count("*").alias("n")).select("n", F.concat(found, F.lit(f' "{query}"')).alias("header"))


def search(spark: SparkSession, query: str, postings: DataFrame, ranks: DataFrame, start: int = 0, size: int = PAGE, semantics: str = "intended", demo: bool = True) -> DataFrame:
    """One page of results of a query; demo=False leaves the scores out."""
    page = result_page(ranked(candidates(postings, query_terms(spark, query, semantics)), ranks), start, size)
    return page if demo else page.select("doc_id", "url", "preview_name")


def pagination_links(start: Column, n: Column, size: int = PAGE) -> Column:
    """Links of a result page: B or F with the start they lead to."""
    floor = start - start % size
    forward = F.array(F.concat(F.lit("F"), (floor + size).cast("string")))
    back = F.array(F.concat(F.lit("B"), (floor - size).cast("string")))
    none = F.array().cast("array<string>")
    return F.when(start < size, F.when(n > size, F.array(F.lit(f"F{size}"))).otherwise(none)).otherwise(F.when(floor + size < n, F.concat(back, forward)).otherwise(back))


def random_term(postings: DataFrame, seed: int) -> DataFrame:
    """(word): one word of the vocabulary, the same for a seed: the least by a salted hash."""
    by = F.sha1(F.concat(F.lit(f"{seed}|"), F.col("word")))
    return postings.agg(F.min(F.struct(by.alias("by"), "word")).alias("least")).select(F.col("least.word").alias("word")).where("word is not null")


class Lru:
    """A cache of ``most`` entries; the one used longest ago goes first."""

    def __init__(self, most: int = CACHED, gone: Callable = lambda value: None):
        self.most, self.gone, self.held, self.hits = most, gone, OrderedDict(), 0

    def get(self, key, make: Callable):
        if key in self.held:
            self.hits += 1
        else:
            self.held[key] = make()
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.gone(self.held.popitem(last=False)[1])
        return self.held[key]


class SearchEngine:
    """Searches over a written index and written ranks, with caches of postings, ranks and results.

    index: Parquet of (word, doc_id, tfidf) sorted by word, so a word's postings are found by the
    statistics of a few row groups; or of packed postings of ``n_docs`` documents, which are weighed
    when their word is asked for.  ranks: Parquet of (fingerprint, rank, urls).  The postings
    of a word stay with the executors as a cached frame; the driver holds rows of ranks and of
    results, CANDIDATES for a search at most.
    """

    def __init__(self, spark: SparkSession, index: str, ranks: str, semantics: str = "intended", most: int = CACHED, n_docs: int | None = None):
        self.spark, self.semantics, self.n_docs = spark, semantics, n_docs
        self.index = spark.read.parquet(index)
        self.rank_rows = spark.read.parquet(ranks)
        self.postings, self.ranks, self.results = Lru(most, lambda df: df.unpersist()), Lru(most), Lru(most)

    def words(self, query: str) -> list[str]:
        return [r.word for r in query_terms(self.spark, query, self.semantics).collect()]

    def found(self, query: str) -> list[Row]:
        """All results of a query, best first."""
        return self.results.get(query, lambda: self.search(self.words(query)))

    def of_word(self, word: str) -> DataFrame:
        rows = self.index.where(F.col("word") == word)
        rows = rows if self.n_docs is None else terms_index.scored_postings(rows, self.n_docs, self.semantics, positions=False)
        return rows.select("word", "doc_id", "tfidf")

    def search(self, words: list[str]) -> list[Row]:
        if not words:
            return []
        each = [self.postings.get(w, lambda w=w: self.of_word(w).persist()) for w in words]
        total = functools.reduce(DataFrame.union, each).groupBy("doc_id").agg(F.sum("tfidf").alias("tfidf"))
        best = total.orderBy(F.round("tfidf", 5).desc(), "doc_id").limit(CANDIDATES).collect()
        ids = [r.doc_id for r in best]
        new = [i for i in ids if i not in self.ranks.held]
        if new:
            key = F.col("doc_id").try_cast("long")
            asked = self.spark.createDataFrame([(i,) for i in new], "doc_id string").select("doc_id", key.alias("fingerprint"))
            known = {r.doc_id: r for r in self.rank_rows.join(F.broadcast(asked), "fingerprint").collect()}
        rows = [(r.doc_id, r.tfidf, self.ranks.get(r.doc_id, lambda r=r: known.get(r.doc_id))) for r in best]
        held = [(i, t, x["rank"], x["urls"]) for i, t, x in rows if x is not None]
        frame = self.spark.createDataFrame(held, "doc_id string, tfidf double, rank double, urls array<string>")
        ranks = frame.select(F.col("doc_id").cast("long").alias("fingerprint"), "rank", "urls")
        return result_page(ranked(frame.select("doc_id", "tfidf"), ranks), 0, CANDIDATES).collect()

    def page(self, query: str, start: int = 0, size: int = PAGE) -> DataFrame:
        """A page of results, from the cache where the query was asked before."""
        schema = "doc_id string, url string, page_rank double, tfidf double, weighted_value double, preview_name string"
        return self.spark.createDataFrame(self.found(query)[start : start + size], schema)

    def header(self, query: str) -> tuple[int, str]:
        return tuple(result_count(self.spark.createDataFrame([(0,)] * len(self.found(query)), "x int"), query).first())
