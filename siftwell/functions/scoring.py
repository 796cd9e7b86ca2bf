"""Scores of terms, documents and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TF_FLOOR = 0.4
# Centre and width of TF-IDF totals, centre of ranks, share of the rank.
TFIDF_CENTRE, TFIDF_WIDTH, RANK_CENTRE, RANK_SHARE = 21.6, 15.0, 1.76884, 0.1


def normalised_tf(count: Column, most: Column) -> Column:
    return F.lit(TF_FLOOR) + F.lit(1 - TF_FLOOR) * count / most


def idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.ln(n_docs / doc_freq)


def rank_weight(rank: Column) -> Column:
    """ln |(rank - 1) / centre|, with the sign turned for negative ranks; minus infinity at 1."""
    plain = F.when(rank == 1, F.lit(float("-inf"))).otherwise(F.ln(F.abs((rank - 1) / RANK_CENTRE)))
    return F.when(rank < 0, -plain).otherwise(plain)


def blended(tfidf: Column, rank: Column) -> Column:
    return (tfidf - TFIDF_CENTRE) / TFIDF_WIDTH + RANK_SHARE * rank_weight(rank)


def damp(rank: Column, alpha: float) -> Column:
    return rank * (1 - alpha) + alpha
