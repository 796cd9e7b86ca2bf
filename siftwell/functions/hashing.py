"""Fingerprints and shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed value: the polynomial of page fingerprints over GF(2), bit k the coefficient of x^k; its degree is 53.
RABIN_POLYNOMIAL = 17427110449267851


def fingerprint(content: Column) -> Column:
    """64-bit fingerprint of a page: the join key of pages, postings and ranks."""
    return F.xxhash64(content)


def content_digest(content: Column) -> Column:
    """A fingerprint that any SQL engine can repeat."""
    return F.sha2(content, 256)


def host_shard(host: Column, n: int) -> Column:
    """Shard of a host: n equal ranges of the first 60 bits of its SHA-1."""
    return F.least(F.lit(n - 1), F.floor(F.conv(F.substring(F.sha1(host), 1, 15), 16, 10).cast("long") / F.lit((1 << 60) // n))).cast("int")


def rabin_values(pages: list[bytes | None], polynomial: int = RABIN_POLYNOMIAL) -> list[int | None]:
    """Each page, a polynomial over GF(2), modulo ``polynomial`` (of a degree from 8 to 56).

    All pages go forward by a byte at a time, longest first, so a step is one array operation
    over the pages that still have bytes.
    """
    degree = polynomial.bit_length() - 1
    table = np.zeros(256, np.uint64)
    for top in range(256):
        rest = top << degree
        for k in range(degree + 7, degree - 1, -1):
            if rest >> k & 1:
                rest ^= polynomial << k - degree
        table[top] = top << degree ^ rest
    size = np.array([len(x or b"") for x in pages], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(pages[i] or b"" for i in order), np.uint8).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(size[order])])[:-1]
    value = np.zeros(len(pages), np.uint64)
    going = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    for at, n in enumerate(going.tolist()):
        value[:n] = (value[:n] << np.uint64(8) | data[start[:n] + at]) ^ table[(value[:n] >> np.uint64(degree - 8)).astype(np.int64)]
    out: list[int | None] = [None] * len(pages)
    for i, v in zip(order.tolist(), value.tolist()):
        out[i] = None if pages[i] is None else v
    return out


def rabin_udf(polynomial: int = RABIN_POLYNOMIAL):
    """Rabin fingerprints of binary pages, as an Arrow UDF; slower than ``fingerprint``."""

    @F.pandas_udf(LongType())
    def rabin(content: pd.Series) -> pd.Series:
        return pd.Series(rabin_values([None if x is None else bytes(x) for x in content], polynomial), dtype="Int64")

    return rabin
