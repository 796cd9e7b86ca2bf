"""Words of many texts at once, as hashes, by numpy over the raw bytes of an Arrow column.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]`` (as UTF-8 has these bytes in no
longer sequence, these are the words of the text); A-Z are lower-cased.  A word's hash is
a 64-bit polynomial of random byte values, mixed; it depends on the word alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64; kept, as batches are of a few sizes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the one of SplitMix64)."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its rows in them; null: empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, first): words [start, stop) in ``data``; row i has words first[i] to first[i + 1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    new = np.zeros(n + 1, dtype=bool)  # a word can't go on across the start of a row
    new[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | new[:n]
    after = np.concatenate([space[1:], [True]]) | new[1:]
    starts, stops = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    value = _VALUE[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64))  # bytes, or code points
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers(_BASE, len(data)))])
    own = (total[stops] - total[starts]) * powers(_INVERSE, len(data))[starts]
    return mix(own ^ (stops - starts).astype(np.uint64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): row i of ``column`` has the words hashes[first[i] : first[i + 1]]."""
    data, offsets = raw(column)
    starts, stops, first = spans(data, offsets)
    return hashes(data, starts, stops), first


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20):
    """Pieces of ``batch`` with about ``most_bytes`` of text; a longer row is a piece of its own."""
    _, offsets = raw(batch.column(text))
    i, n = 0, len(batch)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def compact(numbers: np.ndarray) -> bytes:
    """Ascending numbers by their steps, in one, two or four bytes each, as the largest step needs."""
    steps = np.diff(numbers, prepend=0)
    most = steps.max(initial=0)
    return steps.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def restored(steps: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``compact``."""
    return np.cumsum(np.frombuffer(steps, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(steps) // n if n else 1]).astype(np.int64))
