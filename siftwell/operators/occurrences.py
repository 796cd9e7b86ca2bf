"""Words of whole documents counted in Arrow batches: what a document's terms need is made where its text is.

Exploding a text takes some ten times its bytes, and so does sorting what comes of it by document
and word.  Here a slice of documents is split, counted and, for the index, packed at once, so
that no row of a single word or place is shuffled or spilled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import INDEX_STOPWORDS

# Bytes of text that are counted at once: little for rows, as they grow; more for packed rows, as a word is sent once for each slice.
ROWS_SLICE, PACKED_SLICE = 2 << 20, 16 << 20
# Postings of a packed row, so that none grows with the frequency of its word, and of a batch of unpacked ones.
PACKED_ROW, UNPACKED = 512, 100_000

ROWS = "word string, doc_id string, n long, most long, positions array<int>"
PACKED = "word string, k int, numbers binary, ids binary"


def dealt(rows: DataFrame) -> DataFrame:
    """(doc_id, contents) or (doc_id, text) with the rows of an id next to each other.

    Where no id repeats and there are tasks for all cores, texts stay where they are.
    """
    enough = rows.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism
    if enough and rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.repartition("doc_id").sortWithinPartitions("doc_id")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of a column of strings or binaries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def strings(kind: pa.DataType, lengths: np.ndarray, data: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    valid = None if there is None or there.all() else pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(lengths), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def first_of(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


# What ``text.sanitise`` of ``text.join_lines`` makes of each byte of UTF-8; 0: nothing.
CLEAN = np.zeros(256, np.uint8)
for _c in b" \t\x0b\x0cabcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    CLEAN[_c] = ord(chr(_c).lower())


def clean(texts: pa.Array) -> pa.Array:
    """``text.sanitise(text.join_lines(texts))`` of strings without nulls."""
    offsets, data = buffers(texts)
    data = CLEAN[data]
    kept = data != 0
    lengths = np.diff(offsets)
    some = np.flatnonzero(lengths)
    if len(some):
        lengths[some] = np.add.reduceat(kept.view(np.uint8), offsets[some], dtype=np.int64)
    return strings(pa.string(), lengths, data[kept])


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, raw: bool) -> Iterator[pa.Table]:
    """Tables (doc_id, contents) of about ``most_bytes`` of text; rows of an id that follow each other stay together.

    raw: texts are still to be sanitised.
    """
    held, size = [], 0
    for batch in batches:
        batch = batch.rename_columns(["doc_id", "contents"])
        batch = batch.filter(batch.column("contents").is_valid())
        if raw:
            batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), clean(batch.column("contents"))], ["doc_id", "contents"])
        if not len(batch):
            continue
        ends = buffers(batch.column("contents"))[0][1:]
        new = set(first_of(batch.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)).tolist())
        if held and held[-1].column("doc_id")[-1].as_py() == batch.column("doc_id")[0].as_py():
            new.discard(0)
        begin = 0
        for i in range(len(batch)):
            before = int(ends[i - 1]) - (int(ends[begin - 1]) if begin else 0) if i else 0
            if i in new and (held or i > begin) and size + before >= most_bytes:
                yield pa.Table.from_batches([*held, batch.slice(begin, i - begin)])
                held, size, begin = [], 0, i
        held.append(batch.slice(begin))
        size += int(ends[-1]) - (int(ends[begin - 1]) if begin else 0)
    if held:
        yield pa.Table.from_batches(held)


class Counted:
    """Postings of a slice of documents in the order of (document, word) or (word, document).

    word, doc: numbers in ``words`` and ``ids``; n: occurrences; most: the largest n of the
    document; places: all positions, those of a posting ascending; starts: where they begin.
    """

    def __init__(self, table: pa.Table, by_word: bool):
        column = table.column("doc_id").combine_chunks()
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = first_of(codes)
        self.ids = column.take(pa.array(first))
        doc_of_row = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(codes))))
        offsets, data = buffers(table.column("contents"))
        # Slots lie between separators; the end of a row is one more.
        white = (data == 32) | ((data >= 9) & (data <= 13))
        breaks = np.flatnonzero(white)
        row_of_break = np.searchsorted(offsets[1:], breaks, "right")
        n_slots = np.bincount(row_of_break, minlength=len(codes)) + 1
        first_slot = np.cumsum(n_slots) - n_slots
        begins = np.empty(int(n_slots.sum()), np.int64)
        ends = np.empty_like(begins)
        inner = np.arange(len(breaks)) + row_of_break
        begins[first_slot], begins[inner + 1] = offsets[:-1], breaks + 1
        ends[first_slot + n_slots - 1], ends[inner] = offsets[1:], breaks
        row = np.repeat(np.arange(len(codes)), n_slots)
        pos = (np.arange(len(begins)) - first_slot[row]).astype(np.int32)
        full = ends > begins
        tokens = strings(pa.string(), (ends - begins)[full], data[~white]).dictionary_encode()
        words = tokens.dictionary
        keep = np.array([not (w.startswith("www") or w in STOP) for w in words.to_pylist()], bool)
        code = tokens.indices.to_numpy(zero_copy_only=False)
        doc, pos = doc_of_row[row[full]], pos[full]
        kept = keep[code] if len(code) else np.zeros(0, bool)
        code, doc, pos = code[kept], doc[kept], pos[kept]
        key = code.astype(np.int64) * max(1, len(first)) + doc if by_word else doc.astype(np.int64) * max(1, len(words)) + code
        order = np.argsort(key, kind="stable") if len(first) == len(codes) else np.lexsort((pos, key))
        self.words, self.places = words, pos[order]
        self.starts = first_of(key[order])
        self.word, self.doc = code[order][self.starts], doc[order][self.starts]
        self.n = np.diff(np.append(self.starts, len(order)))
        most = np.zeros(len(first), np.int64)
        np.maximum.at(most, self.doc, self.n)
        self.most = most[self.doc]


STOP = frozenset(INDEX_STOPWORDS)


def mapped(rows: DataFrame, most_bytes: int, by_word: bool, make: Callable[[Counted], dict], schema: str) -> DataFrame:
    raw = "text" in rows.columns

    def run(batches):
        for table in slices(batches, most_bytes, raw):
            yield pa.RecordBatch.from_pydict(make(Counted(table, by_word)))

    return dealt(rows).mapInArrow(run, schema)


def lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def frequency_rows(rows: DataFrame) -> DataFrame:
    """A row (word, doc_id, n, most, positions) for each word of each document of (doc_id, contents) or, not yet sanitised, (doc_id, text)."""

    def make(c: Counted) -> dict:
        return {"word": c.words.take(pa.array(c.word)), "doc_id": c.ids.take(pa.array(c.doc)), "n": c.n, "most": c.most, "positions": lists(pa.array(c.places), c.starts)}

    return mapped(rows, ROWS_SLICE, False, make, ROWS)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, k): documents of a slice that have the word; a word has a row for each slice."""

    def make(c: Counted) -> dict:
        first = first_of(c.word)
        return {"word": c.words.take(pa.array(c.word[first])), "k": np.diff(np.append(first, len(c.word))).astype(np.int32)}

    return mapped(rows, PACKED_SLICE, True, make, "word string, k int")


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative numbers, seven bits in each, and where each number begins and the last ends."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >> bits > 0
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.zeros(int(at[-1]), np.uint8)
    for b in range(5):
        m = np.flatnonzero(size > b)
        out[at[m] + b] = ((values[m] >> 7 * b) & 127) | ((size[m] > b + 1) << 7)
    return out, at


def numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``varints`` and the place of each one's last byte."""
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    size, values = ends - starts + 1, np.zeros(len(ends), np.int64)
    for b in range(5):
        m = np.flatnonzero(size > b)
        values[m] |= (data[starts[m] + b] & 127).astype(np.int64) << 7 * b
    return values, ends


def packed(rows: DataFrame) -> DataFrame:
    """(word, k, numbers, ids): k postings of a word in a slice of documents, PACKED_ROW at most.

    numbers: lengths of the k ids (0: null, else one more), the k numbers of occurrences, the k
    largest of the documents, and the steps between positions; ids: one after the other.
    """

    def make(c: Counted) -> dict:
        # Rows begin with a word and after each PACKED_ROW of its postings.
        first = first_of(c.word)
        nth = np.arange(len(c.word)) - np.repeat(first, np.diff(np.append(first, len(c.word))))
        heads = np.flatnonzero(nth % PACKED_ROW == 0)
        k = np.diff(np.append(heads, len(c.word)))
        row = np.repeat(np.arange(len(heads)), k)
        token_head = c.starts[heads] if len(heads) else heads
        n_tokens = np.diff(np.append(token_head, len(c.places)))
        base = np.cumsum(3 * k + n_tokens) - 3 * k - n_tokens
        at = base[row] + np.arange(len(c.word)) - heads[row]
        id_ends, id_data = buffers(c.ids.cast(pa.string()))
        id_size = np.diff(id_ends)
        there = ~c.ids.is_null().to_numpy(zero_copy_only=False)
        steps = c.places.astype(np.int64)
        steps[1:] -= c.places[:-1]
        steps[c.starts] = c.places[c.starts]
        values = np.zeros(int((3 * k + n_tokens).sum()), np.int64)
        values[at] = np.where(there, id_size + 1, 0)[c.doc]
        values[at + k[row]] = c.n
        values[at + 2 * k[row]] = c.most
        token_row = np.repeat(np.arange(len(heads)), n_tokens)
        values[base[token_row] + 3 * k[token_row] + np.arange(len(steps)) - token_head[token_row]] = steps
        data, ends = varints(values)
        ids = c.ids.take(pa.array(c.doc))
        ends = ends[np.append(base, len(values))]
        id_at = np.append(0, np.cumsum(id_size[c.doc]))[np.append(heads, len(c.word))]
        return {
            "word": c.words.take(pa.array(c.word[heads])), "k": k.astype(np.int32),
            "numbers": strings(pa.binary(), np.diff(ends), data), "ids": strings(pa.binary(), np.diff(id_at), buffers(ids)[1]),
        }

    return mapped(rows, PACKED_SLICE, True, make, PACKED)


def unpacked(k: np.ndarray, numbers_column: pa.Array, ids_column: pa.Array) -> dict:
    """doc_id, n, most and positions of the postings of packed rows, in their order."""
    at, data = buffers(numbers_column)
    values, ends = numbers(data)
    base = np.searchsorted(ends, at[:-1])
    row = np.repeat(np.arange(len(k)), k)
    first = np.cumsum(k) - k
    place = base[row] + np.arange(len(row)) - first[row]
    sizes, n, most = values[place], values[place + k[row]], values[place + 2 * k[row]]
    # Steps are what remains of each row.
    is_step = np.ones(len(values), bool)
    for i in range(3):
        is_step[place + i * k[row]] = False
    steps = values[is_step]
    starts = np.cumsum(n) - n
    total = np.cumsum(steps)
    places = total - np.repeat(total[starts] - steps[starts], n)
    ids = strings(pa.string(), np.maximum(sizes - 1, 0), buffers(ids_column)[1], sizes > 0)
    return {"doc_id": ids, "n": n, "most": most, "positions": lists(pa.array(places.astype(np.int32)), starts)}


def unpack(rows: DataFrame, extra: str = "", positions: bool = True) -> DataFrame:
    """Postings (word, doc_id, n, most, positions) of packed rows, with their other columns (``extra``: names and types)."""
    others = [x.split()[0] for x in extra.split(",") if x]

    def run(batches):
        for batch in batches:
            total = np.cumsum(batch.column("k").to_numpy())
            begin = 0
            while begin < len(batch):
                done = int(total[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, done + UNPACKED, "right")))
                part = batch.slice(begin, end - begin)
                k = part.column("k").to_numpy().astype(np.int64)
                out = unpacked(k, part.column("numbers"), part.column("ids"))
                row = pa.array(np.repeat(np.arange(len(k)), k))
                out = {"word": part.column("word").take(row)} | out | {x: part.column(x).take(row) for x in others}
                yield pa.RecordBatch.from_pydict({x: v for x, v in out.items() if positions or x != "positions"})
                begin = end

    schema = ROWS if positions else ROWS.rpartition(",")[0]
    return rows.select("word", "k", "numbers", "ids", *others).mapInArrow(run, f"{schema}{', ' + extra if extra else ''}")


def unpack_lists(rows: DataFrame, extra: str) -> DataFrame:
    """(word, list) with other columns, of (word, packed), where packed lists (k, numbers, ids): a row for each word."""
    others = [x.split()[0] for x in extra.split(",") if x]
    kind = "array<struct<doc_id: string, n: bigint, most: bigint, positions: array<int>>>"

    def run(batches):
        for whole in batches:
            for begin in range(0, len(whole), 500):
                batch = whole.slice(begin, 500)
                flat = batch.column("packed").flatten()
                k, numbers_column, ids_column = flat.flatten()
                k = k.to_numpy().astype(np.int64)
                out = unpacked(k, numbers_column, ids_column)
                sizes = batch.column("packed").value_lengths().to_numpy()
                before = np.append(0, np.cumsum(k))[np.append(0, np.cumsum(sizes))]
                entries = pa.StructArray.from_arrays([out["doc_id"], pa.array(out["n"]), pa.array(out["most"]), out["positions"]], ["doc_id", "n", "most", "positions"])
                yield pa.RecordBatch.from_pydict({"word": batch.column("word"), **{x: batch.column(x) for x in others}, "list": lists(entries, before[:-1])})

    return rows.select("word", *others, "packed").mapInArrow(run, f"word string, {extra}, list {kind}")
