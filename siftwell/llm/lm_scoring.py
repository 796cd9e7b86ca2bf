r"""LM scoring: stupid backoff over word bigrams.

S(w | v) = c(v w) / c(v) where the bigram stands at least ``least`` times in the corpus,
and ``alpha`` * c(w) / N otherwise; c(v) counts all places of v, and the start of a text is
a word of its own before its first word.  A text's score is the sum of ln S over its words
(A-Z lower-cased, runs of other than ``[\x20\x09-\x0D]``).

The relations are the unigram table (word, n), the bigram table (v, w, n), both partitioned
by hash, and the exploded bigrams of the texts (text, v, w, n).  A row of these relations
holds one part of a piece of texts as packed columns, as one row for each bigram costs more
than all the rest; keys, joins and sums are those of the plain form.

1. Unigrams: a scan counts the words of a window of texts; parts by hash of the word add up.
   The ``hot`` (65,000 at most) most frequent words get a two-byte code: a bounded table of
   1 MB, broadcast.  It also takes the hottest keys out of all later shuffles.
2. Exploded bigrams, counted once for each text, go to the part of their second word's hash,
   or of the whole bigram's hash if that word is hot.  So c(v w) adds up in one part, and
   c(w) is either hot or adds up in the same part.  A part returns a sum for each text that
   has entries there.
3. Where c(v) is needed and v is not hot, (v, text, n) goes on to v's part of the unigram
   table, which returns a further sum.
4. Sums come together by piece.

A bigram that ``COMMON`` texts of a piece hold is added up before it is sent: it travels as if
it were one more text of the piece, with its number of places, and its texts and their
numbers stay behind with the piece, which deals the sum out.  So a key that all texts hold is
one entry for each piece.  Parts are as many as the session's shuffles have, or more to keep
``part_words`` words each.  A task takes several, one at a time, up to ``part_words`` words in
all, and adds their sums up: a sum for each text and part would be nearly one for each bigram
where parts are more than a text's words.

Defined results
- null, empty or blank text: 0 words, score 0, per_word 0.
- per_word is the score divided by the number of words, by which texts of any length compare.
- Rows that repeat are separate texts, each counted.  One row for each row of the input,
  null ids included; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_part, heaviest, shuffle_width, stored
from .tokens import mix, slices, word_hashes

START = np.uint64(0x5354415254)  # the word before a text's first
HOT, COLD = 65_000, 65_535  # codes below HOT are hot words; HOT itself is START
COMMON = 8
TASKS = 64  # at least so many take the parts, if there are as many


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys, 21) % np.uint64(parts)).astype(np.int64)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, under zstd: high bytes are few, which a codec of whole runs does not see."""
    data = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    return numbers.dtype.char.encode() + len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def whole(data: bytes) -> np.ndarray:
    """The numbers of ``squeezed``."""
    kind, size = np.dtype(chr(data[0])), int.from_bytes(data[1:5], "little")
    flat = np.frombuffer(pa.decompress(data[5:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return flat.reshape(kind.itemsize, size // kind.itemsize).T.copy().view(kind).ravel()


def steps(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, best in runs that ascend, by their steps (modulo 2 ** 32)."""
    return squeezed(np.diff(numbers.astype(np.uint32), prepend=np.uint32(0)))


def walked(data: bytes) -> np.ndarray:
    """The numbers of ``steps``."""
    return np.cumsum(whole(data), dtype=np.uint32).astype(np.int64)


def bins(n: np.ndarray) -> np.ndarray:
    """``common.count_bin`` for an array."""
    return np.where(n < 1024, n, 1024 + np.floor((np.log2(np.maximum(n, 1)) - 10) * 256).astype(np.int64))


def by_part(part: np.ndarray, parts: int):
    """(part, positions) of the parts that occur, positions in their old order."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def unigrams(docs: DataFrame, parts: int) -> DataFrame:
    """(part, words, counts): the unigram table, a packed row for each part."""

    def count(batches):
        window, size = [], 0

        def flush():
            words, n = np.unique(np.concatenate(window), return_counts=True)
            out = [(k, words[at].tobytes(), squeezed(n[at].astype(np.int64))) for k, at in by_part(part_of(words, parts), parts)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["part", "words", "counts"])

        for rows in batches:
            for batch in slices(rows, "text"):
                words, first = word_hashes(batch.column("text"))
                if len(words):
                    window += [words, np.full(int((np.diff(first) > 0).sum()), START)]
                    size += len(words)
                if size > 3_000_000:
                    yield flush()
                    window, size = [], 0
        if size:
            yield flush()

    def add(part, pdf):
        words, which = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["words"]]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([whole(x) for x in pdf["counts"]])).astype(np.int64)
        return pd.DataFrame([(part, words.tobytes(), n.tobytes())], columns=["part", "words", "counts"])

    packed = "part int, words binary, counts binary"
    return stored(each_part(docs.select("text").mapInArrow(count, packed), parts, add, packed), "lm-unigrams")


def hot_words(table: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(words ascending, counts) of the most frequent words, number of words, number of texts with words."""

    def counts(batches):
        """Number of words by bin of their count; in bin -1 all words' places, in bin -2 the texts."""
        for pdf in batches:
            for words, n in zip(pdf["words"], pdf["counts"]):
                n, start = np.frombuffer(n, np.int64), np.frombuffer(words, np.uint64) == START
                b, entries = np.unique(bins(n[~start]), return_counts=True)
                yield pd.DataFrame({"bin": np.concatenate([b, [-1, -2]]), "entries": np.concatenate([entries, [n[~start].sum(), n[start].sum()]]).astype(np.int64)})

    known = stored(table.select("words", "counts").mapInPandas(counts, "bin long, entries long").groupBy("bin").agg(F.sum("entries").alias("entries")), "lm-histogram")
    least = heaviest(known.where("bin >= 0"), hot)
    totals = {r["bin"]: r["entries"] for r in known.where("bin < 0").collect()}

    def best(batches):
        for pdf in batches:
            for words, n in zip(pdf["words"], pdf["counts"]):
                words, n = np.frombuffer(words, np.uint64), np.frombuffer(n, np.int64)
                at = (bins(n) >= least) & (words != START)
                yield pd.DataFrame({"word": words[at].view(np.int64), "n": n[at]})

    top = table.select("words", "counts").mapInPandas(best, "word long, n long").toPandas()
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    everything, texts = totals.get(-1, 0), totals.get(-2, 0)
    order = np.argsort(words)
    return words[order], n[order], everything, texts


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, alpha: float = 0.4, hot: int = HOT, part_words: int = 1 << 24) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, score (sum of ln S), per_word."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    word_parts = max(16, 3 * shuffle_width(spark) // 2)
    table = unigrams(rows, word_parts)
    known, known_n, n_all, n_texts = hot_words(table, min(hot, HOT))
    parts = max(word_parts, int(n_all) // part_words)
    of_task = max(1, parts // max(TASKS, int(n_all) // part_words))
    tasks = -(-parts // of_task)
    parts = tasks * of_task
    piece_bytes = min(32 << 20, max(4 << 20, parts << 14))  # a piece has a row for each part, so more parts take larger pieces
    ranked = np.argsort(-known_n, kind="stable")  # codes are ranks, as frequent words then have small ones
    sent = spark.sparkContext.broadcast((known, known_n, ranked))

    def codes(words: np.ndarray, hot: np.ndarray, ranked: np.ndarray) -> np.ndarray:
        out = np.full(len(words), COLD, dtype=np.uint16)
        if len(hot):
            rank = np.empty(len(hot), np.uint16)
            rank[ranked] = np.arange(len(hot))
            at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
            found = hot[at] == words
            out[found] = rank[at[found]]
        return out

    columns = ["kind", "part", "piece", "ids", "sizes", "first", "second", "more", "number"]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    packed = "kind int, part int, piece binary, ids binary, sizes binary, first binary, second binary, more binary, number binary"

    def explode(batches):
        """Kind 0: the texts of a piece, and which of them hold its common bigrams; kind 1: its bigrams of a part, ``sizes`` their texts."""
        known, _, ranked = sent.value
        for rows in batches:
            for batch in slices(rows, "text", piece_bytes):
                words, first = word_hashes(batch.column("text"))
                n = np.diff(first)
                ids = pa.array(batch.column("doc_id"), pa.int64())
                valid = np.asarray(ids.is_valid(), dtype=bool) if len(ids) else np.zeros(0, bool)
                plain = np.asarray(ids.fill_null(0), dtype=np.int64)
                piece = hashlib.blake2b(plain.tobytes() + valid.tobytes() + first.astype(np.int64).tobytes() + words.tobytes(), digest_size=16).digest()
                held, out = [squeezed(np.zeros(0, np.uint32))] * 3, []
                if len(words):
                    before = np.concatenate([[START], words[:-1]])
                    starts = first[:-1][n > 0]
                    before[starts] = START
                    key = mix(before * np.uint64(0x9E3779B97F4A7C15) + words, 3)
                    at, number, text = [], [], []
                    for i in np.flatnonzero(n):
                        own = key[first[i] : first[i + 1]]
                        _, one, times = np.unique(own, return_index=True, return_counts=True)
                        at.append(one + first[i])
                        number.append(times)
                        text.append(np.full(len(one), i))
                    at, number, text = np.concatenate(at), np.concatenate(number), np.concatenate(text)
                    # Common bigrams: each a further text of the piece, dealt out again by ``gather``.
                    order = np.argsort(key[at], kind="stable")
                    start = np.flatnonzero(np.concatenate([[True], key[at[order[1:]]] != key[at[order[:-1]]]]))
                    texts = np.diff(start, append=len(order))
                    common = np.flatnonzero(texts >= COMMON)
                    rank = np.repeat(np.where(texts >= COMMON, np.cumsum(texts >= COMMON) - 1, -1), texts)
                    mine, rank = order[rank >= 0], rank[rank >= 0]
                    total = np.bincount(rank, weights=number[mine], minlength=len(common)).astype(np.int64)
                    held = [squeezed(np.concatenate([total, texts[common]])), steps(text[mine]), squeezed(number[mine].astype(np.uint32))]
                    rare = np.ones(len(at), bool)
                    rare[mine] = False
                    at, number, text = np.concatenate([at[rare], at[order[start[common]]]]), np.concatenate([number[rare], total]), np.concatenate([text[rare], len(n) + np.arange(len(common))])
                    v, w = before[at], words[at]
                    vc, wc = codes(v, known, ranked), codes(w, known, ranked)
                    vc[v == START] = HOT
                    part = part_of(np.where(wc == COLD, w, key[at]), parts)
                    for k, own in by_part(part, parts):
                        a, b, m = vc[own], wc[own], number[own]
                        many = np.flatnonzero(m > 1)
                        out.append((
                            1, k, piece, None, steps(text[own]), squeezed(a), squeezed(b),
                            v[own][a == COLD].tobytes() + w[own][b == COLD].tobytes(), squeezed(np.concatenate([many, m[many]]).astype(np.uint32)),
                        ))
                out.append((0, int.from_bytes(piece[:8], "little") % parts, piece, squeezed(plain), squeezed(n.astype(np.int64)), valid.tobytes(), *held))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)

    def sums(piece: bytes, text: np.ndarray, gain: np.ndarray) -> tuple:
        """A row of kind 2: sums of ``gain`` by text of a piece, for the texts that occur; as they are, since sums repeat from row to row."""
        start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        return (2, None, piece, np.add.reduceat(gain, start).tobytes(), steps(text[start]), None, None, None, None)

    def bigrams(_, pdf):
        """Of a task's parts: kind 0 as it came; kind 2: sums by text of a piece; kind 3: (v, text, n) whose c(v) is still to be known."""
        out, gains = list(pdf[pdf["kind"] == 0].itertuples(index=False, name=None)), {}
        for _, own in pdf[pdf["kind"] == 1].groupby("part"):
            out += bigrams_of(own, gains)
        for piece, each in gains.items():
            text, gain = (np.concatenate(x) for x in zip(*each))
            order = np.argsort(text, kind="stable")
            out.append(sums(piece, text[order], gain[order]))
        return pd.DataFrame(out, columns=columns)

    def bigrams_of(pdf, gains: dict[bytes, list[tuple]]) -> list[tuple]:
        """Rows of kind 3 of one part; its texts and their sums are added to ``gains``, by piece."""
        known, known_n, ranked = sent.value
        v, w, n, text, size = [], [], [], [], []
        for places, first, second, more, number in zip(pdf["sizes"], pdf["first"], pdf["second"], pdf["more"], pdf["number"]):
            a, b, rest = whole(first), whole(second), np.frombuffer(more, np.uint64)
            many = whole(number).reshape(2, -1)
            m = np.ones(len(a), dtype=np.int64)
            m[many[0]] = many[1]
            x, y = np.empty(len(a), np.uint64), np.empty(len(b), np.uint64)
            x[a < HOT], x[a == HOT], x[a == COLD] = known[ranked[a[a < HOT]]], START, rest[: (a == COLD).sum()]
            y[b != COLD], y[b == COLD] = known[ranked[b[b != COLD]]], rest[(a == COLD).sum() :]
            v.append(x), w.append(y), n.append(m), size.append(len(a)), text.append(walked(places))
        v, w, n, text = (np.concatenate(x) for x in (v, w, n, text))

        def lookup(words: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            return np.where(known[at] == words, known_n[at], 0) if len(known) else np.zeros(len(words), np.int64)

        _, which = np.unique(mix(v * np.uint64(0x9E3779B97F4A7C15) + w, 3), return_inverse=True)
        both = np.bincount(which, weights=n)[which]
        seen = both >= least
        own = lookup(w)
        cold = np.flatnonzero(own == 0)
        if len(cold):
            _, which = np.unique(w[cold], return_inverse=True)
            own[cold] = np.bincount(which, weights=n[cold])[which]
        above = np.where(v == START, n_texts, lookup(v))
        with np.errstate(divide="ignore"):
            gain = n * np.where(seen, np.log(both) - np.where(above > 0, np.log(np.maximum(above, 1)), 0.0), np.log(alpha) + np.log(own) - np.log(max(1, n_all)))
        ends = np.cumsum(size)
        for piece, s, e in zip(pdf["piece"], size, ends):
            start = e - s + np.flatnonzero(np.diff(text[e - s : e], prepend=-1))
            gains.setdefault(piece, []).append((text[start].astype(np.uint32), np.add.reduceat(gain[:e], start)))
        out = []
        open_ = np.flatnonzero(seen & (above == 0))
        if len(open_):
            piece = np.searchsorted(ends, open_, "right")
            names = list(pdf["piece"])
            for k, at in by_part(part_of(v[open_], word_parts) % tasks, tasks):
                used, count = np.unique(piece[at], return_counts=True)  # entries stay in the order of pieces, then texts
                mine = open_[at]
                out.append((3, k, None, b"".join(names[i] for i in used), squeezed(count.astype(np.uint32)), v[mine].tobytes(), steps(text[mine]), None, squeezed(n[mine].astype(np.uint32))))
        return out

    # Bigrams are the bulk: they move once and are not stored, so kind 0, which ``gather`` needs, passes through their parts.
    summed = stored(each_part(rows.mapInArrow(explode, packed), tasks, bigrams, packed), "lm-sums", by=["kind"]).select(*columns)

    def contexts(_, pdf):
        """Of a task's parts of the unigram table: sums of -n ln c(v) by text of a piece."""
        table, asked = pdf[pdf["kind"] == 9], pdf[pdf["kind"] == 3]
        found: dict[bytes, list[tuple]] = {}
        if len(asked):
            words, counts = (np.frombuffer(b"".join(table[c]), t) for c, t in (("first", np.uint64), ("second", np.int64)))
            order = np.argsort(words)
            words, counts = words[order], counts[order]
            for names, sizes, v, places, n in zip(asked["ids"], asked["sizes"], asked["first"], asked["second"], asked["number"]):
                ends = np.cumsum(whole(sizes))
                loss = -np.log(counts[np.searchsorted(words, np.frombuffer(v, np.uint64))]) * whole(n)
                places = walked(places)
                for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                    found.setdefault(names[16 * i : 16 * i + 16], []).append((places[a:b], loss[a:b]))
        out = []
        for piece, each in found.items():
            places, loss = (np.concatenate(x) for x in zip(*each))
            order = np.argsort(places, kind="stable")
            out.append(sums(piece, places[order], loss[order]))
        return pd.DataFrame(out, columns=columns)

    nothing = [F.lit(None).cast("binary").alias(c) for c in ("more", "number")]
    lookup = table.select(F.lit(9).alias("kind"), "part", *[F.lit(None).cast("binary").alias(c) for c in ("piece", "ids", "sizes")], F.col("words").alias("first"), F.col("counts").alias("second"), *nothing)
    further = each_part(lookup.unionByName(summed.where("kind = 3")), tasks, contexts, packed)

    def gather(key, pdf):
        base = pdf[pdf["kind"] == 0]
        ids, n, valid = whole(base["ids"].iloc[0]), whole(base["sizes"].iloc[0]), np.frombuffer(base["first"].iloc[0], bool)
        times, texts = whole(base["second"].iloc[0]).reshape(2, -1)
        total = np.zeros(len(ids) + len(times))
        added = pdf[pdf["kind"] == 2]
        for x, places in zip(added["ids"], added["sizes"]):
            total[walked(places)] += np.frombuffer(x, np.float64)
        text, number = walked(base["more"].iloc[0]), whole(base["number"].iloc[0])
        each = total[len(ids) :] / times
        total = (total[: len(ids)] + np.bincount(text, weights=np.repeat(each, texts) * number, minlength=len(ids))) / len(base)
        doc = pd.Series(ids, dtype="Int64").where(pd.Series(valid))
        one = pd.DataFrame({"doc_id": doc, "n_words": n, "score": total, "per_word": total / np.maximum(n, 1)})
        return pd.concat([one] * len(base))  # pieces that are alike in all are summed together

    pieces = summed.where("kind in (0, 2)").unionByName(further)
    return pieces.groupBy("piece").applyInPandas(gather, "doc_id long, n_words long, score double, per_word double")
