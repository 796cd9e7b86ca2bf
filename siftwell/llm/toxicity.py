r"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

Kernel.  Two words are compared by their common subsequences of ``ORDER`` characters that
lie within ``SPAN`` characters, each weighted by DECAY per character skipped (word ends count
as characters).  Inserted or left-out characters therefore cost weight, not the match; SPAN
lets one stand between each two of four letters.  All but letters and digits of any script
is dropped first (``i.d-i*o.t``, dashes, combining marks, zero-width characters), blanks of
any script separate words, A-Z are lower-cased, and a run of single letters (``i d i o t``)
is a word too, as are the letters of a word with one and the same character between each two
of them (``ixdxixoxt``).  Weights are divided by a function of the word's length.

Training.  From the labelled sentences of a bounded sample of documents (``most_toxic`` and
``most_clean`` rows, the first by a hash of the id) the words are counted by label and fold;
all of them, as many as the sample holds, train each machine in a task of its own, with a
row of half-precision values for each word.  The driver gets the machines only.  A sentence is toxic for a word in it, so a word is
an instance of both labels, weighted by the share of either label's documents that hold it.
Landmarks are words that tell the labels apart, spread out, and frequent clean words.  The
Nystroem map of the kernel to the landmarks is followed by a linear machine with squared
hinge loss, solved by Newton steps.  As the machine is linear in the kernel values, and
these are sums over subsequences, it folds exactly into one table of a weight per hashed
subsequence: a word is scored by looking up its own subsequences, whatever the number of
landmarks.  A text is described by its highest word and the number of its positive words; a
logistic curve over both, fitted on words of machines that did not see the text (three
folds), gives the score.

Scoring is a map over whole texts, without a shuffle; the table is 4 MB at any input size.

Defined results
- null, empty or wordless text: scored as a text whose highest word is at the floor.
- Labels that are null are ignored; of repeated labels of one document the highest counts.
- Without both labels in the sample every score is the share of toxic rows (0 if none).
- One row for each row of the input, repeats and null ids included; ties don't arise; other
  columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import hashes, raw, slices, spans

ORDER, SPAN, DECAY, BITS, LONGEST, STRIDE, FLOOR = 4, 7, 0.6, 20, 24, 12, -1.5
SHAPES = [(0, *rest) for rest in itertools.combinations(range(1, SPAN), ORDER - 1)]
_MIXERS = np.random.Generator(np.random.PCG64(97)).integers(0, 2**32, (ORDER, 1 << 16), dtype=np.uint32)
DROP, KEEP, BLANK = 0, 1, 2


def kind(point: int) -> int:
    if 0x09 <= point <= 0x0D:
        return BLANK
    return {"L": KEEP, "N": KEEP, "Z": BLANK}.get(unicodedata.category(chr(point))[0], DROP)


_KIND = np.array([kind(c) for c in range(1 << 16)], dtype=np.uint8)
FOLDS, SLICE = 3, 2 << 20  # bytes of text that are scored at a time
BIN_BITS = 14  # bins of the hash that labelled rows are sampled by


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 ``data`` and the rows' offsets in them; bytes, where all are ASCII."""
    if not len(data) or data.max() < 0x80:
        return data, offsets
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    out = data[at].astype(np.uint32)
    wide = np.flatnonzero(out >= 0x80)
    own = at[wide]
    b0, b1, b2, b3 = (np.concatenate([data, np.zeros(3, np.uint8)])[own + k].astype(np.uint32) & m for k, m in enumerate((0xFF, 0x3F, 0x3F, 0x3F)))
    two, three, four = (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
    out[wide] = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
    return out, np.concatenate([[0], np.cumsum(lead)])[offsets]


def kinds(data: np.ndarray) -> np.ndarray:
    if data.dtype == np.uint8:
        return _KIND[data]
    out = _KIND[data & 0xFFFF]
    high = np.flatnonzero(data > 0xFFFF)
    if len(high):
        one, which = np.unique(data[high], return_inverse=True)
        out[high] = np.array([kind(int(c)) if c < 0x110000 else DROP for c in one], np.uint8)[which]
    return out


def spelling(part: np.ndarray) -> str:
    return part.tobytes().decode("ascii" if part.dtype == np.uint8 else "utf-32-le", errors="replace")


def without_fill(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[int]:
    """Words of letters with one and the same character between each two of them, three other letters at least."""
    size = stops - starts
    at = np.flatnonzero((size >= 5) & (size % 2 == 1))
    fill = data[starts[at] + 1]
    at, fill = at[fill == data[starts[at] + 3]], fill[fill == data[starts[at] + 3]]
    return [int(i) for i, c in zip(at, fill) if (data[starts[i] + 1 : stops[i] : 2] == c).all() and (data[starts[i] : stops[i] : 2] != c).sum() >= 3]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, stops, row) of the words of a text column, long ones in overlapping pieces."""
    data, offsets = points(*raw(column))
    of = kinds(data)
    keep = of != DROP
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = np.where(of[keep] == BLANK, data.dtype.type(0x20), data[keep])
    data[(data >= ord("A")) & (data <= ord("Z"))] += 32
    # Where words are is told by the blanks alone.
    starts, stops, first = spans(np.where(data == 0x20, 0x20, 1).astype(np.uint8), offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    size = stops - starts
    more: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(size > LONGEST):
        more += [(s, min(s + LONGEST, stops[i]), row[i]) for s in range(starts[i], max(starts[i] + 1, stops[i] - STRIDE), STRIDE)]
    single = np.concatenate([[False], size == 1, [False]])
    edges = np.flatnonzero(single[1:] != single[:-1])
    spelt = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= 3]
    extra, at = [], len(data)
    for a, b in spelt:
        for r in np.unique(row[a:b]):
            own = a + np.flatnonzero(row[a:b] == r)
            if len(own) >= 3:
                for k in range(0, len(own), STRIDE):
                    piece = own[k : k + LONGEST]
                    extra.append(data[starts[piece]])
                    more.append((at, at + len(piece), r))
                    at += len(piece)
    for i in without_fill(data, starts, stops):
        letters = data[starts[i] : stops[i] : 2]
        for k in range(0, max(1, len(letters) - STRIDE), STRIDE):
            extra.append(letters[k : k + LONGEST])
            more.append((at, at + len(extra[-1]), row[i]))
            at += len(extra[-1])
    short = size <= LONGEST
    starts, stops, row = starts[short], stops[short], row[short]
    if more:
        a, b, r = np.array(more, dtype=np.int64).T
        starts, stops, row = np.concatenate([starts, a]), np.concatenate([stops, b]), np.concatenate([row, r])
        data = np.concatenate([data, *extra]) if extra else data
    return data, starts, stops, row


def by_length(data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """(which words, their characters with word ends) for each length."""
    size = stops - starts
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.ones((len(at), n + 2), dtype=data.dtype)
        x[:, 1:-1] = data[starts[at][:, None] + np.arange(n)]
        x[:, -1] = 2
        yield at, x


def features(x: np.ndarray):
    """(bucket, weight) arrays: one bucket for each word and place of a subsequence."""
    if x.dtype != np.uint8:
        x = (x ^ x >> 16) & 0xFFFF
    parts = [_MIXERS[k][x] for k in range(ORDER)]
    n = x.shape[1]
    for shape in SHAPES:
        m = n - shape[-1]
        if m > 0:
            code = sum((parts[k][:, o : o + m] for k, o in enumerate(shape[1:], 1)), parts[0][:, :m])
            yield (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), DECAY ** (shape[-1] + 1 - ORDER)


def norm(n: int) -> float:
    """Of a word of ``n`` characters, ends included."""
    return max(1e-9, sum(max(0, n - s[-1]) * DECAY ** (2 * (s[-1] + 1 - ORDER)) for s in SHAPES)) ** 0.5


@dataclass
class Machine:
    """table: weight of each hashed subsequence; curve: slope of highest word, of log count, offset."""

    table: np.ndarray
    bias: float
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)
    constant: float | None = None

    def state(self) -> tuple:
        """Plain values: broadcasts travel by a pickle that knows no class of this package."""
        return self.table, self.bias, self.curve, self.constant

    def words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), self.bias, dtype=np.float64)
        for at, x in by_length(data, starts, stops):
            total = np.zeros(len(at), dtype=np.float32)
            for bucket, weight in features(x):
                total += np.float32(weight) * self.table[bucket].sum(axis=1)
            out[at] += total / norm(x.shape[1])
        return out

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """(highest word, number of positive words, that word) of each text."""
        n = len(column)
        data, starts, stops, row = words(column)
        top, count, name = np.full(n, FLOOR), np.zeros(n, dtype=np.int64), [None] * n
        if len(starts):
            _, one, which = np.unique(hashes(data, starts, stops), return_index=True, return_inverse=True)
            value = self.words(data, starts[one], stops[one])[which]
            np.maximum.at(top, row, value)
            count += np.bincount(row[value > 0], minlength=n)
            for i in np.flatnonzero((value > 0) & (value == top[row])):
                if name[row[i]] is None:
                    name[row[i]] = spelling(data[starts[i] : stops[i]])
        return top, count, name

    def score(self, top: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(top), self.constant)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * top + b * np.log1p(count) + c, -50, 50)))


def solve(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, steps: int = 30, chunk: int = 4096) -> np.ndarray:
    """Squared-hinge linear machine over rows that are instances of both labels, with a cost each.

    Newton steps over the rows inside the margin; the last column is the bias.  Works in
    chunks, so no copy of ``x`` in full precision is made.
    """
    d = x.shape[1]
    w, inside = np.zeros(d), None
    while steps:
        steps -= 1
        value = np.concatenate([x[i : i + chunk].astype(np.float32) @ w.astype(np.float32) for i in range(0, len(x), chunk)])
        now = np.stack([value < 1, value > -1])
        if inside is not None and (now == inside).all():
            break
        inside = now
        p, q = toxic * now[0], clean * now[1]
        left, right = np.eye(d), np.zeros(d)
        left[-1, -1] = 1e-6
        rows = np.flatnonzero(p + q)
        for i in range(0, len(rows), chunk):
            some = rows[i : i + chunk]
            part = x[some].astype(np.float64)
            left += (part * (p + q)[some, None]).T @ part
            right += (p - q)[some] @ part
        w = np.linalg.solve(left, right)
    return w


def fit(names: list[bytes], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, landmarks: int = 160, cost: float = 100.0, caution: float = 3.0) -> Machine:
    """A machine from word counts by label (documents that hold the word)."""
    p, q = toxic / max(1, n_toxic), clean / max(1, n_clean)
    use = np.flatnonzero(p + q > 0)
    data, ends = points(np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)]).astype(np.int64))
    starts, ends = ends[:-1], ends[1:]
    apart = (p - q) / np.sqrt(p / max(1, n_toxic) + q / max(1, n_clean) + 1e-12)
    # Landmarks: the most telling words that are not alike (by spectra folded to 2048 cells), then frequent clean words.
    first = use[np.argsort(-apart[use], kind="stable")][: 25 * landmarks]
    folded = np.zeros((len(first), 2048), dtype=np.float32)
    for at, x in by_length(data, starts[first], ends[first]):
        for bucket, weight in features(x):
            np.add.at(folded, (at[:, None], bucket % 2048), np.float32(weight / norm(x.shape[1])))
    alike, chosen = np.zeros(len(first), dtype=np.float32), []
    for i in range(len(first)):
        if len(chosen) >= 3 * landmarks // 5 or apart[first[i]] <= 0:
            break
        if alike[i] < 0.8:
            chosen.append(int(first[i]))
            alike = np.maximum(alike, folded @ folded[i])
    taken = set(chosen)
    chosen += [int(i) for i in use[np.argsort(-q[use], kind="stable")][: landmarks - len(chosen)] if int(i) not in taken]

    def spectrum(i: int) -> dict[int, float]:
        x = next(by_length(data, starts[i : i + 1], ends[i : i + 1]))[1]
        out: dict[int, float] = {}
        for bucket, weight in features(x):
            for b in bucket[0].tolist():
                out[b] = out.get(b, 0.0) + weight / norm(x.shape[1])
        return out

    rows = {j: spectrum(j) for j in chosen}
    buckets = sorted({b for j in chosen for b in rows[j]})
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets))
    phi = np.zeros((len(buckets), len(chosen)))
    for c, j in enumerate(chosen):
        for b, v in rows[j].items():
            phi[place[b], c] = v
    value, vector = np.linalg.eigh(phi.T @ phi)
    half = vector[:, value > 1e-8] / np.sqrt(value[value > 1e-8])

    # A bucket is in few landmarks: phi by rows, as (landmark, value) from first[b] to first[b + 1].
    place_of, landmark = np.nonzero(phi)
    held, first = phi[place_of, landmark], np.searchsorted(place_of, np.arange(len(buckets) + 1))
    mapped = np.ones((len(use), half.shape[1] + 1), dtype=np.float16)
    for at, x in by_length(data, starts[use], ends[use]):
        for i in range(0, len(at), 512):
            some, cells, values = at[i : i + 512], [], []
            for bucket, weight in features(x[i : i + 512]):
                col = place[bucket]
                row, k = np.nonzero(col >= 0)
                b = col[row, k]
                n = first[b + 1] - first[b]
                entry = np.repeat(first[b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cells.append(np.repeat(row, n) * len(chosen) + landmark[entry])
                values.append(held[entry] * weight)
            total = np.bincount(np.concatenate([[0], *cells]), np.concatenate([[0.0], *values]), len(some) * len(chosen))
            mapped[some, :-1] = (total.reshape(len(some), -1) / norm(x.shape[1])).astype(np.float32) @ half.astype(np.float32)
    w = solve(mapped, cost * p[use], cost * caution * q[use])
    table = np.zeros(1 << BITS, dtype=np.float32)
    table[buckets] = phi @ (half @ w[:-1])
    return Machine(table, float(w[-1]))


def curve(top: np.ndarray, count: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on the highest word and the log count, slopes not below 0."""
    x = np.stack([top, np.log1p(count), np.ones(len(top))], axis=1)
    for cols in ([0, 1, 2], [0, 2], [1, 2]):
        w, z = np.zeros(len(cols)), x[:, cols]
        ridge = np.diag([1e-2] * (len(cols) - 1) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (label - p) - ridge @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            break
    full = np.zeros(3)
    full[cols] = w
    full[:2] = np.maximum(full[:2], 0)
    return tuple(float(v) for v in full)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 4000, most_clean: int = 8000) -> Machine:
    """Fit a machine on at most ``most_toxic + most_clean`` labelled rows (those with ``learn``, a condition on doc_id)."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if learn is not None:
        known = known.where(learn)
    # The first rows of either label by a hash of the id, as many bins of it as the bound holds: no sort, no task that gets them all.
    known = stored(known.withColumn("bin", F.shiftright(F.xxhash64("doc_id"), 64 - BIN_BITS)), "toxicity-labels")
    least = {1: most_toxic, 0: most_clean}
    upto, seen = {}, {0: 0, 1: 0}
    for b, label, n in known.groupBy("bin", "toxic").agg(F.count("*")).where("toxic in (0, 1)").orderBy("bin").collect():
        seen[label] += n
        if seen[label] <= least[label]:
            upto[label] = b
        else:
            least[label] = -1  # a later, smaller bin doesn't go in either
    chosen = [(F.col("toxic") == label) & (F.col("bin") <= b) for label, b in upto.items()]
    sample = known.where(functools.reduce(lambda x, y: x | y, chosen, F.lit(False))).select("doc_id", "toxic")
    # The sample has a bound, so it may be broadcast: 12,000 rows of 12 bytes.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(stored(sample, "toxicity-sample")), "doc_id")
    texts = stored(texts.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "toxicity-texts")

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, starts, stops, row = words(batch.column("text"))
                if not len(starts):
                    continue
                key = hashes(data, starts, stops)
                _, one, which = np.unique(key, return_index=True, return_inverse=True)
                pair = np.unique(which.astype(np.int64) * len(batch) + row)  # a word counts once in a text
                word, text = pair // len(batch), pair % len(batch)
                group = (batch.column("fold").to_numpy() * 2 + batch.column("toxic").to_numpy())[text].astype(np.int64)
                n = np.zeros((len(one), 2 * FOLDS), dtype=np.int64)
                np.add.at(n, (word, group), 1)
                names = [spelling(data[starts[i] : stops[i]]).encode() for i in one]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *[pa.array(n[:, k]) for k in range(2 * FOLDS)]], ["word", *[f"n{k}" for k in range(2 * FOLDS)]])

    counted = texts.mapInArrow(count, "word binary, " + ", ".join(f"n{k} long" for k in range(2 * FOLDS)))
    counted = stored(counted.groupBy("word").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(2 * FOLDS)]), "toxicity-words")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in texts.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n_label = [sum(n for (_, t), n in sizes.items() if t == label) for label in (0, 1)]

    def machine(key, table):
        """The machine without fold ``key``; FOLDS: of all."""
        order = pc.sort_indices(table["word"])
        names = table["word"].take(order).to_pylist()
        folds = [k for k in range(FOLDS) if k != key[0].as_py()]
        n = [sum(table[f"n{2 * k + t}"].take(order).to_numpy().astype(np.float64) for k in folds) for t in (0, 1)]
        own = fit(names, n[1], n[0], *(sum(sizes.get((k, t), 0) for k in folds) for t in (1, 0)))
        at = np.flatnonzero(own.table)
        return pa.table({"without": [key[0].as_py()], "at": [at.astype(np.int32).tobytes()], "weight": [own.table[at].tobytes()], "bias": [own.bias]})

    machines = {}
    if all(n_label):
        each = counted.withColumn("without", F.explode(F.array(*[F.lit(k) for k in range(FOLDS + 1)])))
        each = each.repartitionByRange(FOLDS + 1, "without").groupBy("without").applyInArrow(machine, "without long, at binary, weight binary, bias double")
        for r in each.collect():
            machines[r["without"]] = Machine(np.zeros(1 << BITS, np.float32), r["bias"])
            machines[r["without"]].table[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["weight"], np.float32)
    if not machines:
        return Machine(np.zeros(1 << BITS, np.float32), 0.0, constant=n_label[1] / max(1, sum(n_label)))

    others = spark.sparkContext.broadcast([machines[k].state() for k in range(FOLDS)])

    def unseen(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                fold = batch.column("fold").to_numpy()
                top, number = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
                for k in range(FOLDS):
                    at = np.flatnonzero(fold == k)
                    if len(at):
                        top[at], number[at], _ = Machine(*others.value[k]).texts(batch.column("text").take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(top), pa.array(number)], ["toxic", "top", "number"])

    seen = texts.select("text", "toxic", "fold").mapInArrow(unseen, "toxic int, top double, number long").toPandas()
    out = machines[FOLDS]
    out.curve = curve(seen["top"].to_numpy(), seen["number"].to_numpy(np.float64), seen["toxic"].to_numpy(np.float64))
    return out


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, n_toxic (words), worst (word)."""
    sent = docs.sparkSession.sparkContext.broadcast(machine.state())

    def run(batches):
        own = Machine(*sent.value)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                top, number, name = own.texts(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(top, number)), pa.array(number), pa.array(name, pa.string())], ["doc_id", "score", "n_toxic", "worst"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, n_toxic long, worst string")


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(machine.state())

    def run(batches):
        own = Machine(*sent.value)
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                top, number, _ = own.texts(batch.column(text_col))
                yield batch.filter(pa.array(own.score(top, number) < least))

    return docs.mapInArrow(run, docs.schema)
