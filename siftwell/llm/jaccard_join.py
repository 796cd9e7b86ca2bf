r"""N-gram Jaccard join: links and components by prefixes under several global token orders.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased, words are
runs of other than ``[\x20\x09-\x0D]``; with fewer words the whole sequence is one).  Two
sets link when 100 * |A n B| >= percent * |A u B|.  In any order of all tokens, linked sets
share at least l tokens among the first n - ceil(percent/100 * n) + l of each.  All
orders used here put tokens by how many sets hold them, fewest first, in classes of about
a twelfth of a doubling and mixed anew within a class by each order.

1. Texts are read once.  A window of about half a million tokens sends each distinct token once to
   the token's part, so a token that all documents hold is one entry for each window.  Copies
   within a window send theirs once.  A part adds up how many sets hold each of its tokens,
   all of them, without a cap, and returns the shared ones with their class to the windows.
   Tokens of a single set, most of all, end there: they can't be in an intersection.
2. A window now knows the shared tokens of each of its sets.  Sets with fewer shared tokens
   than a link takes are done.  The others are stored: shared tokens, and a prefix under
   each of the ``ORDERS`` orders, of which unshared tokens are the first.  Equal sets are one
   node from here on.
3. The prefix for l = 1 under the first order makes buckets by token.  In each bucket all
   nodes meet one hub (the node with the fewest unshared tokens): as many pairs as rows.
   Components of the links found are formed first.
4. While the buckets that hold several components would form more pairs than there were rows,
   nodes outside a bucket's main component meet ``HUBS`` further hubs of it, chosen by a hash, and
   the components found are joined; ``most_turns`` times at most.  A group of copies of any size
   is one component then, so its pairs are never formed.  All pairs across components
   that are left, of which one lies outside the bucket's main one, are formed at last.
5. A pair is tried only if its sizes, and the places of its first shared token in both sets,
   allow a link.  Candidates of all steps must share l = 5 tokens (less for tiny sets) of their prefixes
   under every order, the filters intersected, before their shared tokens are compared.
6. Components over all links.

A token is known by the number of its part and 44 bits within it, a set by 128 bits of
digest, in candidate search by 64 of these and its size.

Defined results
- null, empty or blank text: n_shingles 0, linked with nothing.
- Equal sets always link.  Rows that repeat an id count as one node, whatever their texts.
- A null id takes no part: its row has its n_shingles and a null component.
- Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path, power_of, shuffle_width, stored
from .components import components
from .tokens import compact, mix, restored, slices, word_hashes

KEY = ["d1", "d2", "n"]
ORDERS, SHARED, HUBS = 3, 5, 3
LOW = 44  # bits of a token within its part
MOST_PARTS, MOST_SETS = 1 << 20, 60_000
_STEPS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, first = word_hashes(column)
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        total += words[k : k + len(total)] * _STEPS[k % len(_STEPS)] * np.uint64(2 * (k // len(_STEPS)) + 1)
    total = mix(total)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= width:
            a = np.sort(total[lo : hi - width + 1])
            out.append(a[np.concatenate([[True], a[1:] != a[:-1]])])
        elif hi > lo:
            whole = np.zeros(1, np.uint64)
            for k in range(lo, hi):
                whole = mix(whole * _STEPS[1] + words[k], 1 + hi - lo)
            out.append(whole)
        else:
            out.append(total[:0])
    return out


def digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def least_common(n, percent: int):
    """Tokens that a set of size ``n`` shares with any set that it links with, at least (ints or arrays)."""
    return -(-percent * n // 100)


def shared_least(n: Column, percent: int) -> Column:
    """How many prefix tokens linked sets share, of which the smaller has ``n`` tokens."""
    small = F.ceil(n * percent / 100)
    return F.least(F.lit(SHARED), F.greatest(F.lit(1), small))


def low_bytes(tokens: np.ndarray) -> bytes:
    """The ``LOW`` bits of tokens, six bytes each."""
    low = tokens & np.uint64((1 << LOW) - 1)
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint16).tobytes()


def low_of(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Ascending in the token."""
    return ((tokens >> np.uint64(LOW)) * np.uint64(parts) >> np.uint64(20)).astype(np.int64)


def holders(n: np.ndarray) -> np.ndarray:
    """Class of a token by the number of sets that hold it."""
    return np.minimum(255, np.round(12 * np.log2(n))).astype(np.uint8)


FIELDS = ["kind", "part", "piece", "a", "b", "c", "d"]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
PACKED = "kind int, part int, piece long, a binary, b binary, c binary, d binary"


def frame(rows: list[tuple], names: list[str] = FIELDS, types: list[pa.DataType] = TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)


def windows(docs: DataFrame, width: int, parts: int, window_tokens: int) -> DataFrame:
    """Rows of kind 0: a window's documents and the tokens that several of its sets hold; of kind 1: a part's tokens of a window.

    Kind 0: a: id, validity, size and digest of each document; b: which send tokens; c: tokens of
    several sets; d: how many, and which.  Kind 1: a: places of the sets; b: tokens of one set
    each; c: tokens of several sets; d: of how many.
    """

    def run(batches):
        context = TaskContext.get()
        piece = (context.partitionId() if context else 0) << 32
        ids, sets, size = [], [], 0

        def flush():
            n = np.array([len(s) for s in sets], np.int64)
            names = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            valid = np.array([x is not None for x in ids])
            plain = np.array([x or 0 for x in ids], np.int64)
            # Of equal sets the first that may send; a null id sends nothing.
            able = np.flatnonzero(valid & (n > 0))
            _, first = np.unique(names[able], axis=0, return_index=True)
            sends = np.sort(able[first])
            tokens = np.concatenate([sets[i] for i in sends]) if len(sends) else np.zeros(0, np.uint64)
            place = np.repeat(sends, n[sends])
            by = np.argsort(tokens)
            t = tokens[by]
            alone = np.concatenate([[True], t[1:] != t[:-1]]) & np.concatenate([t[1:] != t[:-1], [True]]) if len(t) else np.zeros(0, bool)
            several, held = t[~alone], place[by][~alone]
            start = np.flatnonzero(np.concatenate([[True], several[1:] != several[:-1]])) if len(several) else np.zeros(0, np.int64)
            several, count = several[start], np.diff(start, append=len(several))
            one = np.zeros(len(tokens), bool)
            one[by[alone]] = True
            tokens, place = tokens[one], place[one]
            part, more = part_of(tokens, parts), part_of(several, parts)
            by = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            tokens, place, part = tokens[by], place[by], part[by]
            cuts, more_cuts = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(more, np.arange(parts + 1))
            rows = [(0, piece % parts, piece, plain.tobytes() + n.tobytes() + names.tobytes() + valid.tobytes(), sends.astype(np.uint16).tobytes(), several.tobytes(), count.astype(np.uint32).tobytes() + held.astype(np.uint16).tobytes())]
            for k in np.flatnonzero(np.diff(cuts) + np.diff(more_cuts)).tolist():
                i, j, x, y = cuts[k], cuts[k + 1], more_cuts[k], more_cuts[k + 1]
                rows.append((1, k, piece, compact(place[i:j]), low_bytes(tokens[i:j]), low_bytes(several[x:y]), count[x:y].astype(np.uint32).tobytes()))
            return frame(rows)

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):  # hashing takes some sixty times a slice's bytes
                for doc_id, own in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), width)):
                    if sets and (size + len(own) > window_tokens or len(sets) >= MOST_SETS):
                        yield flush()
                        ids, sets, size, piece = [], [], 0, piece + 1
                    ids.append(doc_id)
                    sets.append(own)
                    size += len(own)
        if sets:
            yield flush()

    return docs.mapInArrow(run, PACKED)


def counted(dealt: DataFrame, parts: int) -> DataFrame:
    """Each part in a task of its own.  Kind 0 as it is; kind 2: of a part, a window's shared tokens (a, b: of one of its sets; c: of several) with their class (d)."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        out = [table.filter(pa.array(kinds == 0))]
        cells = table.filter(pa.array(kinds == 1)).to_pylist()
        if cells:
            one, several = [low_of(x["b"]) for x in cells], [low_of(x["c"]) for x in cells]
            tokens = np.concatenate(one + several)
            sets = np.concatenate([np.ones(sum(map(len, one)), np.int64), *[np.frombuffer(x["d"], np.uint32).astype(np.int64) for x in cells]])
            by = np.argsort(tokens)
            t = tokens[by]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            total = np.add.reduceat(sets[by], start)
            held = np.empty(len(t), np.int64)
            held[by] = np.repeat(total, np.diff(start, append=len(t)))
            shared, level = held > 1, holders(held)
            rows, i, j = [], 0, sum(map(len, one))
            for x, a, b in zip(cells, one, several):
                keep = np.flatnonzero(shared[i : i + len(a)])
                if len(keep) or len(b):
                    rows.append((2, x["part"], x["piece"], compact(restored(x["a"], len(a))[keep]), low_bytes(a[keep]), b"", level[i : i + len(a)][keep].tobytes() + level[j : j + len(b)].tobytes()))
                i, j = i + len(a), j + len(b)
            out.append(pa.Table.from_batches([frame(rows)]))
        return pa.concat_tables([x.cast(pa.schema(list(zip(FIELDS, TYPES)))) for x in out])

    def whole(batches):
        held = [b for b in batches if len(b)]
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return dealt.repartitionById(parts, F.col("part")).mapInArrow(whole, PACKED)


PREFIXES = [f"p{k}" for k in range(ORDERS)]


def shared_sets(known: DataFrame, percent: int, parts: int) -> DataFrame:
    """Kind 0: documents (doc_id, d1, d2, n); kind 1: sets with enough shared tokens (d1, n, alone, lead, tokens, prefixes)."""
    names = ["kind", "doc_id", "d1", "d2", "n", "alone", "lead", "tokens", *PREFIXES]
    lists = pa.list_(pa.int64())
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), lists, *[lists] * ORDERS]

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        base = table.filter(pa.array(kinds == 0)).to_pylist()[0]
        size = len(base["a"]) // 33
        ids, n = np.frombuffer(base["a"], np.int64, size), np.frombuffer(base["a"], np.int64, size, 8 * size)
        digests, valid = np.frombuffer(base["a"], np.int64, 2 * size, 16 * size).reshape(size, 2), np.frombuffer(base["a"], bool, size, 32 * size)
        several = np.frombuffer(base["c"], np.uint64)
        count = np.frombuffer(base["d"], np.uint32, len(several)).astype(np.int64)
        held = np.frombuffer(base["d"], np.uint16, int(count.sum()), 4 * len(several)).astype(np.int64)
        # A window's own tokens of several sets, as numbers of part and low bits like all others.
        part = part_of(several, parts)
        own = part.astype(np.uint64) << np.uint64(LOW) | several & np.uint64((1 << LOW) - 1)
        level = np.zeros(len(several), np.uint8)
        place, token, classes = [np.repeat(np.arange(0), 0)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for x in table.filter(pa.array(kinds == 2)).to_pylist():
            low = low_of(x["b"])
            found = np.frombuffer(x["d"], np.uint8)
            place.append(restored(x["a"], len(low)))
            token.append(np.uint64(x["part"]) << np.uint64(LOW) | low)
            classes.append(found[: len(low)])
            at = np.searchsorted(part, [x["part"], x["part"] + 1])
            level[at[0] : at[1]] = found[len(low) :]
        place, token, classes = np.concatenate([*place, held]), np.concatenate([*token, np.repeat(own, count)]), np.concatenate([*classes, np.repeat(level, count)])
        shared = np.bincount(place, minlength=size)
        able = np.flatnonzero((shared > 0) & (shared >= least_common(n, percent)))
        chosen = np.isin(place, able)
        place, token, classes = place[chosen], token[chosen], classes[chosen]
        by = np.lexsort((token, place))
        place, token, classes = place[by], token[by], classes[by]
        first = np.searchsorted(place, able)
        rows = []
        for i, lo, hi in zip(able.tolist(), first.tolist(), np.append(first[1:], len(place)).tolist()):
            mine, weight, size_ = token[lo:hi], classes[lo:hi].astype(np.uint64) << np.uint64(56), int(n[i])
            alone, least = size_ - (hi - lo), least_common(size_, percent)
            # Unshared tokens are the first of every order.
            lead, whole = size_ - least + 1 - alone, size_ - least + min(SHARED, least) - alone
            cut = [mine[np.argsort(weight | mix(mine, 11 + o) >> np.uint64(8), kind="stable")[:whole]].view(np.int64) for o in range(ORDERS)]
            rows.append((1, None, int(digests[i, 0]), None, size_, alone, lead, mine.view(np.int64), *cut))
        docs = pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(size, np.int32)), pa.array(ids, mask=~valid), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(n.astype(np.int32)), *[pa.nulls(size, t) for t in types[5:]]], names
        )
        return pa.Table.from_batches([docs, frame(rows, names, types)] if rows else [docs])

    schema = "kind int, doc_id long, d1 long, d2 long, n int, alone int, lead int, tokens array<long>, " + ", ".join(f"{p} array<long>" for p in PREFIXES)
    return known.groupBy("piece").applyInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, an, b, bn) those that pass the filters of all orders, and link."""
    columns = ["tokens", *PREFIXES]
    side = lambda x: sets.select(F.col("d1").alias(x), F.col("n").alias(f"{x}n"), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    both = pairs.join(side("a"), ["a", "an"]).join(side("b"), ["b", "bn"])
    least = shared_least(F.least("an", "bn"), percent)
    for p in PREFIXES:
        both = both.where(F.size(F.array_intersect(f"a_{p}", f"b_{p}")) >= least)
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * common >= percent * (F.col("an") + F.col("bn") - common)).select("a", "an", "b", "bn")


def fits(x: str, y: str, percent: int) -> Column:
    """Whether two sets can link, the token being the first that they share.

    x, y: prefixes of the columns n (size) and at (place of the token in the set, from 0).  The
    tokens before it are not shared, so n - at bounds the intersection.  Where the token is
    not the first one, a pair is lost here, but not in the bucket of its first.
    """
    a, b = F.col(f"{x}n"), F.col(f"{y}n")
    most = F.least(a - F.col(f"{x}at"), b - F.col(f"{y}at"))
    return (100 * a >= percent * b) & (100 * b >= percent * a) & (100 * most >= percent * (a + b - most))


def ordered(x: str, y: str) -> list[Column]:
    """Columns a, an, b, bn of the pair of ``x`` and ``y``, the smaller first."""
    left, right = F.struct(F.col(f"{x}d1").alias("d1"), F.col(f"{x}n").alias("n")), F.struct(F.col(f"{y}d1").alias("d1"), F.col(f"{y}n").alias("n"))
    a, b = F.least(left, right), F.greatest(left, right)
    return [a["d1"].alias("a"), a["n"].alias("an"), b["d1"].alias("b"), b["n"].alias("bn")]


def merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` (d1, n, label) after ``links`` between digests have joined components."""
    name = lambda x: named.select(F.col("d1").alias(x), F.col("n").alias(f"{x}n"), F.col("label").alias(f"{x}_label"))
    met = links.join(name("a"), ["a", "an"]).join(name("b"), ["b", "bn"]).select("a_label", "b_label")
    after = components(met, "a_label", "b_label").select(F.col("node").alias("label"), F.col("label").alias("after"))
    return stored(named.join(after, "label", "left").select("d1", "n", F.coalesce("after", "label").alias("label")), "join-labels")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, window_tokens: int = 1 << 19, most_runs: int = 4096, most_turns: int = 8) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = min(MOST_PARTS, max(16, 2 * shuffle_width(spark)))
    sets_path = new_path(spark, "join-sets")
    spent = [f"{sets_path}/kind=1"]

    def held(df: DataFrame, tag: str) -> DataFrame:
        """Stored until all links are found."""
        spent.append(new_path(spark, tag))
        return stored(df, tag, spent[-1])

    found = stored(shared_sets(counted(windows(rows, width, parts, window_tokens), parts), percent, parts), "join-sets", sets_path, by=["kind"])

    # Classes of equal sets; a large one is spread over runs of ids on the way back.
    runs = power_of(4, max(64, shuffle_width(spark)), most_runs)
    own = found.where("kind = 0").select("doc_id", *KEY).withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    by_run = own.where("n > 0 and doc_id is not null").groupBy("run", *KEY).agg(F.min("doc_id").alias("node"))
    classes = stored(by_run.groupBy(*KEY).agg(F.min("node").alias("node")), "join-classes")

    sets = held(found.where("kind = 1").select("d1", "n", "alone", "lead", "tokens", *PREFIXES).dropDuplicates(["d1", "n"]), "join-nodes")
    index = sets.select("d1", "n", "alone", F.posexplode(F.slice(PREFIXES[0], F.lit(1), F.col("lead"))).alias("pos", "token")).select("d1", "n", "alone", (F.col("alone") + F.col("pos")).alias("at"), "token")
    # Hubs and main components are tables of their own, so that Spark can split a hot bucket's rows in the joins with them.
    hubs = index.groupBy("token").agg(F.count("*").alias("nodes"), F.min(F.struct("alone", "d1", "n", "at")).alias("hub")).where("nodes > 1")
    hubs = held(hubs.select("token", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("d1", "n", "at")]), "join-hubs")
    buckets = held(index.join(hubs, "token"), "join-buckets")
    first = buckets.where(((F.col("d1") != F.col("hub_d1")) | (F.col("n") != F.col("hub_n"))) & fits("", "hub_", percent))
    links = held(verified(first.select(*ordered("", "hub_")).distinct(), sets, percent), "join-links")
    named = merged(classes.select("d1", "n", F.col("node").alias("label")), links)

    rows, known, turn = buckets.count(), buckets.select("token", "d1", "n", "at"), 0
    while True:
        known = known.join(named, ["d1", "n"])
        main = known.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("labels"), F.sum("c").alias("nodes"), F.max(F.struct("c", "label")).alias("most"))
        main = held(main.where("labels > 1").select("token", "nodes", F.col("most.label").alias("main")), "join-main")
        known = held(known.join(main, "token"), "join-known")
        pairs = known.agg(F.sum(F.when(F.col("label") != F.col("main"), F.col("nodes")))).first()[0] or 0
        if pairs <= rows or turn == most_turns:
            break
        picked = [F.min(F.struct(F.xxhash64("d1", "n", F.lit(HUBS * turn + k)).alias("by"), "d1", "n", "at")) for k in range(HUBS)]
        more_hubs = held(known.where("label = main").groupBy("token").agg(F.array(*picked).alias("hubs")), "join-hubs")
        asked = known.where("label <> main").join(more_hubs, "token").select("d1", "n", "at", F.explode("hubs").alias("hub"))
        asked = asked.select("d1", "n", "at", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("d1", "n", "at")]).where(fits("", "hub_", percent))
        more = held(verified(asked.select(*ordered("", "hub_")).distinct(), sets, percent), "join-more-links")
        if more.isEmpty():
            break
        named, known, turn = merged(named, more), known.select("token", "d1", "n", "at"), turn + 1

    # A pair is formed in the bucket of its first shared token alone, if it passes the first order's filter.
    known = known.join(sets.select("d1", "n", PREFIXES[0]), ["d1", "n"])
    side = lambda x: known.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("d1", "n", "at", "label", "main", PREFIXES[0])])
    outside = side("b").where("b_label <> b_main").drop("b_main")
    met = side("a").join(outside, "token").where((F.col("a_label") != F.col("b_label")) & ((F.col("a_label") == F.col("a_main")) | (F.col("a_d1") < F.col("b_d1"))) & fits("a_", "b_", percent))
    both = F.array(F.array_intersect(f"a_{PREFIXES[0]}", f"b_{PREFIXES[0]}"))
    met = met.where(F.exists(both, lambda x: (F.get(x, F.lit(0)) == F.col("token")) & (F.size(x) >= shared_least(F.least("a_n", "b_n"), percent))))
    more = held(verified(met.select(*ordered("a_", "b_")).distinct(), sets, percent), "join-more-links")
    if not more.isEmpty():
        named = merged(named, more)

    for path in spent:
        drop_path(spark, path)
    labels = named.withColumnRenamed("label", "component_id")
    spread = by_run.select("run", *KEY).join(labels, ["d1", "n"])
    done = own.where("n > 0 and doc_id is not null").join(spread, ["run", *KEY]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return done.unionByName(own.where("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of ``docs`` without those that a smaller id of their component stands for."""
    gone = near_classes(docs, id_col, text_col, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
