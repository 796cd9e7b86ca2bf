"""LM scoring, toxicity, top-k search, Jaccard join and WARC against brute force and round trips."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import common, lm_scoring, tokens, toxicity, warc
from siftwell.llm.jaccard_join import near_classes, one_of_each
from siftwell.llm.lm_scoring import score_texts
from siftwell.llm.topk_search import top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, token string, n int"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def words(t):
    return WORD.findall(lower(t))


def test_word_hashes():
    texts = ["Hello  wOrld\x0bhello x", None, "", " \xa0é À é ", "hello", "a", "A b", "x" * 5000, " y"]
    column = pa.array(["pad", *texts]).slice(1)
    hashes, first = tokens.word_hashes(column)
    known = {}
    for i, t in enumerate(texts):
        own = hashes[first[i] : first[i + 1]]
        assert len(own) == len(words(t))
        for w, h in zip(words(t), own):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


# --- LM scoring --------------------------------------------------------------


def brute_scores(texts, least=2, alpha=0.4):
    lists = [words(t) for t in texts]
    pairs = [list(zip(["", *w], w)) for w in lists]
    two, one = Counter(p for x in pairs for p in x), Counter(w for x in lists for w in x)
    one[""] = sum(bool(x) for x in lists)
    n = sum(len(x) for x in lists)
    s = lambda v, w: math.log(two[v, w]) - math.log(one[v]) if two[v, w] >= least else math.log(alpha * one[w] / n)
    return [(len(x), sum(s(v, w) for v, w in p)) for x, p in zip(lists, pairs)]


@pytest.mark.parametrize("hot", [3, 65_000])
def test_lm_scores(spark, hot):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += ["The the THE the", None, "", " \n", "one", texts[0], texts[0], "Is onhe. " * 3000, "long" * 9000]
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "x", 1)]
    want = brute_scores([r[1] for r in rows])
    got = score_texts(spark.createDataFrame(rows, EXTRA).repartition(3), hot=hot).collect()
    key = lambda i, n, s: (str(i), n, round(s, 6))
    assert sorted(key(r.doc_id, r.n_words, r.score + 0.0) for r in got) == sorted(key(r[0], *w) for r, w in zip(rows, want))


def test_lm_empty(spark):
    assert score_texts(spark.createDataFrame([], EXTRA)).count() == 0
    assert score_texts(spark.createDataFrame([(1, None, "", 1)], EXTRA)).first().score == 0


def test_lm_bigrams_are_not_stored(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lm_scoring, "stored", lambda df, *a, **b: kept.append(common.stored(df, *a, **b)) or kept[-1])
    texts = [f"a{i} b c{i % 7} d e f{i % 3}" for i in range(300)]
    got = score_texts(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], EXTRA), hot=2).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == [(i, round(s, 6)) for i, (_, s) in enumerate(brute_scores(texts))]
    kinds = {r.kind for df in kept if "kind" in df.columns for r in df.select("kind").collect()}
    assert kinds == {0, 2, 3}


def test_lm_sums_of_many_parts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lm_scoring, "stored", lambda df, *a, **b: kept.append(common.stored(df, *a, **b)) or kept[-1])
    monkeypatch.setattr(lm_scoring, "TASKS", 2, raising=False)
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 700}" for _ in range(120)) for _ in range(50)]
    rows = [(i, t, "x", 1) for i, t in enumerate([*texts, texts[0]])]
    got = score_texts(spark.createDataFrame(rows, EXTRA).repartition(2), hot=9, part_words=1 << 20).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == [(i, round(s, 6)) for i, (_, s) in enumerate(brute_scores([r[1] for r in rows]))]
    rows_of = Counter((r.kind, bytes(r.piece or b"")) for df in kept if "kind" in df.columns for r in df.select("kind", "piece").collect())
    assert {n for (kind, _), n in rows_of.items() if kind == 2} == {2}  # at least 16 parts, but two tasks


# --- toxicity ----------------------------------------------------------------


def prose(rng, toxic, insults=("blorfo", "quarnith", "zedoxal")):
    w = ["".join(rng.choice(["an", "er", "ti", "lo", "ma", "se"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    if toxic:
        for _ in range(3):
            w[rng.randrange(60)] = rng.choice(insults)
    return " ".join(w)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, i % 5 == 0), i % 5 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], EXTRA)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity(spark, labelled):
    docs, labels, truth = labelled
    machine = toxicity.train(docs, labels, learn="doc_id % 3 <> 0")
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id % 3 = 0"), machine).collect()}
    assert np.mean([(s >= 0.5) == truth[i] for i, s in got.items()]) >= 0.97
    rng = random.Random(5)
    odd = ["bl-or*fo", "blxorfo", "q u a r n i t h", "quarniith", "zed.oxal", "blorfos"]
    cases = [(k, prose(rng, False) + f" {x} {x} " + prose(rng, False), "x", 1) for k, x in enumerate(odd)]
    cases += [(10, None, "x", 1), (11, "", "x", 1), (12, "x" * 100_000, "x", 1), (None, prose(rng, True), "x", 1), (13, " ".join(prose(rng, False) for _ in range(300)) + " blorfo blorfo quarnith", "x", 1)]
    scores = [(r.doc_id, r.score) for r in toxicity.score(spark.createDataFrame(cases, EXTRA).coalesce(1), machine).collect()]
    by_id = dict(scores)
    assert len(scores) == len(cases)
    assert sum(by_id[k] >= 0.5 for k in range(len(odd))) >= len(odd) - 1
    assert by_id[10] == by_id[11] < 0.5 and by_id[12] < 0.5 and by_id[13] > 0.5 and by_id[None] > 0.5
    kept = toxicity.keep_clean(spark.createDataFrame(cases, EXTRA), machine)
    assert kept.columns == ["doc_id", "text", "token", "n"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, s in scores if s < 0.5)


def test_toxicity_of_split_insults(spark, labelled):
    docs, labels, _ = labelled
    machine = toxicity.train(docs, labels)
    rng = random.Random(6)
    fills = ["x", "7", "\u2013", "\u2022", "\u200b", "\u00b7", "\u0336", "\u00a0", "\U0001f600"]
    odd = [c.join(w) for w in ("blorfo", "quarnith", "zedoxal") for c in fills] + ["blo\u2013rfo", "quarn\u2022ith"]
    cases = [(k, prose(rng, False) + f" {x} {x} " + prose(rng, False), "x", 1) for k, x in enumerate(odd)]
    plain = [(100 + k, prose(rng, False) + f" \u00e9\u00e0 {c} " + prose(rng, False), "x", 1) for k, c in enumerate(fills)]
    by_id = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(cases + plain, EXTRA).coalesce(1), machine).collect()}
    assert [x for k, x in enumerate(odd) if by_id[k] < 0.5] == []
    assert [k for k, *_ in plain if by_id[k] >= 0.5] == []


def test_toxicity_learns_from_all_words_of_the_sample(spark):
    """Insults that stand in one toxic row each, behind 25,000 words that stand in two of either label."""
    names = [f"w{k}q" for k in range(25_000)]
    insults = [f"{a}{b}" for a in ("blorfo", "quarnith") for b in ("", "s", "ed", "ing", "a", "ik", "um", "esk")]
    rows = [(i, " ".join(names[i % 20 * 1250 : i % 20 * 1250 + 1250]), i // 40) for i in range(80)]
    rows = [(i, t + (" " + insults[i - 40] if 40 <= i < 56 else ""), y) for i, t, y in rows]
    machine = toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"))
    top, _, _ = machine.texts(pa.array([*insults, *names[:50]]))
    assert min(top[: len(insults)]) > 0 > max(top[len(insults) :])


def test_words_are_of_characters():
    texts = ["B\u2013l\u00b7o  \u00c9t\u00e9\u0301\u00a0\U0001f600x \U00020000", None, "\u200b", "a1b1c", "plain"]
    data, starts, stops, row = toxicity.words(pa.array(["pad", *texts]).slice(1))
    got = sorted((int(r), toxicity.spelling(data[a:b])) for a, b, r in zip(starts, stops, row))
    assert got == sorted([(0, "blo"), (0, "\u00c9t\u00e9"), (0, "x"), (0, "\U00020000"), (3, "a1b1c"), (3, "abc"), (4, "plain")])


def test_folded_table_is_the_kernel_machine():
    """Kernel values, Nystroem map, solver and folded table, against a machine on the kernel matrix by brute force."""
    names = ["blorfo", "blorfa", "anertima", "lose", "maser", "tier", "quarnith", "quarnit", "zed", "xblorfox"]
    held = np.array([[9.0, 7, 0, 1, 0, 0, 5, 4, 0, 2], [0.0, 0, 30, 20, 22, 25, 0, 1, 9, 0]])
    n, cost, caution = (10, 40), 100.0, 3.0
    machine = toxicity.fit([x.encode() for x in names], held[0], held[1], *n, landmarks=len(names), cost=cost, caution=caution)

    def phi(word):
        s, out = "\x01" + word + "\x02", {}
        for at in itertools.combinations(range(len(s)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                key = "".join(s[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] - 3) / toxicity.norm(len(s))
        return out

    spectra = [phi(x) for x in names]
    kernel = np.array([[sum(v * b.get(k, 0) for k, v in a.items()) for b in spectra] for a in spectra])
    value, vector = np.linalg.eigh(kernel)
    x = kernel @ vector[:, value > 1e-8] / np.sqrt(value[value > 1e-8])
    assert np.allclose(x @ x.T, kernel)  # with all words as landmarks the map is exact
    x = np.hstack([x, np.ones((len(names), 1))])
    p, q, w = cost * held[0] / n[0], cost * caution * held[1] / n[1], np.zeros(x.shape[1])

    def loss(w):
        v = x @ w
        return 0.5 * w[:-1] @ w[:-1] + 0.5e-6 * w[-1] ** 2 + 0.5 * p @ np.maximum(0, 1 - v) ** 2 + 0.5 * q @ np.maximum(0, 1 + v) ** 2

    for _ in range(20_000):  # plain descent with a step from the largest curvature
        v = x @ w
        slope = np.append(w[:-1], 1e-6 * w[-1]) + x.T @ (q * np.maximum(0, 1 + v) - p * np.maximum(0, 1 - v))
        w -= slope / (1 + np.linalg.norm(x.T * (p + q) @ x, 2))
    data = np.frombuffer("".join(names).encode(), np.uint8)
    ends = np.cumsum([0, *map(len, names)])
    got = machine.words(data, ends[:-1], ends[1:])
    assert got == pytest.approx(x @ w, abs=0.02) and loss(w) > 0
    assert ((got > 0) == (held[0] > held[1])).mean() >= 0.9


def test_toxicity_of_repeated_rows_and_ties(spark, labelled):
    """Rows that repeat get equal scores, each its own row; labels that repeat or differ count once, as toxic."""
    docs, labels, truth = labelled
    twice = labels.union(labels).union(labels.where("doc_id = 5").selectExpr("doc_id", "0 as toxic"))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, twice)
    assert one.bias == two.bias and (one.table == two.table).all() and one.curve == two.curve
    some = docs.where("doc_id < 20")
    rows = toxicity.score(some.union(some).union(some.selectExpr("null", "text", "token", "n")), one).collect()
    assert len(rows) == 60
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert all(len(v) == 2 and v[0] == v[1] for k, v in by_id.items() if k is not None)
    assert sorted(by_id[None]) == sorted(v[0] for k, v in by_id.items() if k is not None)


def test_toxicity_without_labels(spark, labelled):
    docs, labels, _ = labelled
    for some, share in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        machine = toxicity.train(docs, some)
        assert {r.score for r in toxicity.score(docs.limit(5), machine).collect()} == {share}
    assert toxicity.score(docs.limit(0), machine).count() == 0


# --- top-k search ------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [1e30] * 8), (404, [0.5] * 3), (450, [0.25] * 3), (None, [1.0] * 8), (500, rows[1][1]), (501, rows[1][1]), (50, [9.0] * 8)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, dim string")
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and abs(x) < 2**22 for x in v)]
    want = set()
    for q, v in {i: min(w for j, w in valid if j == i) for i, _ in valid if i % 50 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in valid if i != q and len(w) == len(v))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found)}
    for blocks in ({"block_rows": 16, "blocks_per_group": 4, "chunk": 3}, {}):
        assert {tuple(r) for r in top_k(frame, **blocks).collect()} == want
    assert top_k(frame.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1) * 10.0 ** (i % 50 and rng.integers(0, 7))]) for i in range(150)]
    rows += [(207, [2.0**22] * 6), (201, [-(2.0**23)] * 6), (202, [2.0**36, 0.5, -(2.0**34), 0.0, 1.0, 2.0]), (203, [float("inf")] * 6)]
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i != 203]
    want = set()
    for q, v in valid:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in valid if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found)}
    assert {i for _, _, i, _ in want} >= {202, 207}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks in ({"block_rows": 16, "blocks_per_group": 4, "chunk": 3}, {}):
        assert {tuple(r) for r in top_k(frame, **blocks).collect()} == want
    # Bounds of a block beyond a bigint prune nothing that scores within one.
    from siftwell.llm.topk_search import best_of_group

    q, m = np.array([[1 << 35, 1 << 35]]), np.array([[1 << 35, -(1 << 35) + 3], [1, 1], [2, 1]])
    _, score, who, _ = best_of_group(np.array([-1]), q, np.arange(3), m, m.max(axis=0)[None], m.min(axis=0)[None], 128, 2)
    assert [int(x) for x in who] == [0, 2] and not len(set(int(x) for x in score) - {3 << 35})


def test_blocks_are_pruned():
    from siftwell.llm.topk_search import best_of_group

    m = np.repeat(np.arange(64)[::-1], 16)[:, None] * np.ones((1, 4), int)
    ids, q = np.arange(len(m)), np.ones((1, 4), int)
    top = low = m[::16]
    _, score, who, scored = best_of_group(np.array([-1]), q, ids, m, top, low, 16, 5)
    assert scored == 1 and list(who) == [0, 1, 2, 3, 4] and set(score) == {252}


def test_top_k_of_sparse_ids_and_empty_vectors(spark):
    """Ids far apart share blocks; empty vectors are of one length and score 0 with each other."""
    rng = np.random.default_rng(12)
    rows = [(i * 10**12, [float(x) for x in rng.normal(size=4).round(2)]) for i in range(-200, 200)] + [(7, []), (50, []), (100, [])]
    found = {tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=16, blocks_per_group=2, chunk=40, slice_values=300).collect()}
    want = set()
    for q, v in rows:
        if q % 50 == 0:
            best = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert found == want
    from siftwell.llm.topk_search import integers, packed_runs

    index = packed_runs(integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"), 2, 64, 16)
    assert index.count() <= 403 // 64 + 5


# --- Jaccard join ------------------------------------------------------------


def brute_classes(rows, width, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())))
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return sorted((str(i), len(s), str(None if i is None else root(i))) for i, s in sets)


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_near_classes(spark, width, percent):
    rng = random.Random(width)
    base = [f"v{rng.randrange(400)}" for _ in range(150)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(90):  # copies with zero to eight edits, so that chains form
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join([*passage, *(f"u{i}_{k}" for k in range(40 + i))])) for i in range(25)]  # share a passage only
    rows += [(1, "one two"), (2, "ONE  two"), (3, "two one"), (4, None), (5, ""), (6, " \n"), (None, " ".join(base)), (7, "a b c d e"), (8, "a b c d f"), (9, " ".join(base)), (9, " ".join(base)), (10, "w " * 30_000)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], EXTRA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_classes(frame, width=width, percent=percent).collect())
    assert got == brute_classes(rows, width, percent)
    one = one_of_each(frame, width=width, percent=percent)
    assert one.columns == frame.columns
    want = {i for i, _, c in got if i == c}
    assert {str(r.doc_id) for r in one.collect()} == want


def test_near_classes_over_windows_and_turns(spark):
    """Small windows, groups of chained edits that one hub doesn't cover, a passage in all texts, exact copies."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary[:20])
        if i % 4 == 0:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))] + passage
        rows.append((i, " ".join(rows[i - 1][1].split() if i % 13 == 5 else w)))
    want = brute_classes(rows, 4, 85)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({"window_tokens": 300}, {"window_tokens": 4000, "most_turns": 0}, {}):
        got = near_classes(frame, width=4, percent=85, **options)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == want


def test_compact():
    for numbers in ([], [0], [0, 0, 5, 255, 300], [70_000, 70_000, 140_001], [3, 1 << 20]):
        assert list(tokens.restored(tokens.compact(np.array(numbers, np.int64)), len(numbers))) == numbers


def test_near_classes_empty(spark):
    assert near_classes(spark.createDataFrame([], EXTRA)).count() == 0
    assert near_classes(spark.createDataFrame([(1, None, "", 1)], EXTRA)).first().component_id == 1


# --- WARC --------------------------------------------------------------------


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, tmp_path, least):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5 + 1), "x") for i in range(200)]
    rows += [(500, None, None, "x"), (501, "http://h/a b\nc", "", "x"), (502, "u", "é" * 40_000, "x"), (502, "u", "é" * 40_000, "x"), (502, "u", "other text here", "x"), (None, "n", "held by null only", "x"), (-5, "m", rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard string")
    folders = [str(tmp_path / f"w{k}") for k in range(2)]
    for folder, frame in zip(folders, (pages, pages.repartition(7))):
        warc.write_warc(frame, folder, least_revisit=least, shard_bytes=4000, roll_bytes=1500)
    one, two = ({r.file: r.sha256 for r in spark.read.parquet(f"{f}/{warc.MANIFEST}").collect()} for f in folders)
    assert one == two and len(one) > 3
    got = warc.read_warc(spark, folders[0]).collect()
    data = [(i, (h or "").encode()) for i, _, h, _ in rows]
    last = {}
    for i, b in data:
        if i is not None:
            last[b] = max(i, last.get(b, i))
    want, seen = [], set()
    for i, b in data:
        target = last.get(b) if len(b) >= least and sum(b == c for _, c in data) > 1 else None
        revisit = target is not None and (i != target or (i, b) in seen)
        seen.add((i, b))
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", str(target if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    by_digest = {base64.b32encode(hashlib.sha1(b).digest()).decode(): b for _, b in data}
    assert all(bytes(r.payload) == by_digest[r.payload_digest] for r in got if r.record_type == "response")
    assert warc.write_warc(pages.limit(0), str(tmp_path / "none")).count() == 0 and warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_shards_and_leftovers(spark, tmp_path):
    """Shards are even whatever the ids; files that lost attempts left are cleared and never read."""
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / ".part-000000-00000.warc.gz.0123.tmp").write_bytes(b"cut sho")
    (folder / "part-999999-00000.warc.gz").write_bytes(b"of a failed job")
    rows = [(10**15 + i if i % 3 else i, None, f"{i % 900}" * 50) for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(pages, str(folder), shard_bytes=100_000).groupBy("shard").sum("n_records").collect()
    assert len(manifest) == -(-sum(len(h) + 512 for _, _, h in rows) // 100_000) and max(r[1] for r in manifest) < 2 * 3000 / len(manifest)
    assert not list(folder.glob(".part-*.tmp"))
    got = warc.read_warc(spark, str(folder)).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, _, _ in rows) and sum(r.record_type == "revisit" for r in got) == 2100


def test_warc_damage(spark, tmp_path):
    folder = str(tmp_path / "w")
    name = warc.write_warc(spark.createDataFrame([(1, "u", "x" * 999)], "page_id long, url string, html string"), folder).first().file
    raw = (tmp_path / "w" / name).read_bytes()
    (tmp_path / "w" / name).write_bytes(raw[:-30])
    with pytest.raises(Exception, match="cut short|damaged"):
        warc.read_warc(spark, folder).collect()


def test_record_ids():
    for i in (None, 0, -1, 2**63 - 1, -(2**63), 12345):
        assert warc.page_of(warc.record_id(i, "D")) == i
