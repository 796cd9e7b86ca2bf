"""Exact dedup, line dedup, mixing, licence scan and packing against brute force."""

import hashlib
import itertools
import re
import textwrap

import numpy as np
import pytest

from siftwell.llm import packing
from siftwell.llm.exact_dedup import exact_dedup, kept_documents
from siftwell.llm.license_scan import TEMPLATES, bigrams_of, bounds, license_scan, words_of
from siftwell.llm.line_dedup import line_dedup
from siftwell.llm.mixing import mix_sources, mixed_documents

SCHEMA = "doc_id long, text string, source string, n bigint, key string, run int"
LINE = "This very line is in many documents"
ROWS = [
    (1, "Hello World", "a", 0, "k", 1), (5, "hello world", "b", 0, "k", 1), (3, "HELLO WORLD", None, 0, "k", 1),
    (7, None, "a", 0, "k", 1), (8, "", "a", 0, "k", 1), (None, "Hello World", "b", 0, "k", 1),
    (9, "É", "a", 0, "k", 1), (10, "é", "a", 0, "k", 1), (11, f"{LINE}\nshort\n  {LINE.upper()}\t\nend", "b", 0, "k", 1),
    (12, f"{LINE}\nother", "b", 0, "k", 1), (13, f"x\n{LINE}", None, 0, "k", 1), (13, f"x\n{LINE}", None, 0, "k", 1),
    (14, "word " * 70000, "a", 0, "k", 1), (15, " \n\t ", "c", 0, "k", 1), (16, "null holder", "c", 0, "k", 1), (None, "only null", "c", 0, "k", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def test_exact_dedup(docs):
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    top = {t: max((i for i in v if i is not None), default=None) for t, v in groups.items()}
    want = sorted((str(i), str(top[lower(t)]), len(groups[lower(t)]), i == top[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in ROWS)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs).collect())
    assert got == want


def test_exact_dedup_rounds(spark):
    """Large groups over many runs, and few runs, give the same."""
    many = spark.range(3000).selectExpr("id as doc_id", "concat('T', case when id % 3 = 0 then 0 else id % 101 end) as text")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(many, fan_in=2, most_runs=64).collect()}
    assert got == {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(many).collect()}
    rows = [(i, f"T{0 if i % 3 == 0 else i % 101}") for i in range(3000)]
    assert got == {(i, max(j for j, u in rows if u == t), sum(u == t for _, u in rows)) for i, t in rows}


def test_exact_dedup_merges_sorted_runs(docs):
    """Each round's merge is a pass over a sort by digest, which the optimiser keeps."""
    from siftwell.llm.exact_dedup import KEY, merge_runs

    level = docs.sparkSession.range(100).selectExpr("id % 64 as run", "sha2(string(id % 7), 256) as sha", "int(id % 7) as n_bytes", "id % 7 as alt", "id as keep_id", "1L as n")
    plan = merge_runs(level, 64, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate(key=[node") == 6 and "HashAggregate" not in plan  # three rounds, before and after
    assert plan.count("Sort [node") == 3 and all(k in plan for k in KEY)


def test_kept_documents(docs):
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["5", "8", "9", "10", "11", "12", "13", "14", "15", "16", "None"])


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: lower(x.strip(strip))
    where = {}
    for i, t, *_ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                where.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in where.items() if len(k) >= 20 and len(v) >= 3}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or key(x) not in gone or gone[key(x)] == i]
        yield str(i), len(lines), len(lines) - len(stay), "\n".join(stay)


def test_line_dedup(docs):
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs).collect())
    assert got == sorted(brute_lines(ROWS))
    assert any(n for _, _, n, _ in got)


def test_mix(docs):
    rows = mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x, *_ in ROWS if x == s) for s in ("a", "b", "c", None)}
    for r in rows:
        assert r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
    # Caps of b, c and null are met by water filling; weights are 3, 1, 2, 3.
    target = {r.source: r.target for r in rows}
    total = 1.5 * sum(size.values())
    assert sum(target.values()) == pytest.approx(total) and all(target[s] <= 2 * size[s] for s in size)
    for s in size:
        taken = sum(r.taken for r in rows if r.source == s)
        assert abs(taken - target[s]) <= max(0.02 * target[s], 1)
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_documents(docs):
    mixed = mixed_documents(docs.where("doc_id is not null"))
    assert mixed.columns == docs.columns
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    want = {}
    for r in mix_sources(docs.where("doc_id is not null")).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert got == {k: v for k, v in want.items() if v}


def test_mixed_documents_with_null_ids(docs):
    """Rows without an id are taken from as all others are; the words taken of each id are those of the mix."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    got, want = {}, {}
    for r in mixed_documents(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    for r in mix_sources(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert got == {k: v for k, v in want.items() if v} and None in want


def test_sainte_lague(spark):
    from siftwell.llm.mixing import apportion

    votes = [("a", 53), ("b", 24), ("c", 23), ("d", 0), ("e", 1)]
    for seats in (0, 1, 3, 7, 50):
        frame = spark.createDataFrame([(0, n, v, seats) for n, v in votes], "g int, name string, v long, seats long")
        got = {r.name: r.won for r in apportion(frame, ["g"], ["name"], "v", "seats", "won").collect()}
        quotients = sorted(((-v / (2 * k + 1), n) for n, v in votes for k in range(60) if v))[:seats]
        assert got == {n: sum(m == n for _, m in quotients) for n, _ in votes}


def test_licenses(spark):
    mit = TEMPLATES["MIT"].replace("Software", "software", 3).replace("sublicense,", "")
    rows = [(1, f"intro\n{TEMPLATES['MIT-line']}\nmore"), (2, f"Text. {TEMPLATES['Apache-2.0-line']} Then."), (3, mit), (4, "Released under a licence of some sort."), (5, None), (6, ""), (7, "word"), (7, "x " * 50000 + "\n" + TEMPLATES["CC-BY-NC-4.0-line"])]
    got = {(r.doc_id, i): (r.license, r.n_matches) for i, r in enumerate(license_scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())}
    assert [v[0] for v in got.values()] == ["MIT-line", "Apache-2.0-line", "MIT", None, None, None, None, "CC-BY-NC-4.0-line"]


def test_license_bounds_lose_nothing(spark):
    rng = np.random.default_rng(5)
    units = []
    for name, text in list(TEMPLATES.items())[:5]:
        w = text.split()
        for _ in range(40):
            x = [a for a in w if rng.random() > 0.12]
            x.insert(int(rng.integers(len(x) + 1)), "zz")
            units.append(" ".join(x))
    got = [r for r in license_scan(spark.createDataFrame(list(enumerate(units)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for u, r in zip(units, got):
        # the whole text and its sentences are the units
        best = 0
        for part in {u, *re.split(r"[.!?]\s+|\n", u)}:
            a = set(bigrams_of(part))
            for t in TEMPLATES.values():
                b = set(bigrams_of(t))
                best = max(best, 2 * len(a & b) / max(1, len(a) + len(b)))
        assert r.dice == pytest.approx(best if best >= 0.8 else 0, abs=1e-6)


def layout(name, width=72):
    """A template with its sentences in paragraphs of wrapped lines, behind comment marks."""
    parts = [textwrap.wrap(p, width) for p in re.split(r"(?<=[.:]) (?=[A-Z1-9])", TEMPLATES[name])]
    return "\n *\n".join("\n".join(f" * {x}" for x in p) for p in parts)


def best_window(text, name, least=0.8):
    """Brute force over all runs of words that cross an end of a line or sentence."""
    parts = [words_of(p) for p in re.split(r"[.!?]\s+|\n", text)]
    w, part = [x for p in parts for x in p], [k for k, p in enumerate(parts) for _ in p]
    own, length = set(bigrams_of(TEMPLATES[name])), len(words_of(TEMPLATES[name])) - 1
    best = 0
    for i in range(len(w)):
        grams = set()
        for j in range(i + 1, min(len(w), i + 1 + bounds(length, least)[1])):
            grams.add(f"{w[j - 1]} {w[j]}")
            if part[i] != part[j]:
                best = max(best, 2 * len(grams & own) / (len(grams) + len(own)))
    return best


def test_licenses_in_their_layout_inside_a_long_document(spark):
    around = "\n".join(f"Some other line {k} of the text, with permission to use and copy it {k * k}." for k in range(300))
    names = ["MIT", "BSD-2-Clause", "Apache-2.0-notice", "GPL-3.0-notice", "ISC"]
    rng = np.random.default_rng(3)
    worn = ["\n".join(" ".join(x for x in y.split(" ") if rng.random() > 0.05) for y in layout(n).split("\n")) for n in names]
    texts = [f"{around}\nCopyright 2020 A. Holder\n{x}\n{around}" for x in [*map(layout, names), *worn]]
    texts += [f"{around}\nLicensed under the Apache\nLicense, Version 2.0.\n{around}", around, layout("MIT") + "\n\n" + around + "\n\n" + layout("BSD-2-Clause")]
    texts += [f"{TEMPLATES['MIT'].replace('. ', '.' + chr(10))} {around}".replace(chr(10), " ")]  # all in one line
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.license, r.dice, r.n_matches) for r in license_scan(frame).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [*names, *names, "Apache-2.0-line", None, "MIT", "MIT"]
    for (name, dice, n), text in zip(got, texts):
        assert name is None or dice == pytest.approx(best_window(text, name), abs=1e-6)
    assert got[12][2] == 2 and got[11] == (None, 0.0, 0)


def test_templates_that_are_alike(spark):
    """Each template is found as itself, in its layout and as one line; notices that differ by a clause count once."""
    names = [n for n in TEMPLATES if len(TEMPLATES[n]) > 150]
    texts = [f"Title\n{f(n)}\nThe rest of it." for n in names for f in (layout, lambda n: TEMPLATES[n])]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, license string, dice int")
    got = [(r.doc_id, r.license, r.n_matches) for r in license_scan(frame).orderBy("doc_id").collect()]
    once = [n for n in names for _ in range(2)]
    assert [g[1] for g in got] == once * 2
    assert all(n == 1 for (i, name, n) in got if name in ("BSD-2-Clause", "BSD-3-Clause") and i % 2 == 0)


def test_packing_of_rows_without_ids(spark):
    """They go to many shards by their text, and equal rows are interchangeable."""
    rows = [(None, " ".join(["w"] * (i % 5 + 1)) + f" {i}", "x", 1) for i in range(600)] + [(None, "same text", "x", 1)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, bucket string, shard int")
    got = packing.pack(frame, shard_rows=20, budget=16).collect()
    assert len(got) == 603 and all(r.doc_id is None for r in got) and len({(r.bucket, r.shard) for r in got}) > 8
    assert len({(r.bucket, r.shard, r.batch, r.slot) for r in got}) == 603


def test_best_bounds():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = np.unique(rng.integers(0, 60, 12))
        n = rng.integers(1, 9, len(sizes))
        for k in (1, 2, 3, 5):
            found = packing.best_bounds(sizes, n, n * sizes, k)
            cost = lambda cuts: sum(c * (min(b for b in cuts if b >= s) - s) for s, c in zip(sizes, n))
            best = min(cost([*c, sizes[-1]]) for r in range(k) for c in itertools.combinations(sizes[:-1], r))
            assert cost(found) == best and len(found) <= k and found[-1] == sizes[-1]


def test_pack(docs):
    rows = packing.pack(docs, budget=64, buckets=3).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    for r in rows:
        assert r.n_tokens + r.padding == r.padded_to and r.padding >= 0
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.shard, r.batch), []).append(r)
    for b in batches.values():
        assert len(b) == 1 or sum(x.padded_to for x in b) <= 64
        assert len({x.slot for x in b}) == len(b)
    long = next(r for r in rows if r.doc_id == 14)
    assert long.n_tokens == 70000 and long.padded_to >= 70000


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (exact_dedup, kept_documents, line_dedup, mix_sources, mixed_documents, license_scan, packing.pack):
        assert f(none).count() == 0, f


def test_marks_are_tried_as_a_tree():
    """The pattern of many words finds what their plain list finds, and does not try each of them at every place."""
    import re

    from siftwell.llm.license_scan import any_of, signature

    marks = sorted({g for text in TEMPLATES.values() for g in signature(bigrams_of(text), 0.8)})
    for words in (marks, ["a b"], ["a b", "a bc", "a"], ["ab", "ac", "abcd", "b"]):
        tree, flat = any_of(words), "|".join(sorted(words, key=len, reverse=True))
        assert tree.count("|") <= flat.count("|")
        for w in [*words, *(w + "x" for w in words), *(w[:-1] for w in words), *(w[1:] for w in words), ""]:
            assert bool(re.fullmatch(f"(?:{tree})", w)) == bool(re.fullmatch(f"(?:{flat})", w)), w
    # Alternatives at the first letter: one for each letter that a mark begins with.
    assert any_of(["la b", "lc d", "m n"]) == "(?:l(?:a b|c d)|m n)"
