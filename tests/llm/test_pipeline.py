"""The corpus pipeline, stage by stage, against plain Python on what the stage before it kept."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from siftwell.llm import mixing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, n int"
INSULTS = ("blorfo", "quarnith", "zedoxal")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def prose(rng, n=70, insults=0):
    w = ["".join(rng.choice(["an", "er", "ti", "lo", "ma", "se", "ka"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    for _ in range(insults):
        w[rng.randrange(n)] = rng.choice(INSULTS)
    return " ".join(w)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Toxic and clean texts, exact copies in other case, near copies, repeated rows, nulls, empty and long texts, tied ids, clashing columns."""
    rng = random.Random(14)
    texts = [prose(rng, insults=3 if i % 5 == 0 else 0) for i in range(400)]
    rows = [(i, t, "en", "abc"[i % 3] if i % 11 else None, len(t), "x", 1) for i, t in enumerate(texts)]
    clean = [i for i in range(400) if i % 5]
    copies = [(1000 + k, texts[i].upper() if k % 2 else texts[i]) for k, i in enumerate(clean[:40])]
    near = []
    for k, i in enumerate(clean[60:100]):
        w = texts[i].split()
        w[k % len(w)] = "changed"
        near.append((2000 + k, " ".join(w)))
    odd = [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "one"), (3004, prose(rng, 20_000)), (None, prose(rng)), (clean[50], texts[clean[50]]), (clean[51], prose(rng))]
    rows += [(i, t, "en", "c", len(t or ""), "x", 1) for i, t in [*copies, *near, *odd]]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)] + [(3, 1, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    """The rows of each stage, written and read again as run() does."""
    folder, rows = tables
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        found = stage(spark, docs, folder)
        if name != "packing":
            assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
        found.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def key(rows):
    return sorted((str(r[0]), str(r[1])) for r in rows)


def test_toxic_documents_go(spark, tables, stages):
    folder, rows = tables
    kept = Counter(key(stages["toxicity"]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), learn="pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")
    scored = {(str(r.doc_id), r.score) for r in toxicity.score(docs, machine).collect()}
    assert {i for i, _ in kept} == {i for i, s in scored if s < 0.5}
    insulting = [any(w in INSULTS for w in words(t)) for _, t, *_ in rows]
    lost = [bad for (i, t, *_), bad in zip(rows, insulting) if (str(i), str(t)) not in kept]
    assert all(lost) and sum(lost) >= 0.95 * sum(insulting)  # no clean document goes, and hardly an insult stays


def test_copies_go(stages):
    before, after = stages["toxicity"], key(stages["exact_dedup"])
    groups = {}
    for r in before:
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in r.text or ""), []).append(r.doc_id)
    want = {(str(max((i for i in ids if i is not None), default=None)), t) for t, ids in groups.items()}
    assert len(after) == len(want)
    assert {(i, "" if t == "None" else "".join(c.lower() if c.isascii() else c for c in t)) for i, t in after} == want


def test_near_copies_go(stages):
    """Sets of five words, similarity 0.8; rows that repeat an id are one node."""
    before, after = stages["exact_dedup"], stages["ngram_jaccard_join"]
    sets = [(r.doc_id, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])) for r in before for w in [words(r.text)]]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert key(after) == key([r for r in before if r.doc_id is None or root(r.doc_id) == r.doc_id])
    assert len(before) - len(after) >= 35


def test_mix_meets_its_targets(stages):
    """Every stretch is of a document that was kept, and sources come near their targets."""
    before, after = stages["ngram_jaccard_join"], stages["mixing"]
    texts = {}
    for r in before:
        texts.setdefault(r.doc_id, []).append(WORD.findall(r.text or ""))
    joined = {i: [" " + " ".join(w) + " " for w in ws] for i, ws in texts.items()}
    taken, per = Counter(), Counter()
    for r in after:
        w = WORD.findall(r.text)
        assert any(f" {' '.join(w)} " in t for t in joined[r.doc_id]) and r.n_chars == len(r.text)
        taken[r.source] += len(w)
        per[r.doc_id] += len(w)
    assert all(n <= 2 * sum(map(len, texts[i])) for i, n in per.items())
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 64 for s in order)


def test_batches_hold_every_stretch(stages):
    before, after = stages["mixing"], stages["packing"]
    assert sorted((str(r.doc_id), len(WORD.findall(r.text))) for r in before) == sorted((str(r.doc_id), r.n_tokens) for r in after)
    bounds = sorted({(r.bucket, r.padded_to) for r in after})
    assert [b for b, _ in bounds] == list(range(len(bounds))) and all(r.padding == r.padded_to - r.n_tokens >= 0 for r in after)
    batches = Counter((r.bucket, r.shard, r.batch, r.padded_to) for r in after)
    assert all(n <= max(1, 16384 // k[3]) for k, n in batches.items())
    assert len({(r.bucket, r.shard, r.batch, r.slot) for r in after}) == len(after)
    lengths = sorted(r.n_tokens for r in after)
    assert all(min(b for _, b in bounds if b >= r.n_tokens) == r.padded_to for r in after) and max(lengths) == max(b for _, b in bounds)


def test_run_gives_the_last_stage(spark, tables, stages):
    folder, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert sorted(r.n_tokens for r in out.collect()) == sorted(r.n_tokens for r in stages["packing"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_targets_are_those_of_the_mix(spark, stages):
    """The mix is made over all that was kept, not over the whole table."""
    kept = spark.createDataFrame([tuple(r) for r in stages["ngram_jaccard_join"]], SCHEMA)
    sizes = Counter()
    for r in stages["ngram_jaccard_join"]:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    assert {r.source: r.source_size for r in mixing.mix_sources(kept).collect()} == dict(sizes)
