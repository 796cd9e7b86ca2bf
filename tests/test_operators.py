"""Operators on small inputs, and readers and writers in round trips."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import crawl, index, rank, search
from siftwell.sources import readers, writers

EDGES = [("A", "B"), ("A", "C"), ("B", "A"), ("C", "A"), ("C", "D"), ("E", "A")]


@pytest.fixture(scope="module")
def postings(spark):
    docs = spark.createDataFrame([(1, "b b c c c"), (2, "b x"), (3, "d"), (4, None)], "doc_id long, text string")
    return index.postings(index.term_frequencies(index.token_positions(docs)), 4, "reference").cache()


def test_frequencies(spark):
    docs = spark.createDataFrame([(1, "b b c c c")], "doc_id long, text string")
    lines = {r.value for r in index.term_frequency_lines(index.term_frequencies(index.token_positions(docs))).collect()}
    assert lines == {"b:1:0.80000:0,1", "c:1:1.00000:2,3,4"}


def test_postings(postings):
    rows = {(r.word, r.doc_id): r.tfidf for r in postings.collect()}
    # N = 4, df = 2: idf = ln 2, once 0.8 ln 2 = 0.55452, twice 0.38436
    assert rows["b", "1"] == pytest.approx(0.38436, abs=1e-5) and rows["b", "2"] == pytest.approx(0.48045, abs=1e-5)


def test_posting_lines(spark, postings, tmp_path):
    lines = index.posting_lines(postings)
    writers.write_posting_lines(lines, str(tmp_path / "lines"))
    back = readers.posting_files(spark, str(tmp_path / "lines"))
    key = lambda df: sorted((r.word, r.doc_id, r.tfidf, tuple(r.positions)) for r in df.collect())
    assert key(back) == key(postings)
    b = lines.where("word = 'b'").first().line
    assert b == "b\t2:0.48045:0|1:0.38436:0,1"
    assert "b" not in {r.word for r in index.posting_lines(postings, len(b) - 1).collect()} and "b" in {r.word for r in index.posting_lines(postings, len(b)).collect()}


def test_pagerank(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    one = {r.id: r.rank for r in rank.pagerank(edges, 1, "reference").collect()}
    assert one == {"A": 2.5, "B": 0.5, "C": 0.5, "D": 0.5}
    five = {r.id: r.rank for r in rank.pagerank(edges, 5, "reference", every=2).collect()}
    assert five == pytest.approx({"A": 1.40625, "B": 0.28125, "C": 0.28125, "D": 0.46875})
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    assert sum(r.rank for r in rank.pagerank(ring, 50, tol=1e-6).collect()) == pytest.approx(3, abs=1e-4)
    assert rank.pagerank(edges.limit(0), 3).count() == 0


def test_search(spark, postings):
    assert search.candidates(postings, spark.createDataFrame([("b",), ("b",)], "word string")).orderBy("doc_id").first().tfidf == pytest.approx(2 * 0.38436, abs=1e-5)
    many = spark.range(600).select(F.lit("w").alias("word"), F.col("id").cast("string").alias("doc_id"), (600 - F.col("id")).cast("double").alias("tfidf"))
    ranks = spark.range(400, 600).select(F.col("id").alias("fingerprint"), F.lit(0.5).alias("rank"), F.array(F.lit("http://x.y")).alias("urls"))
    found = search.ranked(search.candidates(many, search.query_terms(spark, "w w")), ranks)
    assert found.count() == 0  # a single letter is no term
    found = search.ranked(search.candidates(many, spark.createDataFrame([("w",)], "word string")), ranks)
    assert found.count() == 100  # cut to 500 first
    pages = [[r.doc_id for r in search.result_page(found, s).collect()] for s in (0, 10, 95, 100)]
    assert pages[0] == [str(i) for i in range(400, 410)] and pages[1][0] == "410" and len(pages[2]) == 5 and pages[3] == []


def test_result_count(spark):
    found = spark.range(23)
    assert tuple(search.result_count(found, "a b").first()) == (23, 'Showing results for "a b"')
    assert tuple(search.result_count(found.limit(0), "a b").first()) == (0, 'No results found for "a b"')


def test_pagination(spark):
    rows = spark.createDataFrame([(0, 10), (0, 11), (10, 25), (23, 25), (20, 30)], "s long, n long").select(search.pagination_links(F.col("s"), F.col("n"))).collect()
    assert [r[0] for r in rows] == [[], ["F10"], ["B0", "F20"], ["B10"], ["B10"]]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\n\nUser-agent: else\nDisallow: /z\nSitemap: /s"
    files = spark.createDataFrame([("d", body), ("e", "User-agent: *\nAllow: /a\nDisallow: /a")], "domain string, body string")
    rules = crawl.parse_robots(files)
    assert {(r.directive, r.value) for r in rules.where("domain = 'd'").collect()} == {("User-agent", "*"), ("Disallow", "/a"), ("Allow", "/a/b"), ("Crawl-delay", "2"), ("Sitemap", "/s")}
    own = crawl.rules_for(rules.where("directive <> 'Sitemap'"))
    paths = spark.createDataFrame([("d", "/a/b/c"), ("d", "/a/x"), ("d", "/z"), ("e", "/a"), ("none", "/")], "domain string, path string")
    assert {(r.domain, r.path): r.allowed for r in crawl.robots_decisions(paths, own).collect()} == {("d", "/a/b/c"): True, ("d", "/a/x"): False, ("d", "/z"): True, ("e", "/a"): False, ("none", "/"): True}
    assert [(r.domain, r.delay_ms) for r in crawl.crawl_delays(own).collect()] == [("d", 2000)]


def test_stores(spark):
    store = spark.createDataFrame([("u", 1, 10), ("v", 5, 11)], "url string, crawldate long, fingerprint long")
    new = spark.createDataFrame([("u", 3, 12), ("v", 4, 13), ("w", 1, 14)], store.schema)
    once = crawl.upsert(store, new, "url", "crawldate")
    assert sorted(map(tuple, once.collect())) == [("u", 3, 12), ("v", 5, 11), ("w", 1, 14)]
    assert sorted(map(tuple, crawl.upsert(once, new, "url", "crawldate").collect())) == sorted(map(tuple, once.collect()))
    assert [r.fingerprint for r in crawl.deposit(new, once.where("fingerprint <> 13")).collect()] == [13]


def test_batched_upsert(spark):
    rows = spark.range(60).repartition(1)

    def put(batch):
        assert len(batch) <= 25
        return [r for r in batch if r["id"] % 20 == 0]

    assert sorted(r.id for r in writers.upsert(rows, put).collect()) == [0, 20, 40]


def test_files(spark, tmp_path):
    for name, body in (("123", "<p>a</p>\nb"), ("456", "c"), (".DS_Store", "x"), ("sub_DS_Store", "y")):
        (tmp_path / name).write_text(body)
    assert {r.doc_id for r in readers.page_files(spark, str(tmp_path)).collect()} == {"123", "456"}
    assert {(r.doc_id, r.html) for r in readers.whole_text_files(spark, str(tmp_path)).collect()} >= {("123", "<p>a</p>\nb")}
    graph = tmp_path / "graph"
    graph.mkdir()
    (graph / "g.txt").write_text("a b c b\nd\n\n")
    assert {(r.src, tuple(r.dsts)) for r in readers.adjacency_files(spark, str(graph)).collect()} == {("a", ("b", "c", "b")), ("d", ())}
    assert rank.edges_of(readers.adjacency_files(spark, str(graph))).count() == 3


def test_messages_round_trip(spark, tmp_path):
    found = spark.createDataFrame([(f"http://h/{i}?a;b",) for i in range(7)], "url string")
    writers.write_messages(found, str(tmp_path / "q"), 3)
    assert sorted(r.url for r in readers.messages(spark.read.text(str(tmp_path / "q"))).collect()) == sorted(r.url for r in found.collect())


def test_search_engine_and_its_caches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"apple {'pear' if i % 2 else 'plum'} w{i}") for i in range(1, 40)], "doc_id long, text string")
    rows = index.postings(index.term_frequencies(index.token_positions(docs)), 39)
    writers.write_index(rows, str(tmp_path / "index"))
    ranks = spark.range(1, 38).select(F.col("id").alias("fingerprint"), (F.col("id") / 100.0).alias("rank"), F.array(F.concat(F.lit("http://x.y/"), F.col("id").cast("string"))).alias("urls"))
    writers.write_ranks(ranks, str(tmp_path / "ranks"))
    engine = search.SearchEngine(spark, str(tmp_path / "index"), str(tmp_path / "ranks"), most=2)
    want = [tuple(r) for r in search.search(spark, "pear w7", rows, ranks, 0).collect()]
    assert [tuple(r) for r in engine.page("pear w7").collect()] == want and engine.results.hits == 0
    assert [tuple(r) for r in engine.page("pear w7").collect()] == want and engine.results.hits == 1
    assert [tuple(r) for r in engine.page("pear w7", 10).collect()] == [tuple(r) for r in search.search(spark, "pear w7", rows, ranks, 10).collect()]
    assert engine.header("pear w7") == (19, 'Showing results for "pear w7"') and engine.header("the") == (0, 'No results found for "the"')
    engine.found("plum")
    assert engine.postings.hits == 0 and list(engine.postings.held) == ["w7", "plum"]  # of two, the one used longest ago went
    engine.found("w7 plum apple")
    assert engine.postings.hits == 2 and len(engine.ranks.held) == 2


def test_random_term(spark, postings):
    words = {search.random_term(postings, seed).first().word for seed in range(12)}
    assert len(words) > 1 and words <= {"b", "c", "d", "x"} and search.random_term(postings, 3).first() == search.random_term(postings, 3).first()
    assert search.random_term(postings.limit(0), 1).count() == 0


def test_page_store_is_idempotent(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (None, "x"), (1, "<p>a")], "page_id long, html string")
    folder = f"file://{tmp_path}/store"
    assert sorted(map(tuple, writers.write_page_files(pages, folder).collect())) == [("1", True), ("2", True)]
    assert sorted(map(tuple, writers.write_page_files(pages, folder).collect())) == [("1", False), ("2", False)]
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["1", "2"]


def test_schedule(spark):
    queued = spark.createDataFrame([("a", "/1", "head", 1), ("a", "/2", "get", 5), ("a", "/3", "head", 2), ("a", "/1", "head", 9), ("b", "/1", "head", 3)], "domain string, path string, wanted string, seq long")
    assert [tuple(r) for r in crawl.schedule(queued).orderBy("turn", "domain").collect()] == [(1, "a", "/2"), (1, "b", "/1"), (2, "a", "/1"), (3, "a", "/3")]


def test_fetchable_semantics(spark):
    rows = spark.createDataFrame([(1, "text/html", {}, 5, 200), (2, "text/html", {}, 5, 404), (3, "image/png", {}, 5, 200)], "id int, content_type string, headers map<string,array<string>>, content_length long, status int")
    assert [r.id for r in crawl.fetchable(rows).collect()] == [1] and [r.id for r in crawl.fetchable(rows, "reference").orderBy("id").collect()] == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    from siftwell.__main__ import main

    spark.createDataFrame([(1, "apple pear"), (2, "apple")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    (tmp_path / "graph").mkdir()
    (tmp_path / "graph/g.txt").write_text("1 2\n2 1\n")
    assert main(["index", str(tmp_path / "docs"), str(tmp_path / "index")]) == 0 and main(["lines", str(tmp_path / "docs"), str(tmp_path / "lines")]) == 0
    assert main(["rank", str(tmp_path / "graph"), str(tmp_path / "ranks")]) == 0
    assert {r.word for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {"apple", "pear"}
    assert readers.posting_files(spark, str(tmp_path / "lines")).count() == 3
    ranks = spark.read.parquet(str(tmp_path / "ranks")).select(F.col("id").cast("long").alias("fingerprint"), "rank", F.array(F.lit("http://www.a.b/")).alias("urls"))
    ranks.write.parquet(str(tmp_path / "items"))
    assert main(["search", str(tmp_path / "index"), str(tmp_path / "items"), "pear"]) == 0 and "http://www.a.b/" in capsys.readouterr().out
    assert main([]) == 2
