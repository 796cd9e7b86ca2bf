"""Documents counted and packed in batches, against positions that are exploded and grouped."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import index, occurrences
from siftwell.plans import catalog

# Repeated, null and missing ids and texts, empty slots, all kinds of white space, characters that go.
ODD = [(1, "b b c c c"), (1, "c  b\tz"), (2, None), (3, ""), (4, "the www.x.y is"), (None, "b q"), (None, "b"), (5, " \t x\x0by \x0c"), (6, "Zoé café 日本 a-b x\r\ny"), (7, "w " * 3000 + "v")]
ODD += [(100 + i, f"b w{i % 7} " + "k " * (i % 5)) for i in range(300)]


def rows(df, *cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="module")
def counted(docs):
    return index.term_frequencies(index.token_positions(docs)).cache()


@pytest.mark.parametrize("parts", [1, 8])
@pytest.mark.parametrize("size", [1, 50, 2 << 20])
def test_frequency_rows(monkeypatch, docs, counted, size, parts):
    monkeypatch.setattr(occurrences, "ROWS_SLICE", size)
    cols = "word", "doc_id", "n", "tf", "positions"
    assert rows(index.document_frequency_rows(docs.repartition(parts)), *cols) == rows(counted, *cols)


def test_contents_of_one_s_own(spark, docs):
    own = F.concat(F.coalesce("text", F.lit("")), F.lit(" 日本"))
    assert rows(index.document_frequency_rows(docs, contents=own), "word", "doc_id", "tf", "positions") == rows(index.term_frequencies(index.token_positions(docs, contents=own)), "word", "doc_id", "tf", "positions")


def test_no_shuffle_of_words(spark, tmp_path):
    """Words of documents are counted where their texts are: nothing is sorted, dealt or spilled."""
    spark.createDataFrame([(i, "b c b") for i in range(40)], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    from siftwell.plans import catalog

    for name in ("term_freq_lines", "parse_tf_lines"):
        found = plan(catalog.queries()[name](spark, str(tmp_path)))
        assert not any(x in found for x in ("Exchange", "Sort", "Window", "Aggregate")), name


def test_frequency_files_write_once(spark, tmp_path):
    """Lines of the documents of a folder are written by one stage of one task for each part of the input."""
    from siftwell.sources import writers

    spark.createDataFrame([(i, "b c b") for i in range(40)], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "in"))
    frequencies = index.document_frequency_rows(spark.read.parquet(str(tmp_path / "in")))
    assert "Exchange" not in plan(frequencies)
    writers.write_term_frequencies(frequencies, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(f"{w}:{i}:{tf}:{p}" for i in range(40) for w, tf, p in (("b", "1.00000", "0,2"), ("c", "0.70000", "1")))


def test_term_freq_lines_of_repeated_ids(spark, docs, counted):
    """Ids that repeat are the only reason to move texts; lines are those of exploded words."""
    few = index.term_frequency_lines(index.document_frequency_rows(docs))
    assert rows(few, "value") == rows(index.term_frequency_lines(counted), "value") and "Exchange" in plan(few)


@pytest.fixture(scope="module")
def posted(counted):
    return {s: index.postings(counted, len(ODD), s).cache() for s in ("reference", "intended")}


@pytest.mark.parametrize("size, row", [(16 << 20, 512), (16 << 20, 3), (40, 512)])
def test_packed_round_trip(monkeypatch, docs, counted, size, row):
    monkeypatch.setattr(occurrences, "PACKED_SLICE", size)
    monkeypatch.setattr(occurrences, "PACKED_ROW", row)
    monkeypatch.setattr(occurrences, "UNPACKED", 100)
    packed = occurrences.packed(index.whole(docs))
    assert packed.agg(F.max("k")).first()[0] <= row
    assert rows(occurrences.unpack(packed), "word", "doc_id", "n", "positions") == rows(counted, "word", "doc_id", "n", "positions")


@pytest.mark.parametrize("semantics", ["reference", "intended"])
def test_document_postings(docs, posted, semantics):
    ours = index.document_postings(docs, len(ODD), semantics)
    cols = "word", "doc_id", "tfidf", "positions", "df"
    assert rows(ours, *cols) == rows(posted[semantics], *cols)
    # No posting is shuffled or sorted on its own: what is above the unpacking only computes.
    top = plan(ours).split("MapInArrow")[0]
    assert "Exchange" not in top and "Sort" not in top and "MapInArrow" in plan(ours)


def test_index_is_written_without_another_shuffle(spark, docs, posted, tmp_path):
    from siftwell.sources import writers

    writers.write_index(index.document_postings(docs, len(ODD), positions=False), str(tmp_path / "index"), by_word=True)
    cols = "word", "doc_id", "tfidf"
    assert rows(spark.read.parquet(str(tmp_path / "index")), *cols) == rows(posted["intended"], *cols)


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """A folder with 40 documents, each of its own id."""
    folder = tmp_path_factory.mktemp("few")
    spark.createDataFrame([(i, f"b c b er tion w{i % 9}") for i in range(40)], "doc_id long, text string").repartition(8).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_postings_textbook_plan(spark, few):
    top = plan(catalog.postings_textbook(spark, few)).split("MapInArrow")[0]
    assert not any(x in top for x in ("Exchange", "Sort", "Join"))


def test_search_looks_words_up_before_unpacking(spark, few):
    top, _, below = plan(catalog.search_tfidf_top500(spark, few)).partition("MapInArrow")
    assert "LeftSemi" in below and "LeftSemi" not in top


def test_posting_lines_are_made_where_packed_rows_met(spark, few, docs, posted):
    assert "Exchange" not in plan(catalog.posting_lines_pruned(spark, few)).split("MapInArrow")[0]
    for most in (40, 300, index.MOST_LINE):
        assert rows(index.document_posting_lines(docs, len(ODD), "reference", most), "word", "line") == rows(index.posting_lines(posted["reference"], most), "word", "line")


def test_posting_lines_parsed_plan(spark, few):
    assert "Exchange" not in plan(catalog.posting_lines_parsed(spark, few)).split("MapInArrow")[0]


def test_postings_ref_plan(spark, few):
    top = plan(catalog.postings_ref(spark, few)).split("MapInArrow")[0]
    assert not any(x in top for x in ("Exchange", "Sort", "Join"))


def test_posting_files_of_packed_rows(spark, docs, posted, tmp_path):
    from siftwell.sources import readers, writers

    writers.write_posting_lines(index.document_posting_lines(docs, len(ODD), "reference"), str(tmp_path / "lines"))
    kept = {r.word for r in index.posting_lines(posted["reference"]).collect()}
    cols = "word", "doc_id", "tfidf", "positions"
    held = posted["reference"].where(F.col("word").isin(*kept) & F.col("doc_id").isNotNull())
    assert rows(readers.posting_files(spark, str(tmp_path / "lines")).where("doc_id rlike '^[0-9]+$'"), *cols) == rows(held, *cols)


def test_word_counts_without_windows(spark, few, docs, counted):
    found = plan(catalog.doc_freq_idf(spark, few))
    assert not any(x in found for x in ("Generate", "Window", "Sort"))
    assert rows(index.document_word_counts(docs, len(ODD)), "word", "df", "idf") == rows(index.document_frequencies(counted, len(ODD)), "word", "df", "idf")


def test_search_of_a_packed_index(spark, docs, posted, few, tmp_path, monkeypatch):
    """The engine's index is written packed, without a shuffle or weights; words are weighed when they are asked for."""
    from siftwell.operators import search
    from siftwell.sources import writers

    ranks = spark.range(1, 400).select(F.col("id").alias("fingerprint"), (F.col("id") / 100.0).alias("rank"), F.array(F.concat(F.lit("http://x.y/"), F.col("id").cast("string"))).alias("urls"))
    writers.write_ranks(ranks, str(tmp_path / "ranks"))
    writers.write_packed_index(index.packed_postings(docs), str(tmp_path / "packed"))
    for semantics in ("reference", "intended"):
        engine = search.SearchEngine(spark, str(tmp_path / "packed"), str(tmp_path / "ranks"), semantics, n_docs=len(ODD))
        want = search.search(spark, "b w3 k none", posted[semantics], ranks, 0, 500, semantics).collect()
        assert [tuple(r) for r in engine.page("b w3 k none", 0, 500).collect()] == [tuple(r) for r in want] and want
    told = []
    monkeypatch.setattr(writers, "write_packed_index", lambda packed, folder: told.append(plan(packed)) or packed.write.parquet(folder))
    monkeypatch.setattr(catalog, "rank_table", lambda spark, sf_dir: ranks)
    catalog.search_ranked_page(spark, few)
    assert len(told) == 1 and not any(x in told[0] for x in ("Exchange", "Join", "Aggregate"))


def test_search_header_counts_over_the_packed_index(spark, few, monkeypatch):
    """The header comes from the engine of packed postings, whose documents are all counted."""
    ranks = spark.range(40).select(F.col("id").alias("fingerprint"), (F.col("id") / 100.0).alias("rank"), F.array(F.lit("http://x.y/")).alias("urls"))
    monkeypatch.setattr(catalog, "rank_table", lambda spark, sf_dir: ranks)
    monkeypatch.setattr(catalog, "_engines", {})
    assert tuple(catalog.search_header(spark, few).first()) == (40, f'Showing results for "{catalog.QUERY}"')
    engine = catalog.engine(spark, few, "reference")
    assert engine.n_docs == 40 and "numbers" in engine.index.columns
