"""The inverted index: positions, term frequencies, postings, posting lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from . import occurrences
from .storage import stored

MOST_LINE = 4100
# The shortest posting in a line, "d:0.00000:0|", has so many characters.
SHORTEST_POSTING = 12


def sanitised(docs: DataFrame, id_col: str = "doc_id", contents: Column | None = None) -> DataFrame:
    """(doc_id, contents) of documents; contents: sanitised text, by default of the column ``text``."""
    contents = text.sanitise(text.join_lines(F.col("text"))) if contents is None else contents
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), contents.alias("contents"))


def whole(docs: DataFrame, id_col: str = "doc_id", contents: Column | None = None) -> DataFrame:
    """(doc_id, contents), or (doc_id, text) where the text is sanitised as it is counted."""
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), "text") if contents is None else sanitised(docs, id_col, contents)


def token_positions(docs: DataFrame, id_col: str = "doc_id", contents: Column | None = None) -> DataFrame:
    """(doc_id, word, pos) of the index terms; every slot counts as a position."""
    slots = sanitised(docs, id_col, contents).select("doc_id", F.posexplode(text.tokens(F.col("contents"))).alias("pos", "word"))
    return slots.where(text.is_index_term(F.col("word"))).select("doc_id", "word", "pos")


def document_frequency_rows(docs: DataFrame, id_col: str = "doc_id", contents: Column | None = None) -> DataFrame:
    """``term_frequencies`` of whole documents, counted where their texts are, without a shuffle of words."""
    rows = occurrences.frequency_rows(whole(docs, id_col, contents))
    return rows.select("word", "doc_id", "n", scoring.normalised_tf(F.col("n"), F.col("most")).alias("tf"), "positions")


def term_frequencies(positions: DataFrame) -> DataFrame:
    """(word, doc_id, n, tf, positions): tf is 0.4 + 0.6 * n / largest n of the document."""
    counted = positions.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("pos")).alias("positions"))
    most = F.max("n").over(Window.partitionBy("doc_id"))
    return counted.select("word", "doc_id", "n", scoring.normalised_tf(F.col("n"), most).alias("tf"), "positions")


def term_frequency_lines(frequencies: DataFrame) -> DataFrame:
    """``word:doc_id:tf:pos,pos`` with five decimals."""
    return frequencies.select(F.concat_ws(":", "word", "doc_id", text.fixed5(F.col("tf")), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")).alias("value"))


def parse_term_frequency_lines(lines: DataFrame) -> DataFrame:
    """(word, doc_id, tf, positions) of lines; the word is what stands before the first colon."""
    parts = F.split("value", ":", 2)
    rest = F.split(parts[1], ":")
    return lines.select(parts[0].alias("word"), rest[0].alias("doc_id"), rest[1].cast("double").alias("tf"), F.transform(F.split(rest[2], ","), lambda p: p.cast("int")).alias("positions"))


def document_frequencies(frequencies: DataFrame, n_docs: Column | int) -> DataFrame:
    """(word, df, idf)."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return frequencies.groupBy("word").agg(F.count("*").alias("df")).withColumn("idf", scoring.idf(n.cast("double"), F.col("df")))


def round5(value: Column) -> Column:
    """A number through its text of five decimals."""
    return F.replace(text.fixed5(value), F.lit(","), F.lit("")).cast("double")


def postings(frequencies: DataFrame, n_docs: int, semantics: str = "intended") -> DataFrame:
    """(word, doc_id, tfidf, positions), a row for each posting.

    intended: tf * idf; reference: the rounded product is multiplied by idf once more.  The
    counts by word are joined back, so a word of most documents is a skewed join, which
    adaptive execution splits, and never a window or a list.  Frequencies are used on both
    sides of that join, so they are written to the shared folder first.
    """
    frequencies = stored(frequencies, "frequencies")
    weights = document_frequencies(frequencies, n_docs)
    score = scored(F.col("tf"), F.col("idf"), semantics)
    return frequencies.join(weights, "word").select("word", "doc_id", score.alias("tfidf"), "positions", "df")


def scored(tf: Column, idf: Column, semantics: str) -> Column:
    """TF-IDF of ``postings``."""
    once = round5(round5(tf) * idf)
    return round5(once * idf) if semantics == "reference" else once


def packed_weights(packed: DataFrame, n_docs: int) -> DataFrame:
    """(word, df, idf) of packed postings."""
    return packed.groupBy("word").agg(F.sum("k").alias("df")).withColumn("idf", scoring.idf(F.lit(n_docs).cast("double"), F.col("df")))


def document_postings(docs: DataFrame, n_docs: int, semantics: str = "intended", terms: DataFrame | None = None, positions: bool = True) -> DataFrame:
    """``postings`` of whole documents; of the words in ``terms`` only, if given.

    What meets the counts by word is packed postings, some of the bytes of the texts, which come
    from a written table, so that adaptive execution splits the rows of a word of most documents.
    """
    packed = stored(packed_postings(docs), "packed")
    if terms is not None:
        packed = packed.join(F.broadcast(terms.select("word").distinct()), "word", "left_semi")
    return scored_postings(packed, n_docs, semantics, positions)


def packed_postings(docs: DataFrame) -> DataFrame:
    """The index of whole documents in packed rows, not yet weighed: made where the texts are, without a shuffle of words."""
    return occurrences.packed(whole(docs))


def scored_postings(packed: DataFrame, n_docs: int, semantics: str = "intended", positions: bool = True) -> DataFrame:
    """``postings`` of packed rows, which hold all postings of their words; they are read twice."""
    met = packed.join(packed_weights(packed, n_docs), "word")
    rows = occurrences.unpack(met, "df bigint, idf double", positions)
    tf = scoring.normalised_tf(F.col("n"), F.col("most"))
    return rows.select("word", "doc_id", scored(tf, F.col("idf"), semantics).alias("tfidf"), *["positions"] * positions, "df")


def document_posting_lines(docs: DataFrame, n_docs: int, semantics: str = "intended", most_chars: int = MOST_LINE) -> DataFrame:
    """``posting_lines`` of whole documents: words with too many postings go before anything is unpacked.

    The packed rows of a word are put together where they met its count, so no posting is
    shuffled on its own.
    """
    packed = stored(packed_postings(docs), "packed")
    few = packed_weights(packed, n_docs).where(F.col("df") * SHORTEST_POSTING - 1 <= most_chars)
    met = packed.join(few, "word").groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("k", "numbers", "ids")).alias("packed"))
    rows = occurrences.unpack_lists(met, "idf double")

    def entry(x: Column) -> Column:
        score = scored(scoring.normalised_tf(x["n"], x["most"]), F.col("idf"), semantics)
        return F.struct((-score).alias("s"), x["doc_id"].alias("doc_id"), x["positions"].alias("p"))

    def told(x: Column) -> Column:
        return F.concat_ws(":", x["doc_id"], text.fixed5(-x["s"]), F.array_join(x["p"].cast("array<string>"), ","))

    line = F.array_join(F.transform(F.array_sort(F.transform("list", entry)), told), "|")
    lines = rows.select("word", F.concat(F.col("word"), F.lit("\t"), line).alias("line"))
    return lines.where(F.length("line") <= most_chars)


def document_word_counts(docs: DataFrame, n_docs: int) -> DataFrame:
    """``document_frequencies`` of whole documents: a slice of them sends each of its words once."""
    return packed_weights(occurrences.word_counts(whole(docs)), n_docs)


def posting_lines(rows: DataFrame, most_chars: int | None = MOST_LINE) -> DataFrame:
    """(word, line): ``word\\tdoc:score:pos,pos|doc:score:pos``, best scores first, ties by id.

    With ``most_chars`` longer lines are dropped.  As a posting takes SHORTEST_POSTING
    characters at least, words with too many postings are dropped before their lists are
    made, so a list is bounded.
    """
    if most_chars is not None:
        rows = rows.where(F.col("df") * SHORTEST_POSTING - 1 <= most_chars)
    entry = F.concat_ws(":", "doc_id", text.fixed5(F.col("tfidf")), F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))
    grouped = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((-F.col("tfidf")).alias("s"), "doc_id", entry.alias("e")))).alias("list"))
    lines = grouped.select("word", F.concat(F.col("word"), F.lit("\t"), F.array_join(F.transform("list", lambda x: x["e"]), "|")).alias("line"))
    return lines if most_chars is None else lines.where(F.length("line") <= most_chars)


def parse_posting_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """(word, doc_id, tfidf, positions) of posting lines, a row for each posting."""
    halves = F.split(col, "\t", 2)
    rows = lines.select(F.trim(halves[0]).alias("word"), F.explode(F.split(F.trim(halves[1]), r"\|")).alias("entry"))
    parts = F.split("entry", ":")
    return rows.select("word", parts[0].alias("doc_id"), parts[1].cast("double").alias("tfidf"), F.transform(F.split(parts[2], ","), lambda p: p.cast("int")).alias("positions"))


def snippets(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", semantics: str = "intended") -> DataFrame:
    """(doc_id, description, title, line) for result pages."""
    description = text.cut_description(text.meta_description(F.col(html_col)), semantics)
    rows = pages.select(F.col(id_col).cast("string").alias("doc_id"), description.alias("description"), text.html_title(F.col(html_col)).alias("title"))
    return rows.withColumn("line", F.concat(F.col("doc_id"), F.lit(":"), F.col("description"), F.lit("\t"), F.col("title")))
