"""Hand-computed values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from siftwell.functions import hashing, http, scoring, text, urls


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(expr).collect()]


def test_tokens_and_stopwords(spark):
    slots = values(spark, ["The cat sat-on the mat.\nCat  www.x.com i"], text.tokens(text.sanitise(text.join_lines(F.col("x")))))[0]
    rows = spark.createDataFrame(list(enumerate(slots)), "pos int, word string")
    kept = {(r.word, r.pos) for r in rows.where(text.is_index_term(F.col("word"))).collect()}
    assert kept == {("cat", 1), ("saton", 2), ("matcat", 4), ("i", 7)}


@pytest.mark.parametrize(
    "given, reference, intended",
    [("a" * 160 + " " + "b" * 20,) + ("a" * 160 + "...",) * 2, ("a" * 150 + " bbb", "a" * 150 + " bbb", "a" * 150 + "..."), ("a" * 150,) * 3, ("a" * 160,) * 3, ("a" * 200, "a" * 171 + "...", "a" * 171 + "..."), ("",) * 3],
)
def test_description_cut(spark, given, reference, intended):
    assert values(spark, [given], text.cut_description(F.col("x"), "reference")) == [reference]
    assert values(spark, [given], text.cut_description(F.col("x"))) == [intended]


def test_query_terms(spark):
    q = "The quick-fox a -- the x i"
    assert values(spark, [q], text.query_terms(F.col("x"), "reference")) == [["the", "quickfox", ""]]
    assert values(spark, [q], text.query_terms(F.col("x"))) == [["quickfox"]]


def test_html(spark):
    html = "<html><head><title> A\n b </title><style>p{}</style><meta name=\"description\" content=\"x  y\"></head><body>caf&eacute; <b>bold</b><script>var t=\"</p>\";</script></body></html>"
    row = spark.createDataFrame([(html,)], "x string").select(text.html_title(F.col("x")), text.meta_description(F.col("x")), text.html_text_faithful("x"), text.html_text(F.col("x"))).first()
    assert row[0] == "A b" and row[1] == "x y"
    assert row[2] == "A b café bold" and "bold" in row[3] and "var" not in row[3]


def test_preview_name(spark):
    assert values(spark, ["http://www.foo.com/x", "https://m.ex.example.net/en", "http://localhost/x"], urls.preview_name(F.col("x"))) == ["foo", "m", "localhost/x"]


def test_urls(spark):
    u = urls.url_struct(F.col("x"))
    rows = values(spark, ["https://Ex.com:8443/A?b#c", "http://ex.com:abc", "HTTP://x", "", None, "https://"], F.struct(u.alias("u"), urls.canonical(u).alias("c")))
    assert tuple(rows[0].u) == ("https", "ex.com", 8443, "/A?b#c") and rows[0].c == "https://ex.com:8443/A?b#c"
    assert rows[1].u.port == 80 and rows[1].c == "http://ex.com/"
    assert all(r.u is None and r.c is None for r in rows[2:])


def test_resolve(spark):
    base = urls.url_struct(F.lit("http://h.org/a/b?q"))
    hrefs = ["http://X.com", "//y.com/z", "/root", "rel", "#top", "JavaScript:x()", "mailto:a@b"]
    assert values(spark, hrefs, urls.resolve(base, F.col("x"))) == ["http://x.com/", "http://y.com/z", "http://h.org/root", "http://h.org/a/rel", None, None, None]


def test_messages(spark):
    rows = values(spark, [(["http://a/b c", "http://d;e"],)], F.struct(urls.message(F.col("x")).alias("m"), urls.message_urls(urls.message(F.col("x"))).alias("u")), "x array<string>")
    assert rows[0].m == "http%3A%2F%2Fa%2Fb+c;http%3A%2F%2Fd%3Be" and rows[0].u == ["http://a/b c", "http://d;e"]


def test_shortest(spark):
    assert values(spark, [(["http://bb", "http://a"],), ([],)], urls.shortest(F.col("x")), "x array<string>") == ["http://a", None]


def test_types_and_lengths(spark):
    assert values(spark, ["text/html; charset=utf-8", "application/rss+xml", "TEXT/HTML", "text/html ;x", None], http.is_markup(F.col("x"))) == [True, True, False, False, False]
    rows = [(5000000, None), (5000001, None), (0, None), (0, "x"), (0, "5000000"), (0, "5000001")]
    assert values(spark, rows, http.fits_length(F.col("n"), F.col("h")), "n long, h string") == [True, False, True, False, True, False]


def test_dates(spark):
    given = ["Fri, 31 Dec 1999 23:59:59", "Friday, 31-Dec-99 23:59:59 GMT", "Fri Dec 31 23:59:59 1999", "garbage", None]
    assert values(spark, given, F.unix_seconds(http.parse_http_date(F.col("x")))) == [946684799] * 3 + [None, None]


def test_headers(spark):
    assert values(spark, ["A: 1\r\nB: x\r\n y\r\nA: 2"], http.parse_headers(F.col("x"))) == [{"A": ["1", "2"], "B": ["x y"]}]
    maps = [({"Content-type": ["a"]},), ({"content-type": ["b"]},), ({},)]
    assert values(spark, maps, http.first_value(http.header(F.col("x"), "Content-Type")), "x map<string,array<string>>") == ["a", "b", None]


def test_shard(spark):
    assert values(spark, ["abc"], hashing.host_shard(F.col("x"), 4)) == [2]
    assert set(values(spark, [f"h{i}" for i in range(200)], hashing.host_shard(F.col("x"), 7))) == set(range(7))


def test_rabin(spark):
    rabin = hashing.rabin_udf()
    a, b, c = values(spark, ["x", "x", "y"], rabin(F.col("x").cast("binary")))
    assert a == b != c


def test_scores(spark):
    assert values(spark, [(1.0,)], text.fixed5(scoring.normalised_tf(F.lit(2), F.lit(3)) + 0 * F.col("x")), "x double") == ["0.80000"]
    got = values(spark, [(2.76884,), (0.0,), (-1.0,), (1.0,)], scoring.rank_weight(F.col("x")), "x double")
    assert got[0] == pytest.approx(0, abs=1e-12) and got[1] == pytest.approx(-0.570324, abs=1e-6) and got[2] == pytest.approx(-0.122823, abs=1e-6) and math.isinf(got[3])


def test_rabin_values_are_remainders():
    """Against long division, for the engine's polynomial and a short one, with empty and absent pages."""

    def remainder(data, polynomial):
        value, degree = int.from_bytes(data, "big"), polynomial.bit_length() - 1
        while value.bit_length() > degree:
            value ^= polynomial << value.bit_length() - 1 - degree
        return value

    pages = [b"", None, b"a", b"<p>hello</p>" * 5, bytes(range(256)), b"\x00\x00a", b"a"]
    for polynomial in (hashing.RABIN_POLYNOMIAL, 0x11B):
        assert hashing.rabin_values(pages, polynomial) == [None if p is None else remainder(p, polynomial) for p in pages]
    assert hashing.rabin_values([]) == []


def test_links_of_either_semantics(spark):
    base = urls.url_struct(F.lit("http://H.x:8080/a/b?c"))
    hrefs = ["https://O.y/p q", "//o.y/z", "/r/s", "t", "#f", "MailTo:x", ""]
    assert values(spark, hrefs, urls.resolve(base, F.col("x"))) == ["https://o.y/p q", "http://o.y/z", "http://h.x:8080/r/s", "http://h.x:8080/a/t", None, None, None]
    assert values(spark, hrefs, urls.resolve(base, F.col("x"), "reference")) == ["https:/%2FO.y%2Fp+q", "http:%2F%2Fo.y%2Fz", "http://h.x:8080/%2Fr%2Fs", "http://h.x:8080/a/t", None, None, "http://h.x:8080/a/"]
    html = '<a href="/1">x</a><a lang="en" href="/2"><a href="/3" lang="de">'
    assert values(spark, [html], urls.hrefs(F.col("x"))) == [["/1", "/2", "/3"]]
    assert values(spark, [html], urls.hrefs(F.col("x"), "reference")) == [["/1"]]


def test_entities(spark):
    assert values(spark, ["a&amp;b &lt;i&gt; &amp;lt; &copy;&foo;."], text.html_text(F.col("x"))) == ["a&b <i> &lt; © ."]
