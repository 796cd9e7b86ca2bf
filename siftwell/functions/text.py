"""Text: visible HTML text, tokens, snippets, query terms, fixed-point numbers."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that are left out of the index and of queries.
STOPWORDS = [
    "a", "about", "an", "are", "as", "at", "be", "by", "com", "for", "from", "how", "in", "is", "it",
    "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "who", "will", "with",
]
# The index list has an upper-case "I", which no lower-cased token equals; queries have "i".
INDEX_STOPWORDS = ["I", *STOPWORDS]
QUERY_STOPWORDS = ["i", *STOPWORDS]


def join_lines(text: Column) -> Column:
    """Lines put together without a separator, so words across a line end fuse."""
    return F.regexp_replace(text, "\r\n|\n|\r", "")


# The entities that pages use most, besides the ampersand's.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\u00a0", "&copy;": "\u00a9", "&middot;": "\u00b7"}
AMPERSAND = "\x01"  # stands for a decoded ampersand, so that none of what follows it is taken for an entity


def html_text(html: Column) -> Column:
    """Visible text by patterns; usual entities are decoded, others blanked (see ``html_text_faithful`` for all)."""
    text = join_lines(html)
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    for entity, char in {"&amp;": AMPERSAND, **ENTITIES}.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(F.regexp_replace(text, "&[A-Za-z0-9#]+;", " "), F.lit(AMPERSAND), F.lit("&"))


def html_title(html: Column) -> Column:
    """Text of the title with white space collapsed; '' if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def meta_description(html: Column) -> Column:
    """Content of the description tag with white space collapsed; '' if there is none."""
    tag = F.regexp_extract(html, r"""(?is)<meta[^>]*\bname\s*=\s*["']description["'][^>]*>""", 0)
    return F.trim(F.regexp_replace(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1), r"\s+", " "))


def sanitise(text: Column) -> Column:
    """Letters, digits and white space only, lower-cased; hyphens and accents go, white space stays."""
    return F.lower(F.regexp_replace(text, r"[^A-Za-z0-9\s]", ""))


def tokens(contents: Column) -> Column:
    """One slot for each single white-space separator, empty slots included."""
    return F.split(contents, r"\s")


def is_index_term(word: Column) -> Column:
    return (word != "") & ~word.isin(INDEX_STOPWORDS) & ~word.startswith("www")


def fixed5(value: Column) -> Column:
    """Five decimals, half to even."""
    return F.format_number(value, 5)


def cut_description(text: Column, semantics: str = "intended") -> Column:
    """Cut at the first white space from character 150 on, at 171 at most, and add '...'.

    semantics="reference": a text whose character 150 is white space stays whole.
    """
    after = F.regexp_instr(F.substring(text, 151, 21), F.lit(r"\s"))
    at = F.when(after > 0, 149 + after).otherwise(171)
    cut = F.when(at < F.length(text), F.concat(F.substring(text, F.lit(1), at), F.lit("..."))).otherwise(text)
    if semantics == "reference":
        return F.when(F.substring(text, 151, 1).rlike(r"^\s$"), text).otherwise(cut)
    return cut


def query_terms(query: Column, semantics: str = "intended") -> Column:
    """Array of a query's terms, repeats kept.

    reference: stop words and lengths 2 to 50 are tested on the raw word, before cleaning;
    intended: on the cleaned word.
    """
    raw = F.transform(F.split(query, " "), lambda w: F.trim(w))
    clean = lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", ""))
    if semantics == "intended":
        raw = F.transform(raw, clean)
    keep = F.filter(raw, lambda w: ~w.isin(QUERY_STOPWORDS) & F.length(w).between(2, 50))
    return F.transform(keep, clean)


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(StringType())
def html_text_faithful(html: pd.Series) -> pd.Series:
    """Visible text by a parser (Arrow UDF): entities decoded, white space collapsed."""

    def one(text):
        if text is None:
            return None
        parser = _Visible()
        parser.feed(text)
        parser.close()
        return re.sub(r"\s+", " ", "".join(parser.parts)).strip()

    return html.map(one)
