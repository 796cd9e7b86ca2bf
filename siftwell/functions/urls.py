"""URLs as structs and canonical strings, and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_url(url: Column) -> Column:
    """An http or https URL with a host."""
    return F.coalesce(F.trim(url).rlike(r"^https?://[^/]+"), F.lit(False))


def url_struct(url: Column) -> Column:
    """scheme, lower-cased host, port (default where missing or unreadable), path with query and fragment; null if no URL.

    Each step binds what the one before has found, so a URL is taken apart once wherever the struct is used.
    """

    def rest_of(text: Column, part: Column, more: int) -> Column:
        return F.substring(text, F.length(part) + 1 + more, F.length(text))

    def split(text: Column) -> Column:
        scheme = F.substring_index(text, "://", 1)
        return let(F.struct(scheme.alias("scheme"), rest_of(text, scheme, 3).alias("rest")), address)

    def address(u: Column) -> Column:
        host = F.substring_index(u["rest"], "/", 1)
        return let(F.struct(u["scheme"].alias("scheme"), host.alias("address"), rest_of(u["rest"], host, 0).alias("path")), fields)

    def fields(u: Column) -> Column:
        digits = F.trim(F.regexp_extract(u["address"], r":(.*)$", 1))
        given = F.when(digits.rlike(r"^[+-]?[0-9]{1,9}$"), digits.try_cast("int"))
        return F.struct(
            u["scheme"].alias("scheme"),
            F.lower(F.trim(F.substring_index(u["address"], ":", 1))).alias("host"),
            F.coalesce(given, default_port(u["scheme"])).alias("port"),
            F.when(u["path"] == "", "/").otherwise(u["path"]).alias("path"),
        )

    return let(url, lambda text: F.when(is_url(text), let(F.trim(text), split)))


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "https", 443).otherwise(80)


def canonical(parts: Column, path: Column | None = None) -> Column:
    """The canonical string of a URL struct (or of it with another path); the default port is left out."""

    def text(u: Column) -> Column:
        port = F.when(u["port"] == default_port(u["scheme"]), "").otherwise(F.concat(F.lit(":"), u["port"].cast("string")))
        return F.concat(u["scheme"], F.lit("://"), u["host"], port, u["path"] if path is None else path)

    return let(parts, text)


def domain(parts: Column) -> Column:
    """Canonical form of the root of a URL."""
    return canonical(parts, F.lit("/"))


def with_path(parts: Column, path: Column) -> Column:
    """The URL with another path, which gets a leading slash if it has none."""
    return let(parts, lambda u: u.withField("path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def append_path(parts: Column, path: Column) -> Column:
    """A path relative to the directory of the URL's path; dots are not resolved."""
    return let(parts, lambda u: u.withField("path", F.concat(F.regexp_replace(u["path"], "/[^/]*$", ""), F.lit("/"), path)))


def same_domain(a: Column, b: Column) -> Column:
    return (a["host"] == b["host"]) & (a["scheme"] == b["scheme"]) & (a["port"] == b["port"])


def preview_name(url: Column) -> Column:
    """What follows ``www.`` or else the scheme, up to the next dot."""
    after = lambda mark: F.substring(url, F.locate(mark, url) + len(mark), F.length(url))
    rest = F.when(url.contains("www."), after("www.")).when(url.contains("http://"), after("http://")).when(url.contains("https://"), after("https://"))
    return F.coalesce(F.substring_index(rest, ".", 1), url)


def shortest(urls: Column) -> Column:
    """The shortest of an array of URLs, the first by code point among equals."""
    return F.array_min(F.transform(urls, lambda u: F.struct(F.length(u).alias("n"), u.alias("url"))))["url"]


def hrefs(html: Column, semantics: str = "intended") -> Column:
    """Array of the href values of anchors, in order; semantics="reference" passes over anchors with a language."""
    if semantics == "reference":
        anchors = F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*href=["'][^>]*"""), F.lit(0))
        plain = F.filter(anchors, lambda a: ~a.rlike(r"""\blang\s*="""))
        return F.transform(plain, lambda a: F.regexp_extract(a, r"""href=["']([^"']*)""", 1))
    return F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*href=["']([^"']*)"""), F.lit(1))


def is_link(href: Column) -> Column:
    """Not a fragment, a script or a mail address."""
    return (href != "") & ~href.startswith("#") & ~F.lower(href).rlike("^(javascript|mailto):")


def resolve(base: Column, href: Column, semantics: str = "intended") -> Column:
    """The absolute canonical URL of a link on the page ``base`` (a URL struct); null if it is none.

    semantics="reference": what the page names is form-encoded as a whole, slashes too, behind
    the scheme or the page's root or folder; once decoded, a link from the root has two slashes.
    """
    if semantics == "reference":
        joined = (
            F.when(href.rlike("^https?://"), F.concat(F.substring(href, F.lit(1), F.lit(7)), F.url_encode(F.substring(href, F.lit(8), F.length(href)))))
            .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), F.url_encode(href)))
            .when(href.startswith("/"), F.concat(domain(base), F.url_encode(href)))
            .otherwise(canonical(append_path(base, F.url_encode(href))))
        )
        return F.when(is_link(href) | (href == ""), joined)
    joined = (
        F.when(href.rlike("^https?://"), canonical(url_struct(href)))
        .when(href.startswith("//"), canonical(url_struct(F.concat(base["scheme"], F.lit(":"), href))))
        .when(href.startswith("/"), canonical(base, href))
        .otherwise(canonical(append_path(base, href)))
    )
    return F.when(is_link(href), joined)


def message(urls: Column) -> Column:
    """An array of URLs as one queue message: form-encoded, joined by semicolons."""
    return F.array_join(F.transform(urls, lambda u: F.url_encode(u)), ";")


def message_urls(value: Column) -> Column:
    """The URLs of a queue message."""
    return F.transform(F.filter(F.split(value, ";"), lambda x: x != ""), lambda x: F.url_decode(x))
