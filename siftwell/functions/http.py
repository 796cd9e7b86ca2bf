"""HTTP values: types, lengths, status, dates, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 5_000_000
DATE_FORMAT = "EEE, d MMM yyyy HH:mm:ss"


def header(headers: Column, name: str) -> Column:
    """First value of a header under its usual spellings (Content-Type, Content-type, content-type)."""
    head, _, rest = name.partition("-")
    spellings = dict.fromkeys([name, f"{head}-{rest.lower()}" if rest else name, name.lower()])
    return F.coalesce(*[F.try_element_at(headers, F.lit(x)) for x in spellings])


def first_value(values: Column) -> Column:
    return F.get(values, F.lit(0))


def media_type(content_type: Column) -> Column:
    """What stands before the first semicolon."""
    return F.split_part(content_type, F.lit(";"), F.lit(1))


def is_markup(content_type: Column) -> Column:
    """HTML or XML by its media type, case-sensitively."""
    kind = media_type(content_type)
    return F.coalesce(kind.isin("text/html", "text/xml", "application/xml") | kind.endswith("+xml"), F.lit(False))


def fits_length(content_length: Column, length_header: Column, most: int = MOST_BYTES) -> Column:
    """A known length within the limit; an unknown one passes, an unreadable one doesn't."""
    read = length_header.try_cast("int") <= most
    return F.when(content_length > 0, content_length <= most).when(length_header.isNull(), True).otherwise(F.coalesce(read, F.lit(False)))


def head_action(status: Column) -> Column:
    """After a HEAD request: fetch, extract again from the store, or done."""
    return F.when(status == 200, "get").when(status == 304, "extract").otherwise("done")


def may_fetch(last_ms: Column, delay_ms: Column, now_ms: Column, queued: Column) -> Column:
    """Whether a domain with a queue may be asked again."""
    return (queued > 0) & ((delay_ms == 0) | (last_ms + delay_ms < now_ms))


def http_date(ts: Column) -> Column:
    """A timestamp as HTTP date, without a zone (the session runs in UTC)."""
    return F.date_format(ts, DATE_FORMAT)


def parse_http_date(text: Column, pivot: int = 70) -> Column:
    """A date in any of the three HTTP forms; null if it is none.

    Two-digit years below ``pivot`` are of this century.
    """
    plain = F.regexp_replace(F.trim(text), "^[A-Za-z]+,? +", "")
    plain = F.regexp_replace(plain, " (GMT|UTC)$", "")
    year = F.regexp_extract(plain, r"^[0-9]{1,2}-[A-Za-z]{3}-([0-9]{2}) ", 1)
    century = F.when(year.try_cast("int") < pivot, "20").otherwise("19")
    full = F.when(year != "", F.regexp_replace(plain, r"^([0-9]{1,2}-[A-Za-z]{3}-)([0-9]{2}) ", "$1#$2 ")).otherwise(plain)
    full = F.replace(full, F.lit("#"), century)
    single = F.regexp_replace(full, " +", " ")
    return F.coalesce(*[F.try_to_timestamp(single, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss", "d-MMM-yyyy HH:mm:ss", "MMM d HH:mm:ss yyyy")])


def parse_headers(raw: Column) -> Column:
    """Header lines as a map; a line that starts with white space goes on the one before."""
    unfolded = F.regexp_replace(F.regexp_replace(raw, "\r\n|\r", "\n"), "\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, "\n"), lambda x: x.contains(":"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])))
