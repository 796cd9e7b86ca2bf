"""The crawl side: links, robots rules, frontier, stores of pages and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, http, urls


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", semantics: str = "intended") -> DataFrame:
    """(page_id, pos, href, url): the anchors of pages with their absolute URLs; null url: no link.

    All is the input of one generator, which Spark evaluates once for each page.
    """

    def anchors(base: Column) -> Column:
        return F.transform(urls.hrefs(F.col(html_col), semantics), lambda h, i: F.struct(i.alias("pos"), h.alias("href"), urls.resolve(base, h, semantics).alias("url")))

    return pages.select(F.col(id_col).alias("page_id"), F.inline(urls.let(urls.url_struct(F.col(url_col)), anchors)))


def inlink_counts(resolved: DataFrame) -> DataFrame:
    """(url, n) of links by target."""
    return resolved.where(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n"))


def link_graph(resolved: DataFrame, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(src, dst) between known pages: the link graph that ranks are computed on."""
    known = pages.select(F.col(id_col).cast("string").alias("dst"), urls.canonical(urls.url_struct(F.col("url"))).alias("url"))
    return resolved.join(known, "url").select(F.col("page_id").cast("string").alias("src"), "dst")


def parse_robots(files: DataFrame, agent: str = "siftwell") -> DataFrame:
    """(domain, line_no, agent, directive, value) of robots files (domain, body).

    Directives are case-sensitive; a rule belongs to the last agent line before it, and rules
    of agents other than * and ``agent`` are left out.  Sitemaps belong to none.
    """
    rows = files.select("domain", F.posexplode(F.split("body", "\r\n|\n|\r")).alias("line_no", "raw")).withColumn("line", F.trim("raw"))
    rows = rows.withColumn("named", F.when(F.col("line").startswith("User-agent:"), F.trim(F.substring("line", 12, 1 << 30))))
    before = Window.partitionBy("domain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("agent", F.last("named", ignorenulls=True).over(before))
    directive = F.regexp_extract("line", "^(Sitemap|Disallow|Allow|Crawl-delay|User-agent):", 1)
    value = F.trim(F.regexp_replace("line", "^[A-Za-z-]+:", ""))
    found = rows.select("domain", "line_no", F.when(directive != "Sitemap", F.col("agent")).alias("agent"), directive.alias("directive"), value.alias("value")).where("directive <> ''")
    keep = (F.col("directive") == "Sitemap") | F.coalesce(F.col("agent").isin("*", agent), F.lit(False))
    return found.where(keep & ((F.col("directive") != "Crawl-delay") | F.col("value").try_cast("int").isNotNull()))


def rules_for(rules: DataFrame, agent: str = "siftwell") -> DataFrame:
    """Rules of the own agent where a domain names it, else those of *."""
    named = F.max(F.coalesce((F.col("agent") == agent).cast("int"), F.lit(0))).over(Window.partitionBy("domain"))
    return rules.withColumn("named", named).where(F.col("agent") == F.when(F.col("named") == 1, agent).otherwise("*")).drop("named")


def crawl_delays(rules: DataFrame) -> DataFrame:
    """(domain, delay_ms) by the last delay line; domains without one are left out."""
    return rules.where("directive = 'Crawl-delay'").groupBy("domain").agg((F.max_by(F.col("value").cast("int"), "line_no") * 1000).alias("delay_ms"))


def robots_decisions(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, path, allowed): the longest matching Disallow, unless an Allow is longer.

    Rules are joined on the domain and matched by prefix as a condition of that join.
    """
    wanted = rules.where("directive in ('Allow', 'Disallow') and value <> ''").select(F.col("domain").alias("_d"), "directive", "value")
    met = paths.join(wanted, (F.col("domain") == F.col("_d")) & F.startswith(F.col("path"), F.col("value")), "left")
    longest = lambda kind: F.coalesce(F.max(F.when(F.col("directive") == kind, F.length("value"))), F.lit(0))
    return met.groupBy("domain", "path").agg(longest("Disallow").alias("no"), longest("Allow").alias("yes")).select("domain", "path", ((F.col("no") == 0) | (F.col("yes") > F.col("no"))).alias("allowed"))


def frontier_entries(found: DataFrame, url_col: str = "url") -> DataFrame:
    """(domain, path) of valid URLs."""
    entry = urls.let(urls.url_struct(F.col(url_col)), lambda u: F.when(u.isNotNull(), F.struct(urls.domain(u).alias("domain"), u["path"].alias("path"))))
    return found.select(F.inline(F.filter(F.array(entry), lambda e: e.isNotNull())))


def whitelisted(entries: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Entries of the listed domains."""
    return entries.join(whitelist.select("domain").distinct(), "domain", "left_semi")


def unseen(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct entries that were not seen before."""
    return entries.distinct().join(seen.select("domain", "path"), ["domain", "path"], "left_anti")


def progress(state: DataFrame) -> DataFrame:
    """(domain, done, pending) of a frontier."""
    return state.groupBy("domain").agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("pending"))


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row of each key (ties to the greatest row), map-side combined."""
    rest = [c for c in rows.columns if c not in (key, time)]
    best = rows.groupBy(key).agg(F.max(F.struct(time, *rest)).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def upsert(store: DataFrame, rows: DataFrame, key: str, time: str) -> DataFrame:
    """A store after an idempotent upsert: the latest row of each key of both."""
    return latest(store.unionByName(rows), key, time)


def deposit(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages (fingerprint, ...) whose content isn't stored yet, one for each fingerprint."""
    return pages.dropDuplicates(["fingerprint"]).join(known.select("fingerprint"), "fingerprint", "left_anti")


def fetchable(responses: DataFrame, semantics: str = "intended") -> DataFrame:
    """Responses (content_type, headers, content_length, status) that a fetch keeps; semantics="reference" keeps those of any status."""
    kind = F.coalesce("content_type", http.first_value(http.header(F.col("headers"), "Content-Type")))
    length = http.first_value(http.header(F.col("headers"), "Content-Length"))
    return responses.where(http.is_markup(kind) & http.fits_length(F.col("content_length"), length) & (F.lit(semantics == "reference") | (F.col("status") == 200)))


def to_extract_again(requested: DataFrame, sites: DataFrame, prints: DataFrame, crawl_time: Column) -> DataFrame:
    """Requested URLs that a server calls unmodified and whose content was last parsed before this crawl."""
    met = requested.where("status = 304").join(sites, "url", "left").join(prints, "fingerprint", "left")
    return met.where(F.col("lastparsed") < crawl_time)


def content_groups(docs: DataFrame, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """(digest, first_id, n): documents by equal content."""
    return docs.groupBy(hashing.content_digest(F.col(content_col)).alias("digest")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))


def shortest_urls(pages: DataFrame, key: Column, url_col: str = "url") -> DataFrame:
    """(key, url): the shortest URL of each key."""
    best = F.min(F.struct(F.length(url_col).alias("n"), F.col(url_col).alias("url")))
    return pages.groupBy(key.alias("key")).agg(best.alias("b")).select("key", F.col("b.url").alias("url"))


def routed(entries: DataFrame, n: int) -> DataFrame:
    """Entries with the worker shard of their host."""
    host = F.regexp_extract("domain", "^https?://([^/:]+)", 1)
    return entries.withColumn("shard", hashing.host_shard(host, n))


def schedule(queued: DataFrame) -> DataFrame:
    """(turn, domain, path): when each queued URL (domain, path, wanted, seq) is asked for.

    A domain's GET queue goes before its HEAD queue, each first in, first out; the domains take
    turns, so all of one turn come before any of the next.  A URL queued twice keeps its first
    place.  A domain's queue is sorted in one task, as its requests follow one another anyway.
    """
    first = queued.groupBy("domain", "path").agg(F.max(F.col("wanted") == "get").alias("get"), F.min("seq").alias("seq"))
    order = Window.partitionBy("domain").orderBy(F.col("get").desc(), "seq", "path")
    return first.select(F.row_number().over(order).alias("turn"), "domain", "path")
