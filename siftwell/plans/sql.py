"""DuckDB SQL of the catalogue's queries, built from shared table expressions."""

from __future__ import annotations

from ..functions.text import AMPERSAND, ENTITIES, INDEX_STOPWORDS, QUERY_STOPWORDS


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = quoted(INDEX_STOPWORDS)

# Java's \s has the vertical tab, RE2's has not, so the class is spelt out.
SLOTS = rf"""
slots as (
  select doc_id, unnest(ws) as word, unnest(range(0, len(ws)))::integer as pos
  from (select doc_id, regexp_split_to_array(contents, '[ \t\n\x0B\f\r]') as ws from contents)),
positions as (select doc_id, word, pos from slots where word <> '' and word not in ({STOP}) and not starts_with(word, 'www'))"""
DOCS = r"""contents as (
  select doc_id::varchar as doc_id, lower(regexp_replace(regexp_replace(text, '\r\n|\n|\r', '', 'g'), '[^A-Za-z0-9 \t\n\x0B\f\r]', '', 'g')) as contents from documents),"""
def decoded(text: str) -> str:
    for entity, char in {"&amp;": AMPERSAND, **ENTITIES}.items():
        text = f"replace({text}, {quoted([entity])}, chr({ord(char)}))"
    return f"replace(regexp_replace({text}, '&[A-Za-z0-9#]+;', ' ', 'g'), chr({ord(AMPERSAND)}), '&')"


VISIBLE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n|\n|\r', '', 'g'),
    '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
PAGES = rf"""contents as (
  select page_id::varchar as doc_id, lower(regexp_replace({decoded(VISIBLE)}, '[^A-Za-z0-9 \t\n\x0B\f\r]', '', 'g')) as contents from pages),"""
FREQ = """,
counted as (select doc_id, word, count(*) as n, string_agg(pos::varchar, ',' order by pos) as positions from positions group by doc_id, word),
freq as (select *, 0.4::double + (1 - 0.4::double) * n / max(n) over (partition by doc_id) as tf from counted)"""
WEIGHTS = """,
n_docs as (select count(*) as n from documents),
df as (select word, count(*) as df, ln((select n from n_docs)::double / count(*)) as idf from freq group by word),
posted as (
  select freq.word, doc_id, positions, df, idf, printf('%.5f', printf('%.5f', tf)::double * idf)::double as once from freq join df on freq.word = df.word)"""


def posted(semantics: str) -> str:
    score = "printf('%.5f', once * idf)::double" if semantics == "reference" else "once"
    return f"with {DOCS}{SLOTS}{FREQ}{WEIGHTS}, postings as (select word, doc_id, {score} as tfidf, positions, df from posted)"


URL = r"""urls as (
  select page_id, url, regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 1) as scheme, lower(split_part(regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 2), ':', 1)) as host,
    coalesce(try_cast(nullif(split_part(regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 2), ':', 2), '') as integer), case when starts_with(url, 'https') then 443 else 80 end) as port,
    case when regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 3) = '' then '/' else regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 3) end as path
  from pages where regexp_matches(url, '^https?://[^/]+')),
roots as (select *, scheme || '://' || host || case when port = case when scheme = 'https' then 443 else 80 end then '' else ':' || port end as root from urls)"""
LINKS = URL + r""",
anchors as (
  select page_id, unnest(h) as href, unnest(g) as tag, unnest(range(0, len(h)))::integer as pos
  from (select page_id, regexp_extract_all(html, '<a\b[^>]*href=["\x27]([^"\x27]*)', 1) as h, regexp_extract_all(html, '<a\b[^>]*href=["\x27][^>]*', 0) as g from pages)),
joined as (
  select a.page_id, pos, href, case
    when regexp_matches(href, '^https?://') or starts_with(href, '//') then null
    when starts_with(href, '/') then root || href
    else root || regexp_replace(path, '/[^/]*$', '') || '/' || href end as url
  from anchors a join roots r on a.page_id = r.page_id
  where href <> '' and not starts_with(href, '#') and not regexp_matches(lower(href), '^(javascript|mailto):'))"""
# The same over a relation of pages whose links may be absolute.
NEXT = LINKS.replace("from pages", "from linked").replace("when regexp_matches(href, '^https?://') or starts_with(href, '//') then null", "when starts_with(href, '//') then null when regexp_matches(href, '^https?://') then href")
ENTRIES = URL + ", entries as (select page_id, root || '/' as domain, path from roots)"
EDGES = "edges as (select 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem union all select 's' || l_suppkey, 'p' || l_partkey from lineitem)"


def pagerank(steps: int, damped: bool) -> str:
    """Common table expressions e, r0 .. r<steps>."""
    value = "sum(r.rank / d.degree)"
    value = f"({value}) * (1 - 1.0::double / 7) + 1.0::double / 7" if damped else value
    out = [EDGES, "degree as (select src, count(*)::double as degree from edges group by src)", "r0 as (select src as id, 1.0::double as rank from degree)"]
    for i in range(1, steps + 1):
        out.append(f"r{i} as (select e.dst as id, {value} as rank from edges e join degree d on e.src = d.src join r{i - 1} r on r.id = e.src group by e.dst)")
    return ", ".join(out)


def terms(query: str, semantics: str) -> list[str]:
    clean = lambda w: "".join(c for c in w if c.isascii() and c.isalnum()).lower()
    words = [w.strip() for w in query.split(" ")]
    words = [clean(w) for w in words] if semantics == "intended" else words
    return [clean(w) for w in words if w not in QUERY_STOPWORDS and 2 <= len(w) <= 50]


def top500(query: str, semantics: str) -> str:
    words = ", ".join(f"({quoted([w])})" for w in terms(query, semantics))
    return f"{posted(semantics)}, terms(word) as (values {words}), top as (select doc_id, sum(tfidf) as tfidf from terms join postings using (word) group by doc_id order by round(sum(tfidf), 5) desc, doc_id limit 500)"


def page(query: str, semantics: str, start: int) -> str:
    return f"""{top500(query, semantics)}, {pagerank(5, True)},
ranks as (select substr(id, 2)::bigint as fingerprint, round(rank, 9) as rank from r5 where starts_with(id, 'p')),
met as (
  select doc_id, url, rank, tfidf, (tfidf - 21.6::double) / 15 + 0.1::double * case when rank = 1 then '-inf'::double when rank < 0 then -ln(abs((rank - 1) / 1.76884::double)) else ln(abs((rank - 1) / 1.76884::double)) end as w
  from top join ranks on try_cast(doc_id as bigint) = fingerprint join pages on page_id = fingerprint where url is not null)
select doc_id, url, round(rank, 6) as page_rank, round(tfidf, 5) as tfidf, round(w, 6) as weighted_value,
  split_part(case when contains(url, 'www.') then substr(url, strpos(url, 'www.') + 4) when contains(url, 'http://') then substr(url, strpos(url, 'http://') + 7) when contains(url, 'https://') then substr(url, strpos(url, 'https://') + 8) else url end, '.', 1) as preview_name
from met order by w desc, met.tfidf desc, doc_id limit 10 offset {start}"""


def cut(text: str, reference: bool) -> str:
    found = f"strpos(substr({text}, 151, 21), ' ')"
    at = f"case when {found} > 0 then 149 + {found} else 171 end"
    out = f"case when {at} < length({text}) then substr({text}, 1, {at}) || '...' else {text} end"
    return f"case when substr({text}, 151, 1) = ' ' then {text} else {out} end" if reference else out


def robots(agent: str, bodies: list[str]) -> str:
    files = ", ".join("'" + b.replace("\n", "' || chr(10) || '") + "'" for b in bodies)
    return f"""{ENTRIES},
files as (select domain, string_split([{files}][length(domain) % 3 + 1], chr(10)) as ls from (select distinct domain from entries)),
lines as (select domain, trim(unnest(ls)) as line, unnest(range(0, len(ls)))::integer as line_no from files),
named as (
  select *, last_value(case when starts_with(line, 'User-agent:') then trim(substr(line, 12)) end ignore nulls) over (partition by domain order by line_no rows between unbounded preceding and current row) as agent from lines),
parsed as (
  select domain, line_no, case when regexp_extract(line, '^(Sitemap|Disallow|Allow|Crawl-delay|User-agent):', 1) <> 'Sitemap' then agent end as agent,
    regexp_extract(line, '^(Sitemap|Disallow|Allow|Crawl-delay|User-agent):', 1) as directive, trim(regexp_replace(line, '^[A-Za-z-]+:', '')) as value from named),
rules as (
  select * from parsed where directive <> '' and (directive = 'Sitemap' or coalesce(agent in ('*', '{agent}'), false)) and (directive <> 'Crawl-delay' or try_cast(value as integer) is not null)),
own as (
  select * exclude (has) from (select *, max(case when agent = '{agent}' then 1 else 0 end) over (partition by domain) as has from rules where directive <> 'Sitemap') where agent = case when has = 1 then '{agent}' else '*' end)"""


RESPONSES = """responses as (
  select event_id, user_id, ['text/html; charset=utf-8', 'application/rss+xml', 'TEXT/HTML', 'text/html ;x', 'application/xml', 'image/png'][event_id % 6 + 1] as kind,
    ['4999999', '5000001', 'x', null, '5000000'][event_id % 5 + 1] as length, case when event_id % 4 = 0 then 0 else event_id % 3 * 4000000 end as content_length, [200, 304, 404, 200, 200, 200, 301][event_id % 7 + 1] as status from events),
checked as (
  select *, split_part(kind, ';', 1) in ('text/html', 'text/xml', 'application/xml') or ends_with(split_part(kind, ';', 1), '+xml') as markup,
    case when content_length > 0 then content_length <= 5000000 when length is null then true else coalesce(try_cast(length as integer) <= 5000000, false) end as fits from responses)"""
WHITELIST = "whitelist as (select distinct domain from entries where page_id % 3 = 0)"
SHARD = "least(3, ('0x' || substr(sha1({0}), 1, 15))::bigint // ((1::bigint << 60) // 4))::integer"


def twins(query: str, agent: str, bodies: list[str]) -> dict[str, str]:
    from_docs = f"with {DOCS}{SLOTS}"
    lines = "word || chr(9) || string_agg(doc_id || ':' || printf('%.5f', tfidf) || ':' || positions, '|' order by tfidf desc, doc_id)"
    both = ", ".join(f"({quoted([s])}, {quoted([w])})" for s in ("reference", "intended") for w in terms(query, s))
    text = r"regexp_replace(coalesce(text, ''), '[ \n\t\r]+', ' ', 'g')"
    description = r"trim(regexp_replace(regexp_extract(regexp_extract(html, '(?is)<meta[^>]*\bname\s*=\s*[\"\x27]description[\"\x27][^>]*>'), '(?is)\bcontent\s*=\s*[\"\x27]([^\"\x27]*)[\"\x27]', 1), '\s+', ' ', 'g'))".replace('\\"', '"')
    title = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
    router = SHARD.format("regexp_extract(domain, '^https?://([^/:]+)', 1)")
    encoded = "replace(url_encode({0}), '%20', '+')"
    events = "select user_id::varchar as domain, event_type as path, event_id as seq, * from events"
    return {
        "search_header": f"{page(query, 'reference', 0).partition('select doc_id, url, round(rank')[0]} select count(*) as n, 'Showing results for \"{query}\"' as header from met",
        "random_word": f"{from_docs} select min_by(word, sha1('7|' || word)) as word from positions",
        "links_reference": f"with {LINKS}, kept as (select * from anchors where not regexp_matches(tag, '\\blang\\s*=')), numbered as (select page_id, href, (row_number() over (partition by page_id order by pos) - 1)::integer as pos from kept), told as (select n.page_id, pos, case when regexp_matches(href, '^https?://') then substr(href, 1, 7) || {encoded.format('substr(href, 8)')} when starts_with(href, '//') then scheme || ':' || {encoded.format('href')} when starts_with(href, '/') then root || '/' || {encoded.format('href')} else root || regexp_replace(path, '/[^/]*$', '') || '/' || {encoded.format('href')} end as url from numbered n join roots r on n.page_id = r.page_id where not starts_with(href, '#') and not regexp_matches(lower(href), '^(javascript|mailto):')) select * from told",
        "same_domain_next": f"with {URL} select a.page_id, a.scheme = b.scheme and a.host = b.host and a.port = b.port as same from urls a join urls b on b.page_id = a.page_id + 1",
        "page_store": "select page_id::varchar as doc_id, sha256(html) as digest, page_id % 2 <> 0 as new from pages where html <> ''",
        "whole_text_pages": "select page_id::varchar as doc_id, length(html)::integer as n from pages where html <> ''",
        "frequency_files": f"{from_docs}{FREQ} select word, doc_id, printf('%.5f', tf)::double as tf, n::integer as n, positions from freq",
        "snippet_files": f"with s as (select page_id::varchar as doc_id, {description} as d, {title} as title from pages), c as (select doc_id, {cut('d', False)} as description, title from s) select doc_id || ':' || description || chr(9) || title as value from c",
        "posting_files": f"{posted('reference')}, l as (select word, {lines} as line from postings group by word) select word, doc_id, tfidf, positions from postings where word in (select word from l where length(line) <= 4100)",
        "adjacency_files": f"with {EDGES} select src, dst, count(*) as n from edges group by src, dst",
        "rank_files": f"with {pagerank(2, True)} select id, round(rank, 6) as rank from r2",
        "store_batches": "select c_custkey, c_name from customer where c_custkey % 20 = 0",
        "seed_messages": "select url, count(*) as n from pages where url is not null group by url",
        "header_lines": "select event_id, 2 as n, event_type as kind, user_id || ' ' || event_id % 7 || '|b:c' as users from events",
        "fetchable_any": f"with {RESPONSES} select event_id from checked where markup and fits",
        "round_robin": f"with e as ({events}), q as (select domain, path || event_id % 3 as path, max(event_id % 5 = 0) as get, min(seq) as seq from e group by 1, 2) select row_number() over (partition by domain order by get desc, seq, path)::integer as turn, domain, path from q",
        "stream_resume": f"with e as ({events}) select domain, path from e group by all having not max(value > 100)",
        "stream_messages": "select url, count(*) as n from pages where url is not null group by url",
        "stream_round_robin": f"with e as ({events}), q as (select domain, path, min(seq) as seq from e group by 1, 2) select row_number() over (partition by domain order by seq, path)::integer as turn, domain, path from q",
        "token_positions": f"{from_docs} select * from positions",
        "term_freq_lines": f"{from_docs}{FREQ} select word || ':' || doc_id || ':' || printf('%.5f', tf) || ':' || positions as value from freq",
        "parse_tf_lines": f"{from_docs}{FREQ} select word, doc_id, printf('%.5f', tf)::double as tf, n::integer as n, positions from freq",
        "doc_freq_idf": f"{from_docs}{FREQ}{WEIGHTS} select word, df, round(idf, 8) as idf from df",
        "postings_ref": f"{posted('reference')} select word, doc_id, tfidf, positions from postings",
        "postings_textbook": f"{posted('intended')} select word, doc_id, tfidf, positions from postings",
        "posting_lines_pruned": f"{posted('reference')}, l as (select word, {lines} as line from postings group by word) select * from l where length(line) <= 4100",
        "posting_lines_parsed": f"{posted('reference')}, l as (select word, {lines} as line from postings group by word) select word, doc_id, tfidf, positions from postings where word in (select word from l where length(line) <= 4100)",
        "html_text_tokens": f"with {PAGES}{SLOTS} select * from positions",
        "page_snippets": f"with s as (select page_id::varchar as doc_id, {description} as d, {title} as title from pages), c as (select doc_id, {cut('d', False)} as description, title from s) select *, doc_id || ':' || description || chr(9) || title as line from c",
        "description_cut": f"with s as (select doc_id, {text} as t from documents) select doc_id, {cut('t', False)} as intended, {cut('t', True)} as reference from s",
        "query_terms": f"select * from (values {both}) t(semantics, word)",
        "search_tfidf_top500": f"{top500(query, 'reference')} select doc_id, round(tfidf, 5) as tfidf from top",
        "search_ranked_page": page(query, "reference", 0),
        "search_ranked_page_2": page(query, "intended", 10),
        "pagination_links": "with g as (select s.range as start, n from range(0, 40) s, unnest([0, 9, 10, 11, 20, 25, 30, 31]) t(n)) select start, n::bigint as n, case when start < 10 then case when n > 10 then 'F10' else '' end when start - start % 10 + 10 < n then 'B' || (start - start % 10 - 10) || ',F' || (start - start % 10 + 10) else 'B' || (start - start % 10 - 10) end as links from g",
        "blended_scores": "with c as (select c_custkey, c_acctbal / 100 as t, case when c_custkey % 7 = 0 then 1.0::double else c_acctbal / 1000 end as r from customer) select c_custkey, round((t - 21.6::double) / 15 + 0.1::double * case when r = 1 then '-inf'::double when r < 0 then -ln(abs((r - 1) / 1.76884::double)) else ln(abs((r - 1) / 1.76884::double)) end, 6) as score from c",
        "pagerank_ref_10": f"with {pagerank(10, False)} select id, round(rank, 6) as rank from r10",
        "pagerank_damped_10": f"with {pagerank(10, True)} select id, round(rank, 6) as rank from r10",
        "links_extract": f"with {LINKS} select page_id, pos, href from anchors",
        "links_resolved": f"with {LINKS} select page_id, pos, url from joined where url is not null",
        "inlink_counts": f"with {LINKS} select url, count(*) as n from joined where url is not null group by url",
        "page_link_graph": f"with linked as (select p.page_id, p.url, html || coalesce('<a href=\"' || n.url || '\">', '') as html from pages p left join (select page_id - 1 as page_id, url from pages) n on p.page_id = n.page_id), {NEXT} select j.page_id::varchar as src, r.page_id::varchar as dst from joined j join roots r on j.url = r.root || r.path",
        "url_parse": f"with {URL} select page_id, scheme, host, port, path from urls",
        "url_canonical": f"with {URL} select page_id, root || path as url, root || '/' as domain, root || regexp_replace(path, '/[^/]*$', '') || '/x/y' as appended, root || '/z' as replaced from roots",
        "preview_name": "select page_id, split_part(case when contains(url, 'www.') then substr(url, strpos(url, 'www.') + 4) when contains(url, 'http://') then substr(url, strpos(url, 'http://') + 7) when contains(url, 'https://') then substr(url, strpos(url, 'https://') + 8) else url end, '.', 1) as name from pages",
        "url_messages": "select page_id % 50 as m, url from (select distinct page_id % 50 as page_id, url from pages where url is not null)",
        "host_shard": f"with {URL} select page_id, {SHARD.format('host')} as shard from urls",
        "frontier_whitelist": f"with {ENTRIES}, {WHITELIST} select domain, path from entries semi join whitelist using (domain)",
        "frontier_unseen": rf"with {LINKS}, e as (select page_id, regexp_extract(url, '^https?://[^/]+') || '/' as domain, regexp_extract(url, '^https?://[^/]+(.*)$', 1) as path from joined where url is not null) select distinct domain, path from e where (domain, path) not in (select (domain, path) from e where page_id % 2 = 0)",
        "frontier_progress": f"with {ENTRIES} select domain, count(*) filter (length(path) % 2 = 0) as done, count(*) filter (length(path) % 2 <> 0) as pending from entries group by domain",
        "frontier_routed": f"with {ENTRIES} select domain, path, {router} as shard from entries",
        "latest_per_user": "select user_id, max(epoch_us(ts)) as crawldate, max_by(event_id, (epoch_us(ts), event_id)) as fingerprint from events group by user_id",
        "upsert_store": "select user_id, max(epoch_us(ts)) as crawldate, max_by(event_id, (epoch_us(ts), event_id)) as fingerprint from events group by user_id",
        "deposit_new": "select distinct sha256(text) as fingerprint from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)",
        "content_dedup": "select sha256(text) as digest, min(doc_id) as first_id, count(*) as n from documents group by 1",
        "shortest_url": f"with {URL} select host, min_by(url, (length(url), url)) as url from urls group by host",
        "robots_parse": f"with {robots(agent, bodies)} select * from rules",
        "robots_decision": f"with {robots(agent, bodies)}, m as (select e.domain, e.path, coalesce(max(length(value)) filter (directive = 'Disallow'), 0) as no, coalesce(max(length(value)) filter (directive = 'Allow'), 0) as yes from (select distinct domain, path from entries) e left join (select * from own where directive in ('Allow', 'Disallow') and value <> '') o on e.domain = o.domain and starts_with(e.path, o.value) group by all) select domain, path, no = 0 or yes > no as allowed from m",
        "robots_delays": f"with {robots(agent, bodies)} select domain, max_by(value::integer, line_no) * 1000 as delay_ms from own where directive = 'Crawl-delay' group by domain",
        "content_filters": f"with {RESPONSES} select event_id, markup, fits, case status when 200 then 'get' when 304 then 'extract' else 'done' end as action from checked",
        "fetchable": f"with {RESPONSES} select event_id from checked where markup and fits and status = 200",
        "extract_again": f"with {RESPONSES} select r.event_id::varchar as url, e.user_id as fingerprint, c_custkey * 10 as lastparsed from responses r join events e on r.event_id = e.event_id join customer on c_custkey = e.user_id where status = 304 and c_custkey * 10 < 5000",
        "http_dates": "select event_id, strftime(date_trunc('second', ts), '%a, %-d %b %Y %H:%M:%S') as text, case when event_id % 5 < 4 then epoch(date_trunc('second', ts))::bigint else -1 end as parsed from events",
        "fetch_readiness": "select event_id, event_id % 2 > 0 and (event_id % 3 = 0 or event_id % 3 * 1000 < 1500) as ready from events",
        "stream_frontier_dedup": rf"with {LINKS}, {WHITELIST.replace('entries', 'e0')}, x as (select domain, path from e0 union select regexp_extract(url, '^https?://[^/]+') || '/', regexp_extract(url, '^https?://[^/]+(.*)$', 1) from joined where url is not null) select domain, path, {router} as shard from x semi join whitelist using (domain)".replace("with ", "with ", 1).replace(", whitelist as", ", e0 as (select page_id, root || '/' as domain, path from roots), whitelist as", 1),
        "stream_done_state": "select user_id::varchar as domain, event_type as path, max(value > 100) as done from events group by all",
        "stream_crawl_delay": "with e as (select event_id, user_id::varchar as domain, epoch_us(ts) // 1000 as at_ms, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as i from events) select event_id as request_id, domain, at_ms, i * 60000 + max(at_ms - i * 60000) over (partition by domain order by i rows unbounded preceding) as release_ms from e",
    }
