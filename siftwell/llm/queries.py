"""Registered queries of this subpackage, opN_<name>, and their DuckDB SQL.

Each query applies its operator with production parameters to its whole table and derives
the digest columns of its contract.  Where SQL cannot express an operator there is no
entry in ``oracle_sql``; tests/llm holds those queries against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .jaccard_join import near_classes
from .license_scan import TEMPLATES, bigrams_of, bounds, license_scan
from .line_dedup import line_dedup
from .lm_scoring import score_texts
from .mixing import mix_sources
from .packing import pack
from .topk_search import top_k
from .toxicity import score, train
from .warc import warc_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("per_word", 4).alias("per_word"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def _fold() -> Column:
    """crc32 of the id as text, modulo 5: remainder 0 is held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=_fold() != 0)
    out = score(docs, machine)
    return out.select("doc_id", (_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "worst")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_documents(spark, sf_dir), width=4, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP1 = r"""
with t as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
i as (select r, ws, unnest(range(1, len(ws) + 1)) as k from t),
occ as (select r, case when k > 1 then ws[k - 1] else '' end as v, ws[k] as w from i),
per as (select r, v, w, count(*) as n from occ group by r, v, w),
uni as (select w, sum(n) as c from per group by w union all select '', sum(n) from per where v = ''),
bi as (select v, w, sum(n) as c from per group by v, w),
total as (select sum(n) as c from per),
scored as (
  select per.r, per.n * case when bi.c >= 2 then ln(bi.c::double) - ln(a.c::double) else ln(0.4::double) + ln(b.c::double) - ln((select c from total)::double) end as s
  from per join bi on per.v = bi.v and per.w = bi.w join uni a on a.w = per.v join uni b on b.w = per.w),
sums as (select r, sum(s) as s from scored group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(round(s, 4), 0.0::double) as score, coalesce(round(s / len(ws), 4), 0.0::double) as per_word from t left join sums using (r)
"""

_OP2 = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
often as (
  select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
  select k.*, o.key is not null and k.doc_id <> o.last as lost from keyed k left join often o on k.key = o.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from marked group by doc_id
"""

_OP3 = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
src as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as i from sized group by source),
w as (
  select *, case (i - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight, 2.0::double * source_size as most from src),
lev as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level from w),
unit as (select level as u from lev where most / weight > level order by most / weight, level limit 1),
tgt as (
  select source, source_size, case when (select u from unit) is null then most else least(most, (select u from unit) * weight) end as target from lev),
blk as (
  select *, coalesce(greatest(1, least(256, floor(min(target) filter (target >= 1) over () / 64))), 1)::bigint as block from tgt),
seats as (select *, round(sum(target) over () / block)::bigint as blocks from blk),
tried as (
  select source, blocks, target / (2 * k + 1) as q, k from seats, range(0, (select max(blocks) from seats)) r(k) where target > 0 and k <= target / block * 1.2 + 8),
won as (
  select source, count(*) as quota from (select *, row_number() over (order by q desc, source nulls last, k) as r from tried) where r <= blocks group by source),
sources as (
  select s.source, source_size, target, block, coalesce(quota, 0) as source_quota, least(4096, greatest(1, ceil(source_size / 65536.0)))::bigint as n_shards
  from seats s left join won on s.source is not distinct from won.source),
placed as (
  select d.doc_id, d.size, s.*, ('0x' || substr(md5(concat_ws('|', 'mix-shard', coalesce(d.doc_id::varchar, ''))), 1, 15))::bigint % n_shards as shard
  from sized d join sources s on d.source is not distinct from s.source),
shards as (
  select source, shard, sum(size)::bigint as shard_size, any_value(source_quota) as source_quota, any_value(block) as block, sum(sum(size)) over (partition by source) as votes from placed group by source, shard),
tried2 as (
  select source, shard, source_quota, shard_size / (2 * k + 1) as q, k from shards, range(0, (select max(source_quota) + 1 from sources)) r(k)
  where shard_size > 0 and k <= 1.2 * source_quota * shard_size / votes + 8),
won2 as (
  select source, shard, count(*) as quota from (select *, row_number() over (partition by source order by q desc, shard nulls last, k) as r from tried2) where r <= source_quota group by source, shard),
rings as (
  select p.*, t.shard_size, coalesce(w.quota, 0) as quota, sum(p.size) over (partition by p.source, p.shard order by ('0x' || substr(md5(concat_ws('|', 'mix-order', coalesce(p.doc_id::varchar, ''))), 1, 15))::bigint, p.doc_id, p.size rows unbounded preceding)::bigint as stop
  from placed p join shards t on p.source is not distinct from t.source and p.shard = t.shard left join won2 w on p.source is not distinct from w.source and p.shard = w.shard),
arcs as (
  select *, least(quota * block, 2 * shard_size) as take, greatest(shard_size, 1) as span,
    (('0x' || substr(md5(concat_ws('|', 'mix-start', coalesce(source, ''), shard::varchar)), 1, 15))::bigint % greatest(1, ceil(shard_size::double / block))::bigint) * block % greatest(shard_size, 1) as start from rings),
ends as (select *, take // span as turns, start + take % span as arc_end from arcs)
select doc_id, size, source_size, target,
  (turns * size + greatest(0, least(stop, least(arc_end, span)) - greatest(stop - size, start)) + greatest(0, least(stop, arc_end - span) - greatest(stop - size, 0)))::bigint as taken
from ends
"""


def _op6() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for place, (name, text) in enumerate(TEMPLATES.items()):
        grams = bigrams_of(text)
        low, high = bounds(len(grams), 0.8)
        rows.append(f"({place}, {quote(name)}, {low}, {high}, [{', '.join(map(quote, grams))}])")
    return rf"""
with templates(place, name, low, high, own) as (values {", ".join(rows)}),
docs as (select row_number() over () as row_id, doc_id, coalesce(text, '') as t from documents),
units as (
  select distinct row_id, u from (
    select row_id, t as u from docs
    union all select row_id, unnest(regexp_split_to_array(t, '\n\s*\n')) from docs
    union all select row_id, unnest(string_split(t, chr(10))) from docs
    union all select row_id, unnest(regexp_split_to_array(t, '[.!?]\s+|\n')) from docs)),
words as (
  select row_id, u, string_split(trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') as w from units),
grams as (
  select row_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from words where len(w) >= 2),
scored as (
  select row_id, u, place, name, 2.0::double * len(list_intersect(g, own)) / (len(g) + len(own)) as dice
  from grams join templates on len(g) between low and high),
hits as (select * from scored where dice >= 0.8 - 1e-12),
best as (select row_id, arg_min(name, (-dice, place)) as license, max(dice) as dice, count(distinct u) as n_matches from hits group by row_id)
select doc_id, license, coalesce(round(best.dice, 6), 0.0::double) as dice, coalesce(n_matches, 0)::bigint as n_matches
from docs left join best using (row_id)
"""


_OP9 = """
with norm as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
grouped as (select t, max(doc_id) as keep_id, count(*)::bigint as group_size from norm group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm.t) as text_sha256
from norm join grouped on norm.t = grouped.t
"""


_OP5 = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x::double)))),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_lm_scoring, op2_line_dedup, op3_mix_sources, op4_toxicity, op5_topk_search, op6_license_scan, op7_ngram_jaccard_join, op8_packing, op9_exact_dedup, op10_warc]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": _OP1, "op2_line_dedup": _OP2, "op3_mix_sources": _OP3, "op5_topk_search": _OP5, "op6_license_scan": _op6(), "op9_exact_dedup": _OP9}
