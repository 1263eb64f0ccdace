"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.llm import bpe, digest_index, fingerprint, near_dup, packing, quality, quotes, secrets, shards, url_lists
from seriata.llm.common import materialize, table

FIRST_DAY = "2024-01-01"


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op3_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleave(table(spark, sf_dir, "documents"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op6_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = digest_index.DigestIndex(spark, digest_index.fresh_name())
    rows = digest_index.add_in_batches(index, digest_index.keyed(table(spark, sf_dir, "documents")))
    out = materialize(rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")), "digest-rows")
    index.drop()
    return out


def op7_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of the pages: by the md5 of a host, it or its parent domain is added to one of the lists on a day of the year, and perhaps removed later."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    part = lambda k: F.conv(F.substring(F.md5("host"), k, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n)
    e = hosts.withColumn("a", part(1)).withColumn("b", part(5)).withColumn("c", part(9))
    pattern = F.when(F.col("a") % 5 == 0, F.regexp_replace("host", r"^[^.]+\.", "")).otherwise(F.col("host"))
    e = e.where("a % 2 = 0").withColumn("pattern", pattern).withColumn("list", F.when(F.col("b") % 3 == 0, "allow").otherwise("block"))
    adds = e.select("list", "pattern", F.lit("add").alias("action"), day(F.col("b") % 300).alias("at"))
    removes = e.where("c % 2 = 0").select("list", "pattern", F.lit("remove").alias("action"), day(F.col("b") % 300 + 1 + F.col("c") % 90).alias("at"))
    return adds.unionByName(removes).distinct()


def op8_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold neither fetch times nor lists: a page is fetched on day page_id % 366, and list_entries gives the lists."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_at"))
    found = url_lists.evaluate(pages, list_entries(pages))
    return found.select("page_id", "url", "host", F.col("fetched_at").cast("string").alias("fetched_on"), "verdict", "rule_list", "rule_pattern", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train_for(docs))
    return found.select("doc_id", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "probability", "secret")


def op10_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), 0.85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_harmonic_packing, op2_bottom_k_fingerprints, op3_quadratic_discriminant, op4_stratified_interleaving, op5_quotation_linking, op6_digest_index, op7_segment_tree_bpe, op8_temporal_url_lists, op9_secret_forest, op10_minhash_components, pipeline)}

_OP6 = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""

_OP8 = r"""
with p as (
  select page_id, url, case when length(x) between 1 and 253 then x end as host, date '2024-01-01' + (page_id % 366)::int as fetched
  from (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) as x from pages)),
h as (select distinct host, ('0x' || substr(md5(host), 1, 4))::int as a, ('0x' || substr(md5(host), 5, 4))::int as b, ('0x' || substr(md5(host), 9, 4))::int as c from p where host is not null),
e as (select *, case when a % 5 = 0 then regexp_replace(host, '^[^.]+\.', '') else host end as pattern, case when b % 3 = 0 then 'allow' else 'block' end as list from h where a % 2 = 0),
entries as (
  select list, pattern, 'add' as action, date '2024-01-01' + (b % 300)::int as eff from e
  union
  select list, pattern, 'remove', date '2024-01-01' + (b % 300 + 1 + c % 90)::int from e where c % 2 = 0),
one as (select list, pattern, eff, max(action) as action from entries group by all),
spans as (select list, pattern, action, eff as valid_from, lead(eff) over (partition by list, pattern order by eff) as valid_to from one),
hits as (
  select p.page_id, p.url, s.*, row_number() over (partition by p.page_id, p.url order by length(s.pattern) desc, s.list) as k
  from p join spans s on (p.host = s.pattern or p.host like '%.' || s.pattern) and s.action = 'add' and p.fetched >= s.valid_from and (s.valid_to is null or p.fetched < s.valid_to))
select p.page_id, p.url, p.host, p.fetched::varchar as fetched_on, case when x.list = 'block' then 'blocked' else 'allowed' end as verdict,
       x.list as rule_list, x.pattern as rule_pattern, x.valid_from::varchar as valid_from, x.valid_to::varchar as valid_to
from p left join hits x on x.page_id = p.page_id and x.url = p.url and x.k = 1
"""

_OP5 = r"""
with recursive m as (select row_number() over () as mid, conv_id, turn, role, coalesce(text, '') as text from conversations),
split as (select mid, conv_id, turn, string_split_regex(text, '\r?\n') as ls from m),
l0 as (select mid, conv_id, turn, unnest(range(len(ls))) as pos, unnest(ls) as line from split),
l1 as (select mid, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^[ \t>]*>'), '[^>]', '', 'g')) as level, regexp_replace(line, '^[ \t>]*>[ \t]?', '') as content from l0),
l2 as (select *, case when level != lag(level) over (partition by mid order by pos) then 1 else 0 end as starts, lead(level) over (partition by mid order by pos) as nl from l1),
l3 as (select *, sum(starts) over (partition by mid order by pos) as passage from l2),
l4 as (select *, trim(regexp_replace(lower(content), '\s+', ' ', 'g'), ' ') as t from l3 where not (level = 0 and coalesce(nl, 0) > 0 and regexp_matches(content, '(?i)^[ \t]*(on|am|le|el)\b.*(wrote|schrieb|a écrit|escribió):[ \t]*$'))),
parts as (select mid, conv_id, turn, passage, level, min(pos) as first, string_agg(content, chr(10) order by pos) as content, coalesce(string_agg(t, ' ' order by pos) filter (t != ''), '') as t, count(*) filter (t != '') as k from l4 group by mid, conv_id, turn, passage, level),
bodies as (select mid, trim(string_agg(content, chr(10) order by passage), ' ') as body from parts where level = 0 group by mid),
said_lines as (select mid, conv_id, turn, list(t order by pos) as ts from l4 where level = 0 and t != '' group by mid, conv_id, turn),
sizes as (select distinct conv_id, k from parts where level > 0 and k > 0),
norm as (
  select conv_id, turn, array_to_string(ts, ' ') as t from said_lines union all
  select conv_id, turn, t from parts where level = 0 union all
  select conv_id, turn, unnest(ts) from said_lines union all
  select conv_id, turn, array_to_string(ts[i + 1 : i + k], ' ') from (select s.conv_id, s.turn, s.ts, z.k, unnest(range(len(s.ts) - z.k + 1)) as i from said_lines s join sizes z on s.conv_id = z.conv_id and z.k <= len(s.ts))),
said as (select conv_id, t, min(turn) as origin from norm where t != '' group by conv_id, t),
q as (
  select p.mid, p.level, p.first, case when s.origin < p.turn then s.origin end as origin
  from parts p left join said s on s.conv_id = p.conv_id and s.t = p.t where p.level > 0),
links as (select mid, count(*) as quoted_passages, count(origin) as linked_passages, max(level) as deepest_quote, arg_min(origin, level * 1000000000 + first) filter (origin is not null) as reply_to from q group by mid),
ups as (select m.conv_id, m.turn, min(l.reply_to) as up from m join links l using (mid) where l.reply_to is not null group by m.conv_id, m.turn),
walk as (
  select conv_id, turn, up as root, 1 as depth from ups
  union all
  select w.conv_id, w.turn, u.up, w.depth + 1 from walk w join ups u on u.conv_id = w.conv_id and u.turn = w.root),
threads as (select conv_id, turn, arg_max(root, depth) as root, max(depth) as depth from walk group by conv_id, turn)
select m.conv_id, m.turn, m.role, coalesce(b.body, '') as body, coalesce(l.quoted_passages, 0)::bigint as quoted_passages, coalesce(l.linked_passages, 0)::bigint as linked_passages,
       coalesce(l.deepest_quote, 0)::bigint as deepest_quote, l.reply_to, coalesce(t.root, m.turn) as thread, coalesce(t.depth, 0)::bigint as depth
from m left join bodies b using (mid) left join links l on l.mid = m.mid left join threads t on t.conv_id = m.conv_id and t.turn = m.turn
"""

ORACLES: dict[str, str] = {"op5_quotation_linking": _OP5, "op6_digest_index": _OP6, "op8_temporal_url_lists": _OP8}
