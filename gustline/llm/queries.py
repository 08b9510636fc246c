"""Queries of the training-data operators over whole tables, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm import bpe, chat, decontaminate, exact_dedup, langid, minhash, pii, sharding, toxicity, urls
from gustline.llm.shared import table

SHARDS = 24
SEED = 7


def bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=0.8)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    models = langid.fit(docs.filter(~held_out))
    # the contract asks for a learned language wherever there is a letter: that of the lowest cross-entropy, and whether it is rejected beside it
    return langid.predict(docs, models).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("best").alias("lang_pred"), "score", "entropy", "rejected")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS, SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), bpe_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.chat_digests(turns.unionByName(probe))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return toxicity.predict(docs, scorer).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_minhash, op2_language_id, op3_exact_dedup, op4_sharding, op5_bpe, op6_pii, op7_decontamination, op8_url_filter, op9_chat_format, op10_toxicity)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_minhash": f"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
sig as (select doc_id, n, md5(string_agg(g, chr(10) order by g)) as h from s join n using (doc_id) group by doc_id, n),
rep as (select h, min(doc_id) as id, any_value(n) as n from sig group by h),
rs as (select id, g from s join rep on doc_id = id),
freq as (select g, count(*) as k from rs group by g having count(*) > 1),
pair as (select a.id as a, b.id as b, count(*) as i from rs a join freq using (g) join rs b on a.g = b.g and a.id < b.id group by 1, 2),
e as (select a, b from pair join rep x on x.id = a join rep y on y.id = b where 100 * i >= 80 * (x.n + y.n - i)),
reach as (select id as a, id as b from rep union select r.a, case when e.a = r.b then e.b else e.a end from reach r join e on e.a = r.b or e.b = r.b),
comp as (select a, min(b) as c from reach group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(c.c, d.doc_id) as component_id, coalesce(c.c, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join sig using (doc_id) left join rep using (h) left join comp c on c.a = rep.id""",
    "op3_exact_dedup": f"""
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, {_LOW} as t from documents)""",
    "op7_decontamination": f"""
with d as (select doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
win as (select distinct item, array_to_string(unnest(case when len(w) = 0 then [] else list_transform(range(1, greatest(len(w) - 11, 2)), lambda i: w[i:i + 12]) end), ' ') as g,
        least(len(w), 13) as l from b),
p as (select doc_id, l, unnest(range(1, len(w) - l + 2)) as s, w from d, (select distinct l from win)),
h as (select p.doc_id, p.s, p.l, win.item from p join win on win.l = p.l and array_to_string(p.w[p.s:p.s + p.l - 1], ' ') = win.g),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(s, s + l)) as x from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join i using (doc_id)""",
    "op8_url_filter": r"""
with recursive r(rule, host, path, verdict) as (values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
tag as (select url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) as t, true as canonical from pages where url like '%://%'
  union all select url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')), false from pages where url like '%://%'),
raw as (select url, regexp_replace(case
    when canonical and regexp_matches(t, '(?is)\srel\s*=\s*["'']?\s*([a-z-]+\s+)*canonical\b') then regexp_extract(t, '(?is)\shref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    when not canonical and regexp_matches(t, '(?is)\shttp-equiv\s*=\s*["'']?\s*refresh\b') then regexp_extract(t, '(?is)\scontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    else '' end, '&(amp|#38|#x26);', '&', 'gi') as t from tag),
split as (select url, t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as site, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as page,
  regexp_extract(t, '(?s)^[^?#]*', 0) as path, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) as rest from raw where t <> ''),
whole as (select *, string_split(regexp_replace(case when starts_with(path, '/') then path else (case when page = '' then '/' else regexp_extract(page, '(?s)^(.*/)', 1) end) || path end, '(/\.{1,2})$', '\1/'), '/') as parts from split),
target as (select url as a, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t
    when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || t
    when starts_with(t, '#') or regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
    when starts_with(t, '?') then site || page || t
    else site || list_reduce(list_prepend('', parts[2:]), lambda o, x: case when x = '.' then o when x = '..' then regexp_replace(o, '/[^/]*$', '') else o || '/' || x end) || rest end as b from whole),
known as (select distinct url from (select url from pages union all select a from target union all select b from target) where url like '%://%'),
normal as (select url, translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1) as n from known),
e as (select distinct x.n as a, y.n as b from target join normal x on x.url = a join normal y on y.url = b where x.n <> y.n),
p as (select distinct url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from (select url from pages union all select a from e union all select b from e)),
own as (select p.url, any_value(p.host) as host, any_value(p.path) as path, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from p left join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by p.url),
reach as (select a, a as b from (select a from e union select b from e) union select x.a, case when e.a = x.b then e.b else e.a end from reach x join e on e.a = x.b or e.b = x.b),
carried as (select x.a as n from reach x join own on own.url = x.b group by x.a having bool_or(coalesce(own.verdict, '') = 'block') and not bool_or(coalesce(own.verdict, '') = 'allow'))
select pages.page_id, own.host, own.path, own.rule, coalesce(own.verdict, case when carried.n is not null then 'block' else 'allow' end) as verdict
from pages join own on own.url is not distinct from pages.url left join normal on normal.url = pages.url left join carried on carried.n = normal.n""",
    "op9_chat_format": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select *, 31 + length(role) + length(text) + length(role || text) - length(replace(replace(replace(role || text, chr(92), ''), '<', ''), '[', '')) as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from f group by conv_id""",
}
