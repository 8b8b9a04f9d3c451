"""The operators as queries over a folder of tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismlake.llm.compression import compression_rules
from prismlake.llm.crf import toxicity
from prismlake.llm.fm_index import digested, leaks
from prismlake.llm.hamming import hamming_top_k, sign_codes
from prismlake.llm.importance import resample
from prismlake.llm.jaccard import jaccard_components
from prismlake.llm.lexical import search
from prismlake.llm.mixing import mix
from prismlake.llm.packing import pack
from prismlake.llm.quantiles import money_streams, quantiles
from prismlake.llm.suffix_tree import suffix_tree_scores
from prismlake.llm.templates import extract_pages
from prismlake.llm.urls import judge_urls

#: Rules of the url query: host and path, verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
NEIGHBOURS = 10
QUERY_STEP = 50
RANKED = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "entry string, verdict string"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_top_k(codes, codes.where(f"id % {QUERY_STEP} = 0"), NEIGHBOURS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), RANKED)


def op12_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(money_streams(*[table(spark, sf_dir, name) for name in ("clicks", "sale_lines", "items")]))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_jaccard_join, op3_quality_classifier, op4_lm_scoring, op5_url_filter, op6_html_extraction, op7_quality_rules, op8_topk_search, op9_toxicity, op10_best_fit_packing, op11_lexical_search, op12_quantile_summaries, op13_decontamination)}

ORACLE_SQL = {
    "op1_mixing": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(concat('mix:', coalesce(doc_id::varchar, ''))) as key
  from documents),
placed as (
  select *, sum(size) over (partition by source order by key, doc_id, size rows unbounded preceding) - size as before from sized),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, (((row_number() over (order by source is null, source)) - 1) % 3 + 1)::bigint as weight from totals),
ranked as (
  select *, sum(source_size) over ()::hugeint - coalesce(sum(3 * source_size) over w, 0) as rest,
         sum(weight) over ()::hugeint - coalesce(sum(weight) over w, 0) as rest_weight,
         row_number() over (order by source_size / weight, source is null, source) as nth
  from weighed
  window w as (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding)),
cut as (select *, rest * weight > 3 * source_size::hugeint * rest_weight as capped from ranked),
free as (select rest, rest_weight from cut where not capped order by nth limit 1),
goals as (
  select c.source, c.source_size,
         case when c.capped then (3 * c.source_size)::double else (f.rest * c.weight)::bigint / f.rest_weight::bigint end as target
  from cut c left join free f on true),
taken as (
  select p.*, g.source_size, g.target, floor(g.target)::bigint as budget
  from placed p join goals g on p.source is not distinct from g.source),
epochs as (select *, case when source_size > 0 then budget // source_size else 0 end as whole from taken),
parts as (select *, least(greatest(budget - whole * source_size - before, 0), size)::bigint as remain from epochs)
select doc_id, source, size, source_size, target, (whole * size + remain)::bigint as taken,
       case when size > 0 then whole + (remain = size)::bigint else 0 end::bigint as epochs,
       case when size > 0 and remain = size then 0 else remain end::bigint as part
from parts""",
    "op2_jaccard_join": r"""
with recursive words as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) end as s
  from words),
items as (select doc_id, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
linked as (
  select a, b from shared join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * n >= 90 * (len(p.s) + len(q.s) - n)),
edges as (select a, b from linked union select b, a from linked),
reach(doc_id, root) as (select doc_id, doc_id from sets union select e.b, r.root from reach r join edges e on e.a = r.doc_id)
select s.doc_id, any_value(len(s.s))::bigint as n_shingles, min(r.root) as component_id
from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id""",
    "op5_url_filter": r"""
with parsed as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(h, p, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select page_id, host, path,
       (select concat(h, p) from rules where (host = h or host like concat('%.', h)) and starts_with(path, p) order by length(concat(h, p)) desc limit 1) as rule,
       coalesce((select verdict from rules where (host = h or host like concat('%.', h)) and starts_with(path, p) order by length(concat(h, p)) desc limit 1), 'allow') as verdict
from parsed""",
    "op8_topk_search": r"""
with codes as (select vec_id as id, list_transform(embedding, lambda x: x > 0) as c from embeddings),
met as (
  select q.id as query_id, n.id as neighbor_id, len(list_filter(range(1, 65), lambda i: q.c[i] <> n.c[i]))::integer as distance
  from codes q join codes n on q.id % 50 = 0 and q.id <> n.id)
select query_id, neighbor_id, distance, rank::integer as rank
from (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from met) where rank <= 10""",
    "op11_lexical_search": r"""
with words as (
  select doc_id, row_number() over () as d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
sizes as (select d, doc_id, len(w)::bigint as n from words where len(w) > 0),
corpus as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
asked as (select q, item_id, t, count(*) as r from (select row_number() over () as q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by all),
held as (select d, t, count(*)::bigint as tf from (select d, unnest(w) as t from words) where t in (select t from asked) group by all),
weights as (select t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from (select t, count(*) as df from held group by t), corpus),
scored as (
  select q, item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::bigint as score
  from asked join held using (t) join weights using (t) join sizes using (d), corpus
  group by q, item_id, d, doc_id)
select item_id, rank::integer as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0) where rank <= 20""",
    "op13_decontamination": r"""
with words as (
  select doc_id, row_number() over () as d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
asked as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, case when len(w) < 10 then w else w[i : i + 9] end as x
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from asked where len(w) > 0)),
hashed as (select item_id, len(x) as m, array_to_string(x, ' ') as x from windows),
lengths as (select distinct m from hashed),
places as (select d, m, w, unnest(range(1, len(w) - m + 2)) as i from words, lengths where len(w) >= m),
met as (select p.d, p.i, p.m, h.item_id from places p join hashed h on h.m = p.m and h.x = array_to_string(p.w[p.i : p.i + p.m - 1], ' ')),
hits as (select d, count(distinct j) as n_hit from (select d, unnest(range(i, i + m)) as j from met) group by d),
items as (
  select d, count(*) as n_items, string_agg(item_id, ',' order by item_id) as listed
  from (select distinct d, item_id::varchar as item_id from met where item_id is not null) group by d)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hits using (d) left join items using (d)""",
}
