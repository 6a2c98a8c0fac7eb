"""One registered query per operator: the operator over its whole table, reduced to the stated columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


TOP_K_SQL = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: floor(256 * x::double)::bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id
),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


@query("op7_exact_top_k", TOP_K_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"), folds=4, fold=2)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, fold=0)


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, fold=0, threshold=0.3)


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import link

    return link(table(spark, sf_dir, "documents"))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = r"""
with dw as (
  select doc_id, xs, row_number() over () as r from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as xs from documents)
),
iw as (
  select item_id::varchar as item_id, xs, least(len(xs), 10) as n from (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as xs from benchmark) where len(xs) > 0
),
grams as (
  select distinct item_id, n, array_to_string(xs[i : i + n - 1], ' ') as g
  from iw, lateral (select unnest(generate_series(1, len(xs) - n + 1)) as i)
),
places as (
  select r, n, i, array_to_string(xs[i : i + n - 1], ' ') as g
  from dw, (select distinct n from grams) s, lateral (select unnest(generate_series(1, len(xs) - n + 1)) as i)
),
found as (select p.r, p.n, p.i, item_id from places p join grams using (n, g)),
covered as (
  select r, count(distinct j) as n_hit from (select distinct r, n, i from found), lateral (select unnest(generate_series(i, i + n - 1)) as j)
  group by r
),
listed as (
  select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from found group by r
)
select doc_id, len(xs)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (r) left join listed using (r)
"""


@query("op2_benchmark_decontamination", DECONTAMINATION_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import scan

    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("body")


@query("op6_mixing_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as xs from documents
),
t as (select lang, source, r, unnest(xs) as term from d),
k as (select lang, term from t group by lang, term having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v from k group by lang),
g as (
  select g.lang, g.source, coalesce(s.n, 0)::hugeint as n, coalesce(v.v, 0)::hugeint as v
  from (select distinct lang, source from d) g
  left join (select lang, source, sum(n) as n from c group by lang, source) s using (lang, source) left join v using (lang)
),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) as p
  from g join k using (lang) left join c using (lang, source, term)
),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(c.n) + 5)) // (any_value(s.n) + 5 * any_value(s.v)) as q
  from c join (select lang, sum(n) as n, any_value(v) as v from g group by lang) s using (lang) group by lang, term
),
apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
),
listed as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source
  union all
  select p.lang, p.source, 'term', p.term, (p.p - q.q)::bigint from p join q using (lang, term) where p.n > 0 and p.p > q.q
),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from listed
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


@query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


REPAIR_SQL = r"""
with recursive
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hashed as (
  select *, xor(list_reduce([4294967295::bigint] || list_transform(string_split(k, ''), lambda x: ascii(x)::bigint),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda d, z: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end)), 4294967295) % 20 as kind from given
),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when kind = 3 then [1, 2] else [1] end) as copy
  from hashed where kind <> 0
),
ids as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
msg as (
  select c, turn, role, text, row_number() over (partition by c order by turn nulls first, encode(role), encode(text)) as pos,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from hurt join ids on ids.conv_id is not distinct from hurt.conv_id
),
faults as (
  select *, case when bare = '' then 'b' when row_number() over (partition by c, role, text order by pos) > 1 then 'd'
                 when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault,
         substr(role, 1, 1) as initial, lag(substr(role, 1, 1)) over (partition by c order by pos) as previous
  from msg
),
facts as (
  select c, max(pos) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
         count(*) filter (previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal
  from faults group by c
),
-- cheapest costs from (messages consumed, state) on; states: nothing, s, u, a
costs as (
  select c, n as i, 0::bigint as v0, 6::bigint as v1, 3::bigint as v2, 0::bigint as v3 from facts
  union all
  select c, pos - 1, least(d0, 3 + d2, 6 + d3), least(d1, 3 + d2, 6 + d3), least(d2, 3 + d3), least(d3, 3 + d2) from (
    select costs.c, pos,
           least(4 + v0, case when live and initial = 's' then x + v1 when live and initial = 'u' then x + v2 end, case when live then 3 + x + v2 end) as d0,
           least(4 + v1, case when live and initial = 'u' then x + v2 end, case when live then 3 + x + v2 end) as d1,
           least(4 + v2, case when live and initial = 'a' then x + v3 end, case when live then 3 + x + v3 end) as d2,
           least(4 + v3, case when live and initial = 'u' then x + v2 end, case when live then 3 + x + v2 end) as d3
    from costs join (select *, fault not in ('b', 'd') as live, case when fault = 't' then 3 else 0 end as x from faults) f
      on f.c = costs.c and f.pos = costs.i)
),
plan as (
  select costs.c, costs.i, [costs.v0, costs.v1, costs.v2, costs.v3] as v, [b.v0, b.v1, b.v2, b.v3] as w, initial, role, text,
         fault not in ('b', 'd') as live, case when fault = 't' then 3 else 0 end as x
  from costs left join costs b on b.c = costs.c and b.i = costs.i + 1 left join faults on faults.c = costs.c and pos = costs.i + 1
),
steps as (
  select c, 0 as i, 1 as q, '' as audit, []::varchar[] as done from facts
  union all
  select c, case when e = 'I' then i else i + 1 end,
         case e when 'D' then q when 'K' then k else nq end, audit || e,
         case e when 'D' then done when 'K' then done || [role || ':' || text]
                else done || [case when nq = 3 then 'user:' else 'assistant:' end || case when e = 'R' then text else '' end] end
  from (
    select s.c, s.i, s.q, s.audit, s.done, p.role, p.text, nq, k,
           case when w[1] is not null and v[s.q] = 4 + w[s.q] then 'D' when v[s.q] = 3 + v[nq] then 'I'
                when live and k is not null and v[s.q] = x + w[k] then 'K' when live and v[s.q] = 3 + x + w[nq] then 'R' end as e
    from steps s join (select *, unnest([1, 2, 3, 4]) as q, unnest([3, 3, 4, 3]) as nq from plan) p0 on p0.c = s.c and p0.i = s.i and p0.q = s.q
    join (select c, i, role, text, unnest([1, 2, 3, 4]) as q,
                 unnest([case initial when 's' then 2 when 'u' then 3 end, case initial when 'u' then 3 end,
                         case initial when 'a' then 4 end, case initial when 'u' then 3 end]) as k from plan) p
      on p.c = s.c and p.i = s.i and p.q = s.q
    where not (w[1] is null and s.q in (1, 4)))
),
ended as (
  select c, audit, done from steps join facts using (c) where i = n and q in (1, 4)
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(v0, 0)::bigint as cost,
       coalesce(audit, '') as audit, sha256(coalesce(array_to_string(done, chr(10)), '')) as repaired_sha256
from ids left join facts using (c) left join ended using (c) left join costs on costs.c = ids.c and costs.i = 0
"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import audit

    return audit(table(spark, sf_dir, "conversations"))
