"""The text operators' queries with production parameters, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import chat, curriculum, divergence, editprint, htmltext, langid, packing, quality, repair, simhash, toxicity, urltree, warc
from eventloom.llm.common import checkpoint, read, ship, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    left_out = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs, langid.learn(docs.where(~left_out)))
    return found.select("doc_id", left_out.alias("held_out"), "lang_pred", "score", "n_langs")


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


ORACLES["op3_warc_zip"] = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest,
       case when first_id is null or first_id is not distinct from page_id then 'response' else 'revisit' end as record_type,
       case when first_id <> page_id then first_id end as refers_to
from p left join firsts using (payload_digest)
"""


@query
def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.with_classes(written(editprint.edited_fingerprints(read(spark, sf_dir, "documents")), "prints"))


@query
def op5_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(read(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0)).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first)


ORACLES["op5_curriculum_mixing"] = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h from documents),
ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) asc nulls last) - 1 as rank
  from sized group by source),
weighted as (
  select *, [5.0::double, 2.0::double, 1.0::double][(rank % 3 + 1)::int] as weight,
         [0.5::double, 0.0::double, -0.5::double][(rank % 3 + 1)::int] as tilt, 2.0::double * source_size as bound from ranked),
levels as (
  select *, bound / weight as ratio,
         (1.5::double * sum(source_size) over ()
          - coalesce(sum(bound) over (order by bound / weight, rank rows between unbounded preceding and 1 preceding), 0.0))
         / sum(weight) over (order by bound / weight, rank rows between current row and unbounded following) as level from weighted),
targets as (
  select *, least(bound, coalesce((select l.level from levels l where l.ratio >= l.level order by l.ratio, l.rank limit 1) * weight, bound)) as target
  from levels),
summed as (
  select *, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized),
rooms as (
  select s.doc_id, s.size, t.source_size, t.target, t.tilt, s.before,
         greatest(0, least(s.size, floor(t.target + 0.5)::bigint - s.before)) as first_words,
         greatest(0, least(s.size, floor(t.target + 0.5)::bigint - s.before - t.source_size)) as second_words
  from summed s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, (first_words + second_words)::bigint as taken,
       case when first_words > 0 then least(1.0::double,
         case when tilt = 0 then before::double / target
              else (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (before::double / target))) / (2 * tilt) end) end as first_position
from rooms
"""


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    #: A conversation whose texts hold the template's own marks.
    hard = [(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(hard, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_records(chat.conversation_records(turns)))


ORACLES["op6_chat_format"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') as body,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:') as head from t)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(4 + length(head) + 2 + length(body) + 8)::bigint as formatted_chars
from e group by conv_id
"""


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(read(spark, sf_dir, "pages"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpoint(quality.text_statistics(read(spark, sf_dir, "documents")))
    rules = quality.learn_verdict(stats, read(spark, sf_dir, "labels"))
    failed = quality.base_failed()
    return stats.select("doc_id", *quality.STATS, failed.alias("base_failed"), (~failed & quality.verdict(rules)).alias("kept"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(conversations), conversations)


ORACLES["op11_conversation_repair"] = r"""
with recursive
crc_table as (select list(v order by i) as tab from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(i))),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes from conversations),
coded as (
  select conv_id, turn, role, text,
         xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as what from keyed, crc_table),
damaged as (
  select conv_id, turn, case when what = 4 then 'user' else role end as role,
         case when what = 1 then '' when what = 2 then translate(text, '.!?', '') else text end as text, unnest(case when what = 3 then [0, 1] else [0] end) as copy
  from coded where what <> 0),
placed as materialized (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
faulty as materialized (
  select *, substr(role, 1, 1) as initial,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault from placed),
ids as materialized (select distinct conv_id from conversations),
runs(s, run, t, price, said_user) as (values ('', '', '', 0, ''), ('', 'I', 'u', 5, 'u'), ('', 'II', 'a', 10, 'ua'), ('s', '', 's', 0, ''), ('s', 'I', 'u', 5, 'u'), ('s', 'II', 'a', 10, 'ua'),
  ('u', '', 'u', 0, ''), ('u', 'I', 'a', 5, 'a'), ('u', 'II', 'u', 10, 'au'), ('a', '', 'a', 0, ''), ('a', 'I', 'u', 5, 'u'), ('a', 'II', 'a', 10, 'ua')),
edits(edit) as (values ('D'), ('K'), ('R')),
inserted as materialized (select s, run, t, price, list_transform(string_split(said_user, ''), lambda x: case x when 'u' then 'user:' when 'a' then 'assistant:' end) as said, said_user <> '' as any_said from runs),
walk(conv_id, i, s, cost, audit, said) as (
  select conv_id, 0::bigint, '', 0::bigint, '', []::varchar[] from ids
  union all
  select conv_id, i, s, cost, audit, said from (
    select w.conv_id, f.i, case edit when 'D' then r.t when 'K' then f.initial else case when r.t = 'u' then 'a' else 'u' end end as s,
           w.cost + r.price + case edit when 'D' then 2 else case edit when 'R' then 1 else 0 end + case when fault = 'truncated' then 5 else 0 end end as cost,
           w.audit || r.run || edit as audit,
           list_concat(w.said, case when any_said then r.said else []::varchar[] end,
             case edit when 'D' then []::varchar[] when 'K' then [f.role || ':' || f.text] else [case when r.t = 'u' then 'assistant:' else 'user:' end || f.text] end) as said
    from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 join inserted r on r.s = w.s cross join edits
    where edit = 'D' or (fault not in ('blank', 'duplicate') and (edit = 'R' or (f.initial <> '' and r.t || f.initial in ('s', 'u', 'su', 'ua', 'au'))))
    qualify row_number() over (partition by w.conv_id, case edit when 'D' then r.t when 'K' then f.initial else case when r.t = 'u' then 'a' else 'u' end end
      order by w.cost + r.price + case edit when 'D' then 2 else case edit when 'R' then 1 else 0 end + case when fault = 'truncated' then 5 else 0 end end, w.audit || r.run || edit) = 1)),
lengths as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
                   count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated from faulty group by conv_id),
illegal as (select a.conv_id, count(*) as illegal from faulty a join faulty b on a.conv_id is not distinct from b.conv_id and b.i = a.i + 1 where a.initial || b.initial not in ('su', 'ua', 'au') group by a.conv_id),
ends as (
  select w.conv_id, w.cost + r.price as cost, w.audit || r.run as audit, list_concat(w.said, case when any_said then r.said else []::varchar[] end) as said
  from walk w left join lengths l on l.conv_id is not distinct from w.conv_id join inserted r on r.s = w.s
  where w.i = coalesce(l.n, 0) and r.t in ('', 'a')
  qualify row_number() over (partition by w.conv_id order by w.cost + r.price, w.audit || r.run) = 1)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, cost::bigint as cost, audit, sha256(array_to_string(said, chr(10))) as repaired_sha256
from ends e left join lengths l on l.conv_id is not distinct from e.conv_id left join illegal g on g.conv_id is not distinct from e.conv_id
"""


@query
def op12_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(read(spark, sf_dir, "pages"))


ORACLES["op12_url_templates"] = urltree.judge_sql()


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
with d as (select row_number() over () as i, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*)::bigint as n from t group by lang, term having count(distinct i) >= 30),
langs as (select d.lang, coalesce(any_value(k.v), 0)::bigint as v, coalesce(any_value(k.n), 0)::bigint as n
          from (select distinct lang from d) d left join (select lang, count(*) as v, sum(n) as n from kept group by lang) k using (lang) group by d.lang),
counts as (select t.lang, t.source, t.term, count(*)::bigint as n from t join kept using (lang, term) group by all),
groups as (select d.lang, d.source, coalesce(any_value(c.n), 0)::bigint as n from (select distinct lang, source from d) d
           left join (select lang, source, sum(n) as n from counts group by all) c using (lang, source) group by d.lang, d.source),
dense as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                 (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v))::bigint as p,
                 (1 + (1000000000::hugeint * (k.n + 5)) // (l.n + 5 * l.v))::bigint as q
          from groups g join langs l using (lang) join kept k using (lang) left join counts c using (lang, source, term)),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from dense a join dense b using (lang, term) where a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from dense where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from (from pairs union all from terms))
select * from ranked where part = 'pair' or rank <= 50
"""
