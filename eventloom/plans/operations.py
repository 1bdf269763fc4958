"""Queries of drill-downs, catalogs, identity, ingest, ad-hoc analyses and relational algebra with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.functions.filters import Filter
from eventloom.functions.values import half_up
from eventloom.operators import adhoc as A
from eventloom.operators import cohorts as C
from eventloom.operators import drilldown as D
from eventloom.operators import ingest as I
from eventloom.operators import trend as T
from eventloom.plans.behaviour import _E, _chain, FUNNEL, HOUR, UNORDERED, _COVER
from eventloom.plans.insights import _RECUR, _life_sql, _retention_sql, DAYS, FROM, IN, LIFE, TO, VIEW
from eventloom.plans.registry import ORACLES, query
from eventloom.plans import fixtures as M
from eventloom.sources import files, model


# Drill-downs
@query(_chain(_E, 6 * HOUR) + " select person_id from lv where max_step >= 2")
def persons_at_funnel_step(spark, sf):
    return D.at_funnel_step(M.events(spark, sf), FUNNEL, 2)


@query(_COVER + " select person_id from lv where max_step >= 3")
def persons_at_unordered_step(spark, sf):
    return D.at_funnel_step(M.events(spark, sf), UNORDERED, 3)


@query(f"select distinct person_id from ev where event_name = 'view' and {IN} and cast(ts as date) = date '2024-01-10'")
def persons_at_trend_bucket(spark, sf):
    return D.at_trend_bucket(M.events(spark, sf), T.TrendSpec((VIEW,), FROM, TO), 0, "2024-01-10")


@query(f"select person_id from ev where event_name = 'purchase' and {IN} group by 1 having count(distinct cast(ts as date)) = 5")
def persons_at_stickiness_bar(spark, sf):
    return D.at_stickiness_bar(M.events(spark, sf), LIFE, 5)


@query(_life_sql("day", "2024-01-04", FROM, TO) + " select distinct person_id from st where b = date '2024-01-12' and status = 'resurrecting'")
def persons_at_lifecycle(spark, sf):
    return D.at_lifecycle_bucket(M.events(spark, sf), LIFE, "2024-01-12", "resurrecting")


@query(_retention_sql("day", _RECUR.format(u="day", a="2024-01-08", b="2024-01-16"), "2024-01-22", 6) + " select distinct c.person_id from c join r using (person_id) where c.b = date '2024-01-09' and date_diff('day', c.b, r.b) = 2")
def persons_at_retention_cell(spark, sf):
    return D.at_retention_cell(M.events(spark, sf), DAYS, "2024-01-09", 2)


@query(
    """, p as (select person_id, max_by(segment, (ts, event_id)) as segment from ev group by 1), i as (select person_id, string_agg(distinct distinct_id, ',' order by distinct_id) as ids from ev group by 1)
select person_id, segment, ids from p join i using (person_id) where segment = 's1' and person_id in (select person_id from ev where contains(distinct_id, '1'))"""
)
def person_list(spark, sf):
    rows = D.person_list(M.persons(spark, sf), M.distinct_ids(spark, sf), (Filter("properties.segment", "eq", "s1"),), "1")
    return rows.select("person_id", F.get_json_object("properties", "$.segment").alias("segment"), F.array_join("distinct_ids", ",").alias("ids"))


@query("select event_id, event_name from ev where person_id = '11' or raw_person_id = '11'")
def person_events(spark, sf):
    return D.person_events(M.raw_events(spark, sf), model.latest_overrides(M.overrides(spark, sf)), "11").select("event_id", "event_name")


@query("select event_id, event_name from ev where person_id = '11' or raw_person_id = '11' order by ts desc, event_id desc limit 10 offset 3")
def person_events_newest(spark, sf):
    return D.person_events(M.raw_events(spark, sf), model.latest_overrides(M.overrides(spark, sf)), "11", 10, 3).select("event_id", "event_name")


@query("--bare select distinct c as cohort_id from (select case when user_id % 4 = 0 then 'c_static' end as c from events where user_id = 8 union select case when user_id % 7 < 3 then 'c_dynamic' end from events where user_id = 8) where c is not null")
def person_cohorts(spark, sf):
    return D.person_cohorts("8", M.static_members(spark, sf), M.materialized_members(spark, sf))


@query("select unnest(json_keys(properties)) as property_name, count(*) as n from pe group by 1")
def property_names(spark, sf):
    return D.property_names(M.events(spark, sf), "properties")


@query("select plan as value, count(*) as n from pe where plan <> '' group by 1 order by 2 desc, 1 limit 50")
def event_property_values(spark, sf):
    return D.property_values(M.events(spark, sf), "properties.plan")


@query("select segment as value, count(*) as n from (select person_id, max_by(segment, (ts, event_id)) as segment from ev group by 1) group by 1 order by 2 desc, 1 limit 50")
def person_property_values(spark, sf):
    return D.property_values(M.persons(spark, sf), "properties.segment")


@query("select event_id, event_name, person_id from pe where ts >= timestamp '2024-01-20' and ts <= timestamp '2024-01-20 23:59:59' and k > 10 order by ts desc, event_id desc limit 50")
def event_list_topn(spark, sf):
    return D.event_list(M.events(spark, sf), (Filter("properties.k", "gt", "10"),), "2024-01-20", "2024-01-20").select("event_id", "event_name", "person_id")


@query("select event_id, event_name from ev where event_id = 5 and ts between timestamp '2024-01-01 00:10:00' and timestamp '2024-01-01 00:20:00'")
def event_detail(spark, sf):
    return D.event_detail(M.events(spark, sf), 5, "2024-01-01 00:15:00").select("event_id", "event_name")


_PEOPLE = """, p as (select person_id, max_by(segment, (ts, event_id)) as segment, max(ts) as updated_at from ev group by 1), i as (select person_id, string_agg(distinct distinct_id, ',' order by distinct_id) as ids from ev group by 1)"""


def _shown(rows, *more):
    return rows.select("person_id", F.get_json_object("properties", "$.segment").alias("segment"), F.array_join("distinct_ids", ",").alias("ids"), *more)


@query(_PEOPLE + " select person_id, segment, ids from p join i using (person_id) where person_id = '11'")
def person_by_id(spark, sf):
    return _shown(D.person_by_id(M.persons(spark, sf), M.distinct_ids(spark, sf), "11"))


@query(_PEOPLE + " select person_id, segment, ids, case person_id when '42' then 0 when '11' then 1 else 3 end as place from p join i using (person_id) where person_id in ('42', '11', '7')")
def persons_by_ids(spark, sf):
    return _shown(D.persons_by_ids(M.persons(spark, sf), M.distinct_ids(spark, sf), ["42", "11", "nobody", "7", "11"]), "place")


@query(_PEOPLE + " select person_id, segment, ids, (select count(*) from p where segment = 's1') as total from p join i using (person_id) where segment = 's1' order by updated_at desc, person_id limit 10 offset 5")
def person_page(spark, sf):
    return _shown(D.person_page(M.persons(spark, sf), M.distinct_ids(spark, sf), (Filter("properties.segment", "eq", "s1"),), limit=10, offset=5), "total")


def _known(spark, sf):
    """Definitions as a catalog has them: those of three events, edited before."""
    rows = D.event_definitions(M.events(spark, sf)).where("event_name in ('view', 'click', 'signup')")
    return rows.select("event_name", F.lit("2024-01-05 00:00:00").alias("last_seen"), F.when(F.col("event_name") == "view", "seen").alias("description"), F.lit(True).alias("verified"))


_KNOWN = ", kn as (select distinct event_name, '2024-01-05 00:00:00' as last_seen, case when event_name = 'view' then 'seen' end as description, true as verified from ev where event_name in ('view', 'click', 'signup'))"


@query(_KNOWN + " select event_name, description, (select count(*) from kn where contains(event_name, 'i')) as total from kn where contains(event_name, 'i') order by event_name desc limit 2")
def definition_list(spark, sf):
    return D.definition_list(_known(spark, sf), "I", order="event_name", limit=2).select("event_name", "description", "total")


@query("--bare select * from (values ('view', 'seen', false), ('click', 'pressed', true), ('signup', null, true), ('new', 'not yet', false)) t(event_name, description, verified)")
def definition_upsert(spark, sf):
    changes = spark.createDataFrame([("view", None, False), ("click", "pressed", None), ("new", "not yet", None)], "event_name string, description string, verified boolean")
    return D.upsert_definitions(_known(spark, sf), changes, ["event_name"]).select("event_name", "description", "verified")


@query(_KNOWN + " select event_name from kn where event_name <> 'click'")
def definition_delete(spark, sf):
    return D.delete_definitions(_known(spark, sf), spark.createDataFrame([("click",), ("unknown",)], "event_name string"), ["event_name"]).select("event_name")


@query(_KNOWN + ", sn as (select event_name, strftime(date_trunc('hour', max(ts)), '%Y-%m-%d %H:%M:%S') as last_seen from ev group by 1) select event_name, greatest(kn.last_seen, sn.last_seen) as last_seen, description, verified from kn full join sn using (event_name)")
def catalog_merge(spark, sf):
    return D.merged_catalog(_known(spark, sf), D.event_definitions(M.events(spark, sf)).drop("n_events"), ["event_name"])


#: Names and JSON values whose types are asked for.
_NAMED = ("load_time", "features_used", "utm_source", "created_at", "$feature/x", "plan", "$survey_response_1", "birthdate", "$feature_flag_response")
_VALUES = ("3.2", '"2024-01-15"', '"15/01/2024 10:00:00"', "true", '"TRUE"', '" 12 "', '"x"', '{"a": 1}', "null", "1706000000", "1306000000", '""', '"1e5"', '"2024-01-15 noon"')


@query(
    f"""--bare with n as (select unnest([{", ".join(repr(x) for x in _NAMED)}]) as name), v as (select unnest([{", ".join("'" + x + "'" for x in _VALUES)}]) as value),
x as (select name, value, json_type(value) as kind, json_extract_string(value, '$') as s from n cross join v),
y as (select *, kind in ('UBIGINT', 'BIGINT', 'DOUBLE') as numeric, kind = 'VARCHAR' and (regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]') or regexp_matches(trim(s), '^([0-9]{{4}}[/-][0-2][0-9][/-][0-3][0-9]|[0-2][0-9][/-][0-3][0-9][/-][0-9]{{4}})([ T][0-2][0-9]:[0-6][0-9]:[0-6][0-9].*)?$')) as dated from x)
select name, value, case when name similar to 'utm_.*|[$]feature/.*|[$]feature_flag_response|[$]survey_response.*' then 'String' when kind in ('OBJECT', 'NULL') then null
  when name similar to '.*(time|date|_at).*' and (dated or numeric and cast(s as double) between 1706745600 - 15768000 and 1706745600 + 315360000) then 'DateTime'
  when kind = 'BOOLEAN' then 'Boolean' when numeric then 'Numeric' when trim(s) in ('true', 'TRUE', 'false', 'FALSE') then 'Boolean' when dated then 'DateTime' when try_cast(trim(s) as double) is not null then 'Numeric' else 'String' end as value_type from y"""
)
def value_type_inference(spark, sf):
    rows = spark.createDataFrame([(n, v) for n in _NAMED for v in _VALUES], "name string, value string").withColumn("v", F.parse_json("value"))
    kind = D.value_type(F.col("name"), F.try_variant_get("v", "$", "string"), F.schema_of_variant("v"), datetime(2024, 2, 1))
    return rows.select("name", "value", kind.alias("value_type"))


@query("select event_name, count(*) as n_events, strftime(date_trunc('hour', max(ts)), '%Y-%m-%d %H:%M:%S') as last_seen from ev group by 1")
def event_definitions(spark, sf):
    return D.event_definitions(M.events(spark, sf))


@query(
    """, q as (select event_name, ts, event_id, properties, unnest(json_keys(properties)) as property_name from pe)
select event_name, property_name, case property_name when 'k' then 'Numeric' when 'ok' then 'Boolean' when 'seen' then 'DateTime' else min_by(case when regexp_matches(x, '^[0-9.]+$') then 'Numeric' else 'String' end, (ts, event_id)) end as value_type,
strftime(date_trunc('hour', max(ts)), '%Y-%m-%d %H:%M:%S') as last_seen from (select *, json_extract_string(properties, '$.' || property_name) as x from q) group by 1, 2"""
)
def property_definitions(spark, sf):
    return D.property_definitions(M.events(spark, sf))


# Identity and ingest
@query("select event_id, person_id, raw_person_id from ev")
def resolve_person(spark, sf):
    return M.events(spark, sf).select("event_id", "person_id", "raw_person_id")


@query("select user_id, event_name, event_id, value from (select *, row_number() over (partition by user_id, event_name order by ts desc, event_id desc) as n from ev) where n = 1")
def dedup_events_latest(spark, sf):
    rows = M.raw_events(spark, sf).select("user_id", "event_name", F.struct("ts", "event_id").alias("version"), "event_id", "value")
    return model.dedup_latest(rows, ["user_id", "event_name"], "version").select("user_id", "event_name", "event_id", "value")


@query(
    """--bare with c as (select cast(user_id as varchar) as person_id, case event_id % 3 when 0 then 'plan' when 1 then 'city' else 'step' end as name, cast(event_id as varchar) as value,
case when event_type in ('view', 'click') then 'set' when event_type = 'signup' then 'unset' else 'set_once' end as kind, (epoch_us(ts) // 1000) as ms, event_id from events),
l as (select person_id, name, max_by(kind, (ms, event_id)) filter (where kind <> 'set_once') as k, max_by(value, (ms, event_id)) filter (where kind <> 'set_once') as v, min_by(value, (ms, event_id)) filter (where kind = 'set_once') as o from c group by 1, 2)
select person_id, name, case when k is null then o when k = 'set' then v end as value from l where case when k is null then o when k = 'set' then v end is not null"""
)
def person_properties_fold(spark, sf):
    kind = F.when(F.col("event_name").isin("view", "click"), "set").when(F.col("event_name") == "signup", "unset").otherwise("set_once")
    name = F.when(F.col("event_id") % 3 == 0, "plan").when(F.col("event_id") % 3 == 1, "city").otherwise("step")
    changes = M.raw_events(spark, sf).select("person_id", name.alias("name"), F.col("event_id").cast("string").alias("value"), kind.alias("kind"), "ms", "event_id")
    return I.person_properties(changes)


@query(
    """--bare with e as (select event_id, event_id % 4 as q, 'v' || (event_id % 11) as v from events)
select event_id, 'top' as name, v as value, 'set' as kind from e union all select event_id, 'both', 't' || v, 'set' from e union all select event_id, 'given', v, 'set' from e where q = 1
union all select event_id, 'first', '7', 'set_once' from e where q = 2 union all select event_id, x, null, 'unset' from e cross join (select unnest(['old', '$ip']) as x) where q = 3"""
)
def person_property_changes(spark, sf):
    v = F.concat(F.lit("v"), (F.col("event_id") % 11).cast("string"))
    more = F.when(F.col("event_id") % 4 == 1, F.format_string(', "$set": {"given": "%s", "both": "lost", "$browser": "x"}', v)).when(F.col("event_id") % 4 == 2, F.lit(', "$set_once": {"first": 7, "$os": "y"}'))
    more = more.when(F.col("event_id") % 4 == 3, F.lit(', "$unset": ["old", "$ip"]')).otherwise(F.lit(', "$ip": "z"'))
    bag = F.concat(F.format_string('{"top": "%s", "both": "t%s"', v, v), more, F.lit("}"))
    return I.property_changes(M.raw_events(spark, sf).select("event_id", bag.alias("user_properties")), "event_id")


@query("--bare select event_id, 'track' as event_type, '' as session_id, case when event_id % 3 = 0 then 1024 when event_id % 3 = 1 then 800 else 0 end::bigint as screen_width, '{}' as properties from events")
def field_mapping(spark, sf):
    width = F.when(F.col("event_id") % 3 == 0, "1024px").when(F.col("event_id") % 3 == 1, "800").otherwise("-5")
    rows = M.raw_events(spark, sf).select("event_id", "project_id", "event_name", F.lit("").alias("event_type"), "distinct_id", F.lit(None).cast("string").alias("session_id"), width.alias("screen_width"), F.lit(None).cast("string").alias("properties"), "user_properties", F.lit(None).cast("string").alias("timestamp"))
    return I.mapped_fields(rows, F.lit("now")).select(F.col("event_id").cast("long").alias("event_id"), "event_type", "session_id", "screen_width", "properties")


@query(
    """--bare with p as (select distinct cast(user_id as varchar) as person_id, 'plan' as name, cast(user_id as varchar) as value from events)
select person_id, name, min_by(value, (f, origin)) as value from (select case when cast(person_id as int) % 10 = 0 then cast(cast(person_id as int) + 1 as varchar) else person_id end as person_id, name, value, cast(person_id as int) % 10 = 0 as f, person_id as origin from p) group by 1, 2"""
)
def person_merge(spark, sf):
    people = M.raw_events(spark, sf).select("person_id", F.lit("plan").alias("name"), F.col("person_id").alias("value")).distinct()
    moves = model.latest_overrides(M.overrides(spark, sf)).select(F.col("distinct_id").alias("from_id"), F.col("person_id").alias("to_id"))
    return I.merged_properties(people, moves)


@query("--bare select event_id, case when event_type = 'error' then 'invalid_event' when user_id % 20 = 0 or user_id % 20 = 1 then 'illegal_distinct_id' end as problem from events")
def validate_events(spark, sf):
    rows = M.raw_events(spark, sf).withColumn("event_name", F.when(F.col("event_name") == "error", " ").otherwise(F.col("event_name")))
    rows = rows.withColumn("distinct_id", F.when(F.col("user_id") % 20 == 0, "Anonymous").when(F.col("user_id") % 20 == 1, " [object Object]").when(F.col("user_id") % 20 == 2, "email").otherwise(F.col("distinct_id")))
    return I.validated(rows).select("event_id", "problem")


@query("--bare select case when event_type = 'error' then 'invalid_event' else 'illegal_distinct_id' end as type, count(*) as n from events where event_type = 'error' or user_id % 20 = 0 group by 1")
def ingestion_warnings(spark, sf):
    rows = M.raw_events(spark, sf).withColumn("event_name", F.when(F.col("event_name") == "error", " ").otherwise(F.col("event_name")))
    rows = rows.withColumn("distinct_id", F.when(F.col("user_id") % 20 == 0, "Anonymous").otherwise(F.col("distinct_id")))
    return I.warnings(rows).groupBy("type").agg(F.count("*").alias("n"))


@query(
    """--bare with s as (select event_id, (epoch_us(ts) // 1000) + 500 as server, case when event_id % 3 = 0 then null else (epoch_us(ts) // 1000) + 100000 end as sent, (epoch_us(ts) // 1000) + case event_id % 5 when 0 then 200000 when 1 then -300000000 else 40000 end as client from events)
select event_id, case when sent is null or sent - client < 0 or sent - client > 172800000 then server else server - (sent - client) end as ms from s"""
)
def clock_skew(spark, sf):
    late = F.when(F.col("event_id") % 5 == 0, 200_000).when(F.col("event_id") % 5 == 1, -300_000_000).otherwise(40_000)
    sent = F.when(F.col("event_id") % 3 != 0, F.col("ms") + 100_000)
    return M.raw_events(spark, sf).select("event_id", I.corrected_ms(F.col("ms") + 500, sent, F.col("ms") + late).alias("ms"))


@query("--bare with n as (select event_id, ['$identify', '$pageview', '$pageleave', '$set', '$set_once', '$screen', '$other', 'view'][(event_id % 8 + 1)::int] as event_name from events) select event_id, event_name, case when event_name in ('$other', 'view') then 'track' else event_name[2:] end as event_type from n")
def event_types(spark, sf):
    names = F.array(*[F.lit(n) for n in (*I.TYPES, "$other", "view")])
    rows = M.raw_events(spark, sf).select("event_id", F.get(names, (F.col("event_id") % 8).cast("int")).alias("event_name"))
    return rows.select("event_id", "event_name", I.event_type(F.col("event_name")).alias("event_type"))


@query(
    """--bare with h as (select distinct cast(user_id as varchar) as d, sha1('person:p1:' || cast(user_id as varchar)) as h from events)
select d as distinct_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (cast('0x' || h[17] as int) % 4 + 1)::int, 1) || h[18:20] || '-' || h[21:32] as person_id from h"""
)
def deterministic_person(spark, sf):
    rows = M.raw_events(spark, sf).select("project_id", "distinct_id").distinct()
    return rows.select("distinct_id", I.person_id(F.col("project_id"), F.col("distinct_id")).alias("person_id"))


@query("--bare select user_id, 'block' || (user_id // 16) as country from (select distinct user_id from events)")
def geo_enrichment(spark, sf):
    users = M.raw_events(spark, sf).select("user_id").distinct()
    rows = users.withColumn("ip", F.format_string("10.0.%d.%d", F.floor(F.col("user_id") / 256).cast("int"), (F.col("user_id") % 256).cast("int")))
    base = F.lit(10 * 256**3).cast("long")
    blocks = users.select(F.floor(F.col("user_id") / 16).alias("b")).distinct().select((base + F.col("b") * 16).alias("low"), (base + F.col("b") * 16 + 15).alias("high"), F.concat(F.lit("block"), F.col("b").cast("string")).alias("country"))
    return I.with_country(rows, blocks).select("user_id", "country")


@query(
    """--bare with u as (select event_id, case event_id % 3 when 0 then 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36' when 1 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) Mobile Safari/604.1' else 'Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0' end as ua from events)
select event_id, case event_id % 3 when 0 then 'Chrome' when 1 then 'Safari' else 'Firefox' end as browser, case event_id % 3 when 0 then 'Windows' when 1 then 'iOS' else 'Linux' end as os, case event_id % 3 when 1 then 'mobile' else 'desktop' end as device_type from u"""
)
def user_agent_enrichment(spark, sf):
    ua = F.when(F.col("event_id") % 3 == 0, "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36").when(F.col("event_id") % 3 == 1, "Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) Mobile Safari/604.1").otherwise("Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0")
    return M.raw_events(spark, sf).select("event_id", *I.user_agent(ua))


@query("--bare with w as (select strftime(date_trunc('minute', ts) + to_seconds(floor(second(ts) / 10) * 10 - o), '%Y-%m-%d %H:%M:%S') as window_start from events cross join (select unnest([0, 10, 20, 30, 40, 50]) as o)) select 'p1' as project_id, window_start, count(*) as n, count(*) > 1 as over from w group by 2")
def rate_limit_buckets(spark, sf):
    return I.rate_buckets(M.raw_events(spark, sf), 1)


@query("--bare select cast(user_id as varchar) as project_id, '2024-01' as month, count(*) as n from events group by 1 having count(*) > 65")
def quota_over_limit(spark, sf):
    rows = M.raw_events(spark, sf).withColumn("project_id", F.col("distinct_id"))
    return I.over_quota(rows, rows.select("project_id").distinct().withColumn("events_limit", F.lit(65)))


@query("--bare select event_type as event_name, count(*) as n from events where user_id <> 0 group by 1")
def stream_ingest(spark, sf):
    """File stream of the events as JSON lines through the whole ingest job; events by name as the result. User 0 is nobody."""
    from eventloom.streaming.ingest import start

    folder, rows = M.scratch(spark, "stream"), M.raw_events(spark, sf)
    time = F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")).alias("timestamp")
    rows.select("project_id", F.col("event_id").cast("string"), F.col("event_name").alias("event"), "distinct_id", "properties", time).write.json(f"{folder}/in")
    start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", imported=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out/events").groupBy("event_name").agg(F.count("*").alias("n"))


@query("--bare with e as (select event_id, cast(user_id as varchar) as d, user_id from events where user_id <> 0) select event_id, case when user_id % 5 = 1 then 'moved' else 'own' end as person from e")
def stream_identity(spark, sf):
    """Two runs of the job: the first has an identify event for every fifth user, the second that user's events, which are the other person's."""
    from eventloom.streaming.ingest import start

    folder, rows = M.scratch(spark, "stream"), M.raw_events(spark, sf).where("user_id <> 0")
    other = F.concat(F.lit("account-"), "distinct_id")
    some = rows.where("user_id % 5 = 1").select("project_id", "distinct_id").distinct()
    asked = some.select("project_id", F.concat(F.lit("i"), "distinct_id").alias("event_id"), F.lit("$identify").alias("event"), other.alias("distinct_id"), F.col("distinct_id").alias("anonymous_id"))
    told = rows.select("project_id", F.col("event_id").cast("string"), F.col("event_name").alias("event"), "distinct_id", F.lit(None).cast("string").alias("anonymous_id"))
    for part in (asked, told):
        part.write.mode("append").json(f"{folder}/in")
        start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{folder}/out/events").where("event_name <> '$identify'")
    own = lambda d: I.person_id(F.col("project_id"), d)
    person = F.when(F.col("person_id") == own(F.col("distinct_id")), "own").when(F.col("person_id") == own(other), "moved").otherwise("wrong")
    return got.select(F.col("event_id").cast("long").alias("event_id"), person.alias("person"))


# Files
@query("--bare select event_id, strftime(ts, '%Y-%m') as event_month from events")
def insert_by_month(spark, sf):
    folder = M.scratch(spark, "inserted")
    files.write_events(M.raw_events(spark, sf), folder)
    return spark.read.parquet(folder).select("event_id", F.col("event_month").cast("string").alias("event_month"))


@query("--bare select o_orderkey, o_orderstatus, o_orderpriority from orders")
def export_csv(spark, sf):
    folder = M.scratch(spark, "csv")
    files.export_csv(M.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), folder)
    return spark.read.csv(folder, header=True, schema="o_orderkey long, o_orderstatus string, o_orderpriority string")


@query("--bare select '| ' || p_partkey || ' | ' || replace(p_name, 'e', '\\|') || ' |' as line from part union all select unnest(['| p_partkey | p_name |', '| --- | --- |'])")
def export_markdown(spark, sf):
    folder = M.scratch(spark, "markdown")
    files.export_markdown(M.read(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit("e"), F.lit("|")).alias("p_name")), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("--bare select 'uploaded' as cohort_id, cast(user_id as varchar) as person_id from events where user_id % 6 = 2 group by all")
def member_import(spark, sf):
    """A list of distinct ids as CSV, among them repeated and unknown ones, becomes members of a cohort."""
    folder = M.scratch(spark, "members")
    ids = M.read(spark, sf, "events").where("user_id % 6 = 2").select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("User_ID"))
    ids.unionByName(spark.createDataFrame([("nobody",)], "User_ID string")).write.option("header", True).csv(folder)
    rows, kind = files.read_member_csv(spark, folder)
    ids = M.raw_events(spark, sf).select("project_id", "person_id", "distinct_id").distinct()
    return C.import_members(rows, kind, "uploaded", ids, M.persons(spark, sf))


@query("--bare select case when event_id % 10 = 0 then 'broken' else event_type end as kind, count(*) as n from events group by 1")
def http_batch(spark, sf):
    """Lines of a batch, every tenth of them broken."""
    folder, rows = M.scratch(spark, "batch"), M.raw_events(spark, sf)
    line = F.to_json(F.struct("project_id", F.col("event_name").alias("event"), "distinct_id", "properties"))
    rows.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(folder)
    back = files.read_batch(spark, folder)
    return back.groupBy(F.when(F.col("_corrupt").isNotNull(), "broken").otherwise(F.col("event")).alias("kind")).agg(F.count("*").alias("n"))


@query("--bare select event_type as event, count(*) as n from events group by 1")
def http_import(spark, sf):
    folder, rows = M.scratch(spark, "import"), M.raw_events(spark, sf)
    rows.select("project_id", F.col("event_name").alias("event"), "distinct_id", F.col("ts").cast("string").alias("timestamp")).write.json(folder)
    return files.read_import(spark, folder).where("timestamp is not null").groupBy("event").agg(F.count("*").alias("n"))


@query("--bare with u as (select distinct user_id from events) select cast(user_id as varchar) as distinct_id, cast(case when user_id % 10 = 0 then user_id + 1 else user_id end as varchar) as person_id from u")
def person_merge_ids(spark, sf):
    ids = M.raw_events(spark, sf).select("project_id", "distinct_id", "person_id").distinct()
    moves = model.latest_overrides(M.overrides(spark, sf)).select(F.col("distinct_id").alias("from_id"), F.col("person_id").alias("to_id"))
    return I.moved_ids(ids, moves).select("distinct_id", "person_id")


@query("select 'segment' as property_name, 'String' as value_type, strftime(date_trunc('hour', max(ts)), '%Y-%m-%d %H:%M:%S') as last_seen from ev union all select 'age', 'Numeric', strftime(date_trunc('hour', max(ts)), '%Y-%m-%d %H:%M:%S') from ev where event_id % 3 = 0")
def person_property_definitions(spark, sf):
    some = F.when(F.col("event_id") % 3 == 0, F.lit('{"segment": "x", "$browser": "y", "$set": {"age": 5}, "$unset": ["z"]}')).otherwise(F.col("user_properties"))
    return D.person_property_definitions(M.events(spark, sf).withColumn("user_properties", some))


# Ad-hoc
@query(f"select count_if(plan = 'pro')::double as value_a, count_if(plan = 'free')::double as value_b, floor((count_if(plan = 'free') - count_if(plan = 'pro')) * 100.0 / count_if(plan = 'pro') * 100.0 + 0.5) / 100.0 as diff_percent from pe where event_name = 'view' and {IN}")
def segment_compare(spark, sf):
    return A.segment_compare(M.events(spark, sf), "view", "total_events", (Filter("properties.plan", "eq", "pro"),), (Filter("properties.plan", "eq", "free"),), FROM, TO)


ONE, TWO = ("2024-01-05", "2024-01-14"), ("2024-01-15", "2024-01-24")
_A, _B = "ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-14 23:59:59'", "ts >= timestamp '2024-01-15' and ts <= timestamp '2024-01-24 23:59:59'"


@query(f", c as (select count(distinct person_id) filter (where {_A})::double as a, count(distinct person_id) filter (where {_B})::double as b from ev where event_name = 'view') select a as value_before, b as value_after, floor((b - a) * 100.0 / a * 100.0 + 0.5) / 100.0 as change_percent from c")
def metric_change_overall(spark, sf):
    return A.metric_change(M.events(spark, sf), "view", "unique_users", ONE, TWO)


@query(
    f""", a as (select plan as s, count(*)::double as n from pe where event_name = 'view' and {_A} group by 1), b as (select plan as s, count(*)::double as n from pe where event_name = 'view' and {_B} group by 1),
j as (select coalesce(a.s, b.s) as segment, coalesce(a.n, 0.0) as value_before, coalesce(b.n, 0.0) as value_after from a full join b on a.s = b.s), w as (select sum(value_after) - sum(value_before) as whole from j)
select segment, value_before, value_after, case when whole = 0 then 0.0 else floor((value_after - value_before) * 100.0 / whole * 100.0 + 0.5) / 100.0 end as contribution from j cross join w order by abs(value_after - value_before) desc, segment limit 20"""
)
def metric_change_dimension(spark, sf):
    return A.metric_change_by(M.events(spark, sf), "view", "total_events", "properties.plan", ONE, TWO)


_LATE = "ts >= timestamp '2024-01-23' and ts <= timestamp '2024-01-24 23:59:59'"


@query(
    f""", en as (select person_id, min(ts) as start from ev where event_name = 'signup' and {_LATE} group by 1),
sn as (select distinct ev.person_id, event_name from ev join en on ev.person_id = en.person_id and ts > start where {_LATE} and event_name <> 'signup'),
pp as (select person_id, person_id in (select person_id from sn where event_name = 'purchase') as done from en),
b as (select event_name, count(*) as n_with, count_if(done) as dw from sn join pp using (person_id) where event_name <> 'purchase' group by 1), w as (select count(*) as na, count_if(done) as da from pp),
x as (select event_name, n_with, na - n_with as n_without, dw / n_with as a, (da - dw) / (na - n_with) as b from b cross join w where n_with >= 1 and na - n_with >= 1)
select event_name, n_with, n_without, floor(a * 100 * 100.0 + 0.5) / 100.0 as rate_with, floor(b * 100 * 100.0 + 0.5) / 100.0 as rate_without, case when b > 0 then floor((a - b) * 100 / b * 100.0 + 0.5) / 100.0 else 0.0 end as lift_percent from x order by abs(a - b) desc, event_name limit 10"""
)
def funnel_gaps(spark, sf):
    return A.funnel_gaps(M.events(spark, sf), "signup", "purchase", "2024-01-23", "2024-01-24", least=1)


_BETWEEN = f""", st as (select person_id, min(ms) as a from ev where event_name = 'signup' and {IN} group by 1), tb as (select st.person_id, floor((min(ms) - a) / 1000)::bigint as seconds from st join ev on ev.person_id = st.person_id and event_name = 'purchase' and ms > a and ms <= a + 7 * 86400000::bigint group by st.person_id, a)"""


def _between(spark, sf):
    return A.time_between(M.events(spark, sf), "signup", "purchase", 7, FROM, TO)


@query(_BETWEEN + " select count(*) as n, avg(seconds) as avg_seconds, quantile_disc(seconds, 0.5)::double as p50, quantile_disc(seconds, 0.75)::double as p75, quantile_disc(seconds, 0.9)::double as p90, quantile_disc(seconds, 0.95)::double as p95 from tb")
def time_between_events(spark, sf):
    return A.time_percentiles(_between(spark, sf))


@query(_BETWEEN + ", mm as (select min(seconds) as lo, max(seconds) as hi from tb) select (case when hi = lo then 0 else least(floor((seconds - lo) * 10 / (hi - lo)), 9) end)::int as bin, count(*) as n from tb cross join mm group by 1")
def time_between_histogram(spark, sf):
    return A.equal_bins(_between(spark, sf))


@query("select person_id, count(*) as event_count, min(ms) as first_seen, max(ms) as last_seen from pe where k > 50 group by 1 order by 2 desc, 1 limit 25")
def query_persons(spark, sf):
    return A.query_persons(M.events(spark, sf), (Filter("properties.k", "gt", "50"),))


@query("select person_id, max_by(segment, (ts, event_id)) as segment from ev where person_id in (select cast(user_id as varchar) from events where user_id % 4 = 0) group by 1 order by 1 limit 25")
def query_cohort_members(spark, sf):
    rows = A.cohort_sample(M.events(spark, sf), M.static_members(spark, sf))
    return rows.select("person_id", F.get_json_object("user_properties", "$.segment").alias("segment"))


# Relational algebra
def _t(spark, sf, *names):
    return [M.read(spark, sf, n) for n in names]


@query("--bare select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 400000")
def join_inner(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return o.where("o_totalprice > 400000").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("--bare select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1")
def join_left(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "F"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("--bare select r_name, n_name from region cross join nation")
def join_cross(spark, sf):
    #: 5 regions by 25 nations, fixed sizes.
    r, n = _t(spark, sf, "region", "nation")
    return r.crossJoin(n).select("r_name", "n_name")


@query("--bare select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as n_customers, coalesce(b.n, 0) as n_suppliers from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by 1) a full join (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 9000 group by 1) b on a.k = b.k")
def join_full_outer(spark, sf):
    c, s = _t(spark, sf, "customer", "supplier")
    a = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = s.where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full").na.fill(0, ["n_customers", "n_suppliers"])


@query("--bare select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def join_semi(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("--bare select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)")
def join_anti(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    return c.join(o.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("--bare select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 450000) or c_acctbal > 9000 as marked from customer")
def join_mark(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    big = o.where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    rows = c.join(big, F.col("c_custkey") == F.col("k"), "left")
    return rows.select("c_custkey", (F.coalesce("hit", F.lit(False)) | (F.col("c_acctbal") > 9000)).alias("marked"))


def _keys(spark, sf):
    c, s = _t(spark, sf, "customer", "supplier")
    return c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


_KEYS = "(select c_nationkey as k from customer where c_acctbal > 5000) {} (select s_nationkey as k from supplier where s_acctbal > 5000)"
for _name, _word, _f in (("set_union_all", "union all", lambda a, b: a.unionByName(b)), ("set_union_distinct", "union", lambda a, b: a.unionByName(b).distinct()), ("set_intersect", "intersect", lambda a, b: a.intersect(b)), ("set_except", "except", lambda a, b: a.subtract(b))):
    query("--bare select k from (" + _KEYS.format(_word) + ")", _name)(lambda spark, sf, f=_f: f(*_keys(spark, sf)))


@query("--bare select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, floor(avg(l_discount) * 10000.0 + 0.5) / 10000.0 as avg_discount, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2 having count(*) > 10")
def group_having(spark, sf):
    rows = M.read(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.sum("l_quantity").alias("sum_qty"), half_up(F.avg("l_discount"), 4).alias("avg_discount"), F.count("*").alias("n")).where("n > 10")


@query("--bare select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5")
def top_k_offset(spark, sf):
    return M.read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("--bare select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n <= 2")
def top_k_per_group(spark, sf):
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return M.read(spark, sf, "orders").withColumn("n", F.row_number().over(best)).where("n <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("--bare select n_name, unnest(string_split(n_name, '_')) as part from nation")
def array_unnest(spark, sf):
    return M.read(spark, sf, "nation").select("n_name", F.explode(F.split("n_name", "_")).alias("part"))


@query("--bare select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.9 from orders)")
def scalar_subquery(spark, sf):
    o = M.read(spark, sf, "orders")
    #: One row on the right.
    return o.crossJoin(o.agg((F.avg("o_totalprice") * 1.9).alias("m"))).where("o_totalprice > m").select("o_orderkey")


@query("--bare select range::bigint as step from range(1, 11)")
def numbers_generator(spark, sf):
    return spark.range(1, 11).select(F.col("id").alias("step"))


@query("--bare select distinct p_brand, p_size from part where p_size in (1, 5, 9) and p_name not like '%red%'")
def distinct_filter(spark, sf):
    return M.read(spark, sf, "part").where(F.col("p_size").isin(1, 5, 9) & ~F.col("p_name").like("%red%")).select("p_brand", "p_size").distinct()


@query("--bare select event_id, user_id from events where event_id not in (select event_id from events where event_type = 'error')")
def delete_by_predicate(spark, sf):
    target = M.scratch(spark, "deleted")
    files.delete_where(spark, f"{sf}/events.parquet", target, F.col("event_type") == "error")
    return spark.read.parquet(target).select("event_id", "user_id")


@query("--bare select o_orderkey, o_orderdate::varchar as d from orders where (o_orderdate, o_orderkey) > (timestamp '1996-01-01', 100) order by o_orderdate, o_orderkey limit 50")
def keyset_page(spark, sf):
    rows = files.after(M.read(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01'"), (datetime(1996, 1, 1), 100), ("o_orderdate", "o_orderkey"), 50)
    return rows.select("o_orderkey", F.col("o_orderdate").cast("string").alias("d"))


@query("--bare select count(*) as n from events")
def table_count(spark, sf):
    return M.read(spark, sf, "events").agg(F.count("*").alias("n"))




@query("--bare " + ORACLES["time_between_events"])
def time_between_selected(spark, sf):
    return A.selected_time_percentiles(_between(spark, sf))


@query("--bare select event_type as event, case when user_id % 2 = 0 then 'even' end as import, count(*) as n from events where user_id % 2 = 0 group by 1, 2 union all select 'rejected', 'odd', count(*) from events where user_id % 2 = 1 and event_id % 10 = 7")
def import_all_or_nothing(spark, sf):
    """Two imports: one whole, and one in which some lines have no timestamp, which leaves nothing but its count of bad lines."""
    folder, rows = M.scratch(spark, "import"), M.raw_events(spark, sf)
    time = F.when((F.col("user_id") % 2 == 1) & (F.col("event_id") % 10 == 7), "").otherwise(F.col("ts").cast("string")).alias("timestamp")
    lines = rows.select("user_id", "project_id", F.col("event_name").alias("event"), "distinct_id", time)
    rejected = 0
    for k, name in enumerate(("even", "odd")):
        lines.where(F.col("user_id") % 2 == k).drop("user_id").write.json(f"{folder}/{name}")
        try:
            files.import_events(spark, f"{folder}/{name}", f"{folder}/out", name)
        except files.ImportRejected as error:
            rejected = error.bad
    kept = spark.read.parquet(f"{folder}/out").groupBy("event", F.col("import").cast("string").alias("import")).agg(F.count("*").alias("n"))
    return kept.unionByName(spark.createDataFrame([("rejected", "odd", rejected)] if rejected else [], kept.schema))


@query("--bare select event_id, strftime(ts, '%Y-%m-%d') as day from events where not (event_type = 'error' and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12') and not (ts >= timestamp '2024-01-20' and ts < timestamp '2024-01-21')")
def delete_by_partition(spark, sf):
    """A table by day: the errors of two days go, and all of a third, whose folder goes with it."""
    folder = M.scratch(spark, "deleted")
    rows = M.raw_events(spark, sf).select("event_id", "event_name", "ts", F.col("ts").cast("date").cast("string").alias("day"))
    rows.repartition("day").write.partitionBy("day").parquet(folder)
    day = lambda a, b: (F.col("ts") >= F.expr(f"timestamp_ntz'{a}'")) & (F.col("ts") < F.expr(f"timestamp_ntz'{b}'"))
    files.delete_in_place(spark, folder, (F.col("event_name") == "error") & day("2024-01-10", "2024-01-12") | day("2024-01-20", "2024-01-21"), "day")
    return spark.read.parquet(folder).select("event_id", F.col("day").cast("string").alias("day"))


@query("""--bare with a as (select event_id, user_id // 16 as hi, user_id % 16 as lo, event_id % 3 as kind from events)
select event_id, case when kind = 2 and event_id % 2 = 0 then '' when kind = 0 and hi = 1 and lo >= 8 then 'inner' when kind = 0 and hi % 2 = 1 then 'odd' when kind = 0 then 'ten'
  when kind = 1 and hi = 2 then 'six-two' when kind = 1 then 'six' when kind = 2 then 'mapped' end as country from a""")
def geo_prefixes(spark, sf):
    """Addresses of both versions in nested blocks: 10.hi.0.lo, fd00::hi:lo, and IPv4 ones written the IPv6 way, every other of these with an octet too large.

    What of hi is too large for an octet or a group goes into the next one, which is 0 for small numbers only, so every address is one and stays in its blocks."""
    n = lambda c: c.cast("string")
    hi, lo = F.floor(F.col("user_id") / 16), F.col("user_id") % 16
    low, more = hi % 256, F.when(hi < 256, 0).otherwise(F.floor(hi / 256) % 255 + 1)
    group = F.when(hi < 65536, "").otherwise(F.concat(F.lower(F.hex(F.floor(hi / 65536) % 65535 + 1)), F.lit(":")))
    six = F.concat(F.lit("FD00::"), group, F.lower(F.hex(hi % 65536)), F.lit(":"), F.lower(F.hex(lo)))
    mapped = F.concat(F.lit("::ffff:192.168."), n(low), F.lit("."), n(F.when(F.col("event_id") % 2 == 0, 300).otherwise(lo)))
    kind = F.col("event_id") % 3
    ip = F.when(kind == 0, F.concat(F.lit("10."), n(low), F.lit("."), n(more), F.lit("."), n(lo))).when(kind == 1, six).otherwise(mapped)
    rows = M.raw_events(spark, sf).select("event_id", ip.alias("ip"))
    odd = M.raw_events(spark, sf).select(low.alias("h")).where("h % 2 = 1").distinct().select(F.concat(F.lit("10."), n(F.col("h")), F.lit(".0.0/16")).alias("network"), F.lit("odd").alias("country"))
    fixed = [("10.0.0.0/8", "ten"), ("10.1.0.8/29", "inner"), ("fd00::/16", "six"), ("fd00::2:0/112", "six-two"), ("192.168.0.0/16", "mapped"), ("300.1.1.1/8", "wrong"), ("fd00::/200", "wrong")]
    blocks = odd.unionByName(spark.createDataFrame(fixed, "network string, country string"))
    return I.with_place(rows, blocks).select("event_id", "country")
