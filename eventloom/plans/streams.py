"""Queries of the ingest job: repeats, dead letters, identity in order, persons, catalogs, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import ingest as I
from eventloom.operators import merges
from eventloom.plans import fixtures as M
from eventloom.plans.registry import query

def _told(spark, sf):
    """The events as clients send them, but for user_id and ts, which go before they are sent. User 0 is nobody."""
    time = F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    rows = M.raw_events(spark, sf).where("user_id <> 0")
    return rows.select("project_id", F.col("event_id").cast("string").alias("event_id"), F.col("event_name").alias("event"), "distinct_id", "properties", "user_properties", time.alias("timestamp"), "user_id", "ts")


def _run(spark, kind: str, parts, job, files: int = 1):
    """The job over the parts, one file and batch each; its folder."""
    from eventloom.streaming.ingest import start

    folder = M.scratch(spark, kind)
    for part in parts:
        part.drop("user_id", "ts").coalesce(1).write.mode("append").json(f"{folder}/in")
    start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", files=files, imported=True, job=job).awaitTermination()
    return folder


def _lean(**more):
    from eventloom.streaming.ingest import Job

    return Job(**({"persons": False, "catalogs": False, "keys": 100_000} | more))


@query("--bare select event_type as event_name, count(*) as n from events where user_id <> 0 group by 1")
def stream_repeats(spark, sf):
    """Three batches: the second has half of the first's events again, the third all of both, twice."""
    rows = _told(spark, sf)
    one, two = rows.where("user_id % 2 = 0"), rows.where("user_id % 2 = 1")
    folder = _run(spark, "stream", [one, two.unionByName(one.where("user_id % 4 = 0")), rows.unionByName(rows)], _lean())
    return spark.read.parquet(f"{folder}/out/events").groupBy("event_name").agg(F.count("*").alias("n"))


@query("""--bare select 'before' as phase, event_type as event_name, count(*) as n from events where user_id <> 0 and user_id % 4 <> 1 group by 2
union all select 'after', event_type, count(*) from events where user_id <> 0 group by 2""")
def stream_dead_letters(spark, sf):
    """Four batches, the second of which can't be written, as a file stands where its folder has to be: the others are written, and it is once the fault is gone."""
    from eventloom.streaming.ingest import replay, start

    rows, folder, job = _told(spark, sf), M.scratch(spark, "stream"), _lean(attempts=2)
    for k in range(4):
        rows.where(F.col("user_id") % 4 == k).drop("user_id", "ts").coalesce(1).write.mode("append").json(f"{folder}/in")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out/stage/step=1000")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at).close()
    start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", files=1, imported=True, job=job).awaitTermination()
    written = lambda phase: spark.read.parquet(f"{folder}/out/events").groupBy("event_name").agg(F.count("*").alias("n")).select(F.lit(phase).alias("phase"), "event_name", "n")
    before = spark.createDataFrame(written("before").collect(), "phase string, event_name string, n long")  # a row an event name
    replay(spark, f"{folder}/out", job=job)
    return before.unionByName(written("after"))


_TURN, _LATER = "2024-01-12 00:00:00", "2024-01-20 00:00:00"
_ORDER_SQL = f"""case when user_id % 5 <> 1 then 'own' when ts < timestamp '{_TURN}' then 'own' when user_id % 10 = 1 and ts >= timestamp '{_LATER}' then 'group' else 'account' end"""


def _identify(rows, anonymous, user, at: str):
    """Identify events: one for each distinct id in ``rows``."""
    ids = rows.select("project_id", "distinct_id", "user_id").distinct()
    time = at.replace(" ", "T") + "Z"
    return ids.select("project_id", F.concat(F.lit("i"), user).alias("event_id"), F.lit("$identify").alias("event"), user.alias("distinct_id"), anonymous.alias("anonymous_id"), F.lit(time).alias("timestamp"), "user_id")


@query(f"--bare select event_id, {_ORDER_SQL} as person from events where user_id <> 0")
def stream_identity_order(spark, sf):
    """One batch with identify events in the middle of a month: every fifth user goes into an account, and half of these accounts into a group later.
    Events before stay with their own person, later ones have the account's, and then the group's."""
    rows, d = _told(spark, sf), F.col("distinct_id")
    account, group = F.concat(F.lit("account-"), d), F.concat(F.lit("group-"), d)
    some = rows.where("user_id % 5 = 1")
    asked = _identify(some, d, account, _TURN).unionByName(_identify(some.where("user_id % 10 = 1"), account, group, _LATER))
    folder = _run(spark, "stream", [rows.unionByName(asked, allowMissingColumns=True)], _lean())
    got = spark.read.parquet(f"{folder}/out/events").where("event_name <> '$identify'")
    own = lambda x: I.person_id(F.col("project_id"), x)
    person = F.when(F.col("person_id") == own(d), "own").when(F.col("person_id") == own(account), "account").when(F.col("person_id") == own(group), "group").otherwise("wrong")
    return got.select(F.col("event_id").cast("long").alias("event_id"), person.alias("person"))


#: Every sign-up says that two users are one; the SQL replays them one after another.
_OTHER = "(user_id * 7 + 3) % (select max(user_id) + 1 from events)"
_REPLAY = f"""--bare with recursive m as (select row_number() over (order by ts, event_id) as i, user_id as u, {_OTHER} as a from events where event_type = 'signup' and event_id % 40 = 0),
st(i, owner) as (select 0::bigint, range(0, (select max(user_id) + 1 from events)::bigint)
  union all select m.i, list_transform(owner, lambda x: case when x = owner[a + 1] then owner[u + 1] else x end) from st join m on m.i = st.i + 1)"""


def _moves(spark, sf):
    rows = M.raw_events(spark, sf)
    users = rows.agg((F.max("user_id") + 1).alias("users"))
    #: One row on the right.
    some = rows.where("event_name = 'signup' and event_id % 40 = 0").crossJoin(users)
    other = ((F.col("user_id") * 7 + 3) % F.col("users")).cast("string")
    return some.select(other.alias("anonymous"), F.col("user_id").cast("string").alias("user"), "ms", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"))


@query(_REPLAY + ", l as (select owner from st order by i desc limit 1) select distinct cast(user_id as varchar) as distinct_id, cast(l.owner[user_id + 1] as varchar) as person_id from events cross join l")
def person_merge_chains(spark, sf):
    """Where every user's events belong after all merges, chains and circles among them."""
    ids = M.raw_events(spark, sf).select("distinct_id", F.col("distinct_id").alias("person_id")).distinct()
    return merges.persons_now(ids, merges.merge_ways(_moves(spark, sf))).select("distinct_id", "person_id")


@query(_REPLAY + ", s as (select e.event_id, user_id, (select coalesce(max(i), 0) from (select row_number() over (order by ts, event_id) as i, ts, event_id from events where event_type = 'signup' and event_id % 40 = 0) k where (k.ts, k.event_id) <= (e.ts, e.event_id)) as i from events e) select event_id, cast(owner[user_id + 1] as varchar) as person_id from s join st using (i)")
def person_at_event(spark, sf):
    """Whose each event was at its time, merges up to then counted."""
    rows = M.raw_events(spark, sf).select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), "ms", F.col("distinct_id").alias("person_id"))
    return merges.persons_at(rows, merges.merge_ways(_moves(spark, sf))).select(F.col("event_id").cast("long").alias("event_id"), "person_id")


@query(
    _REPLAY
    + """, p as (select user_id as u, 'k' || (user_id % 3) as name, cast(user_id as varchar) as value from events group by all),
w as (select p.u, name, value, l.owner[p.u + 1] as now from p cross join (select owner from st order by i desc limit 1) l),
d as (select w.u, name, value, now, coalesce((select min(st.i) from st where st.owner[w.u + 1] = now), 0) as since from w)
select cast(now as varchar) as person_id, name, count(*) filter (u = now) as own from d group by 1, 2"""
)
def person_merge_properties(spark, sf):
    """Names of the properties that persons have after all merges, and whether the value is a person's own, which always wins."""
    people = M.raw_events(spark, sf).select("user_id").distinct().select(F.col("user_id").cast("string").alias("person_id"), F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("name"), F.col("user_id").cast("string").alias("value"))
    got = merges.merged_people(people, merges.merge_ways(_moves(spark, sf)))
    return got.select("person_id", "name", (F.col("value") == F.col("person_id")).cast("long").alias("own"))


@query("--bare select distinct 'segment' as name, 's' || (user_id % 5) as value, count(distinct user_id) as n_persons from events where user_id <> 0 group by 2 union all select 'first', case when user_id % 2 = 0 then 'even' else 'odd' end, count(distinct user_id) from events where user_id <> 0 group by 2")
def stream_persons(spark, sf):
    """The person store after two batches: a property that every event sets, and one that the first event of a person sets for good."""
    rows = _told(spark, sf).withColumn("user_properties", F.format_string('{"segment": "s%d", "$set_once": {"first": "%s"}}', F.col("user_id") % 5, F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")))
    late = rows.withColumn("event_id", F.concat(F.lit("again-"), "event_id")).withColumn("user_properties", F.lit('{"$set_once": {"first": "later"}, "$unset": ["nothing"]}'))
    folder = _run(spark, "stream", [rows, late], _lean(persons=True))
    from eventloom.streaming.ingest import current_persons

    return current_persons(spark, f"{folder}/out").groupBy("name", "value").agg(F.count("*").alias("n_persons"))


_CATALOG = """--bare with e as (select *, (epoch_us(ts) // 1000) as ms from events where user_id <> 0),
p as (select *, 'properties.k' as property_name, 'Numeric' as value_type from e union all select *, 'properties.plan', 'String' from e where event_id % 5 <> 0 union all select *, 'properties.ok', case when event_id % 5 = 3 then null else 'Boolean' end from e where event_id % 5 in (1, 2, 3)
  union all select *, 'properties.seen', 'DateTime' from e where event_id % 5 = 4),
q as (select *, 'event' as property_type from p union all select *, 'user_properties.segment', 'String', 'person' from e)
select 'event' as kind, event_type as event_name, '' as property_name, '' as property_type, null as value_type, max(ms) as last_seen_ms from e group by 2
union all select 'property', '', property_name, property_type, first(value_type order by value_type nulls last), max(ms) from q group by 3, 4
union all select 'event_property', event_type, property_name, property_type, null, max(ms) from q group by 2, 3, 4"""


@query(_CATALOG)
def stream_catalog(spark, sf):
    """The catalogs after three batches are those of one pass over all events."""
    from eventloom.streaming.ingest import current_catalog

    rows = _told(spark, sf)
    plan = F.when(F.col("properties").contains('"12.5"'), F.replace("properties", F.lit('"12.5"'), F.lit('"basic"'))).otherwise(F.col("properties"))
    rows = rows.withColumn("properties", plan)
    folder = _run(spark, "stream", [rows.where(F.col("user_id") % 3 == k) for k in range(3)], _lean(catalogs=True))
    return current_catalog(spark, f"{folder}/out").select("kind", "event_name", "property_name", "property_type", "value_type", "last_seen_ms")


_RATE, _QUOTA, _SLOW = 6, 2000, 100


@query(f"""--bare with recursive e as (select event_id, 'p' || (user_id % 3) as project_id, (epoch_us(ts) // 1000) // {_SLOW} as ms from events),
o as (select *, ms // 10000 as bucket, row_number() over (partition by project_id, ms // 10000 order by ms, event_id) as r from e),
c as (select project_id, bucket, count(*) as n, row_number() over (partition by project_id order by bucket) as i, year(make_timestamp(bucket * 10000000)) * 12 + month(make_timestamp(bucket * 10000000)) as month from o group by 1, 2),
w(project_id, i, bucket, rate_room, room, recent, month, used) as (
  select distinct project_id, 0::bigint, -1000::bigint, 0::bigint, 0::bigint, []::struct(b bigint, n bigint)[], 0::bigint, 0::bigint from c
  union all
  select project_id, i, bucket, rate_room, room, list_append(recent, {{'b': bucket, 'n': room}}), month, used + room from (
    select *, least(rate_room, greatest(0, {_QUOTA} - used))::bigint as room from (
      select w.project_id, c.i, c.bucket, least(c.n, greatest(0, {_RATE} - coalesce(list_sum(list_transform(list_filter(w.recent, lambda x: x.b > c.bucket - 6), lambda x: x.n)), 0)))::bigint as rate_room,
             list_filter(w.recent, lambda x: x.b > c.bucket - 6) as recent, c.month::bigint as month, (case when c.month = w.month then w.used else 0 end)::bigint as used
      from w join c on c.project_id = w.project_id and c.i = w.i + 1)))
select o.event_id, case when r > rate_room then 'rate_limited' when r > room then 'quota_limited' end as answer from o join w on w.project_id = o.project_id and w.bucket = o.bucket""")
def stream_admission(spark, sf):
    """Three projects with a rate and a monthly quota, their time sped up a hundredfold, in two calls with the counters of the first."""
    from eventloom.streaming import admission

    rows = M.raw_events(spark, sf).select("event_id", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"), F.floor(F.col("ms") / _SLOW).alias("ms"))
    plans = rows.select("project_id").distinct().withColumn("events_limit", F.lit(_QUOTA).cast("long"))
    cut = rows.agg(F.expr("percentile_approx(ms, 0.5)")).first()[0] or 0
    cut -= cut % admission.BUCKET_MS
    one, counters = admission.admit(rows.where(F.col("ms") < cut), spark.createDataFrame([], admission.COUNTERS), plans, _RATE)
    two, _ = admission.admit(rows.where(F.col("ms") >= cut), counters, plans, _RATE)
    return one.unionByName(two).select("event_id", "answer")
