"""Queries of the insights with their SQL: trends, filters, retention, lifecycle, stickiness."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventloom.functions.filters import OPERATORS, Filter, condition
from eventloom.operators import retention as R
from eventloom.operators import trend as T
from eventloom.plans.registry import query
from eventloom.plans import fixtures as M

FROM, TO = "2024-01-05", "2024-01-25"
IN = "ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-25 23:59:59'"
VIEW, BUY = T.Series(("view",)), T.Series(("purchase",))
DAY = "strftime(ts, '%Y-%m-%d')"


def _trend_sql(value: str, bucket: str = DAY, where: str = f"event_name = 'view' and {IN}") -> str:
    return f"select 0 as series, {bucket} as bucket, '' as breakdown, count(*) as n_events, count(distinct person_id) as n_users, {value} as value from pe where {where} group by 2"


def _trend(name: str, sql: str, **more) -> None:
    spec = replace(T.TrendSpec((VIEW,), FROM, TO), **more)
    query(sql, name)(lambda spark, sf: T.trend(M.events(spark, sf), spec))


HALF_UP = "floor({} * 100.0 + 0.5) / 100.0"
_trend("trend_total_day", _trend_sql("count(*)::double"))
_trend("trend_unique_day", _trend_sql("count(distinct person_id)::double"), metric="unique_users")
_trend("trend_events_per_user_week", _trend_sql("floor(count(*)::double / count(distinct person_id) * 100.0 + 0.5) / 100.0", "strftime(date_trunc('week', ts), '%Y-%m-%d')"), metric="events_per_user", unit="week")
_trend("trend_hour", _trend_sql("count(*)::double", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')", "event_name = 'view' and ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-12 23:59:59'"), unit="hour", date_from="2024-01-10", date_to="2024-01-12")
_trend("trend_month", _trend_sql("count(*)::double", "strftime(date_trunc('month', ts), '%Y-%m-%d')"), unit="month")
for _kind in ("sum", "avg", "min", "max"):
    _trend(f"trend_property_{_kind}", _trend_sql(f"{_kind}(k)"), metric=f"property_{_kind}", property="properties.k")
_trend("trend_property_text_numbers", _trend_sql("sum(case when plan = '12.5' then 12.5::double else 0.0 end)"), metric="property_sum", property="properties.plan")
_trend("trend_filtered", _trend_sql("count(*)::double", DAY, f"event_name = 'view' and plan = 'pro' and {IN}"), series=(T.Series(("view",), (Filter("properties.plan", "eq", "pro"),)),))
_trend("trend_timezone_shift", _trend_sql("count(*)::double", "strftime(ts - interval 5 hour, '%Y-%m-%d')", "event_name = 'view' and ts >= timestamp '2024-01-05 05:00:00' and ts <= timestamp '2024-01-26 04:59:59'"), tz="America/New_York")
_trend(
    "trend_multi_series",
    f"select case event_name when 'view' then 0 else 1 end as series, {DAY} as bucket, '' as breakdown, count(*) as n_events, count(distinct person_id) as n_users, count(*)::double as value from ev where event_name in ('view', 'purchase') and {IN} group by 1, 2",
    series=(VIEW, BUY),
)
_FIRST = """, f as (select person_id, min(ts) as ts from pe where {own} and {inside} group by person_id)
select 0 as series, strftime(ts, '%Y-%m-%d') as bucket, '' as breakdown, count(*) as n_events, count(distinct person_id) as n_users, count(*)::double as value
from f where person_id not in (select person_id from pe where {past} and ts < timestamp '2024-01-05') group by 2"""
_PRO = T.Series(("view",), (Filter("properties.plan", "eq", "pro"),))
_trend("trend_first_time_users", _FIRST.format(own="event_name = 'view' and plan = 'pro'", inside=IN, past="event_name = 'view'"), metric="first_time_users", series=(_PRO,))
_trend("trend_first_matching_event", _FIRST.format(own="event_name = 'view' and plan = 'pro'", inside=IN, past="event_name = 'view' and plan = 'pro'"), metric="first_matching_event", series=(_PRO,))
_trend(
    "trend_breakdown_topn",
    f""", b as (select *, cast(cast(k as bigint) as varchar) as b from pe where event_name = 'view' and {IN}),
top as (select b from b group by b order by count(*) desc, b limit 25)
select 0 as series, {DAY} as bucket, b as breakdown, count(*) as n_events, count(distinct person_id) as n_users, count(*)::double as value from b where b in (select b from top) group by 2, 3""",
    breakdown="properties.k",
)
_trend(
    "trend_breakdown_none",
    f"select 0 as series, {DAY} as bucket, case plan when '' then '(none)' else plan end as breakdown, count(*) as n_events, count(distinct person_id) as n_users, count(distinct person_id)::double as value from pe where event_name = 'view' and {IN} group by 2, 3",
    breakdown="properties.plan",
    metric="unique_users",
)

_MEMBERS = "mem as (select 'c_static' as cohort_id, cast(user_id as varchar) as person_id from events where user_id % 4 = 0 union select 'c_dynamic', cast(user_id as varchar) from events where user_id % 7 < 3)"


def members(spark, sf):
    return M.static_members(spark, sf).unionByName(M.materialized_members(spark, sf).drop("version"))


@query(f", {_MEMBERS} select 0 as series, {DAY} as bucket, cohort_id as breakdown, count(*) as n_events, count(distinct person_id) as n_users, count(*)::double as value from ev join mem using (person_id) where event_name = 'view' and {IN} group by 2, 3")
def trend_cohort_breakdown(spark, sf):
    return T.trend_by_cohort(M.events(spark, sf), T.TrendSpec((VIEW,), FROM, TO), members(spark, sf))


@query(
    """, d as (select cast(ts as date) as d, count(*)::double as n from ev where event_name = 'view' group by 1),
a as (select date_diff('day', date '2024-01-16', d) as position, n from d where d between date '2024-01-16' and date '2024-01-25'),
b as (select date_diff('day', date '2024-01-06', d) as position, n from d where d between date '2024-01-06' and date '2024-01-15')
select 0 as series, coalesce(a.position, b.position)::int as position, '' as breakdown, coalesce(a.n, 0.0) as value, coalesce(b.n, 0.0) as previous from a full join b on a.position = b.position"""
)
def trend_compare_previous(spark, sf):
    return T.compare(M.events(spark, sf), T.TrendSpec((VIEW,), "2024-01-16", "2024-01-25"))


TWO = T.TrendSpec((VIEW, BUY), FROM, TO)


@query(f", t as (select {DAY} as bucket, count_if(event_name = 'view')::double as a, count_if(event_name = 'purchase')::double as b from ev where event_name in ('view', 'purchase') and {IN} group by 1) select bucket, '' as breakdown, case when a = 0 then 0.0 else (b / a) * 100.0 - 1.0 end as value from t")
def trend_formula(spark, sf):
    return T.formula(T.trend(M.events(spark, sf), TWO), "B / A * 100 - 1", 2)


@query(f", t as (select case event_name when 'view' then 0 else 1 end as series, {DAY} as bucket, count(*)::double as n from ev where event_name in ('view', 'purchase') and {IN} group by 1, 2) select series, bucket, sum(n) over (partition by series order by bucket) as value from t")
def trend_cumulative(spark, sf):
    return T.cumulative(T.trend(M.events(spark, sf), TWO)).select("series", "bucket", "value")


@query(
    """, t as (select strftime(ts, '%Y-%m-%d') as bucket, count(*) as n from pe where event_name = 'view' and k < 3 and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-25 23:59:59' group by 1),
a as (select strftime(d, '%Y-%m-%d') as bucket from generate_series(timestamp '2024-01-05', timestamp '2024-01-25', interval 1 day) g(d))
select a.bucket, coalesce(n, 0) as n_events, coalesce(n, 0)::double as value from a left join t using (bucket)"""
)
def trend_gap_filled(spark, sf):
    spec = T.TrendSpec((T.Series(("view",), (Filter("properties.k", "lt", "3"),)),), FROM, TO)
    return T.gap_filled(T.trend(M.events(spark, sf), spec), spec).select("bucket", "n_events", "value")


@query(
    f""", s as (select cast(cast(k as bigint) as varchar) as b, count(*)::double as v from pe where event_name = 'view' and k < 10 and {IN} group by 1), r as (select *, row_number() over (order by v desc, b) as n from s)
select case when n <= 5 then '0 ' || b else 'Other' end as label, sum(v) as value from r group by 1"""
)
def trend_totals(spark, sf):
    spec = T.TrendSpec((T.Series(("view",), (Filter("properties.k", "lt", "10"),)),), FROM, TO, breakdown="properties.k")
    return T.totals(T.trend(M.events(spark, sf), spec))


@query(f"select n.n_name as country, count(*) as n_events from ev join nation n on ev.user_id % 25 = n.n_nationkey where event_name = 'view' and {IN} group by 1 order by 2 desc, 1 limit 200")
def world_map(spark, sf):
    return T.world_map(M.with_geography(spark, sf, M.events(spark, sf)), T.TrendSpec((VIEW,), FROM, TO))


@query(f"select isodow(ts)::int as weekday, hour(ts)::int as hour, count(*) as n_events from ev where event_name = 'view' and {IN} group by 1, 2")
def calendar_heatmap(spark, sf):
    return T.calendar_heatmap(M.events(spark, sf), T.TrendSpec((VIEW,), FROM, TO))


#: For each operator an example on JSON properties and its condition in SQL.
FILTERS = {
    "eq": (Filter("properties.plan", "eq", "pro"), "plan = 'pro'"),
    "neq": (Filter("properties.plan", "neq", "pro"), "has_plan and plan <> 'pro'"),
    "contains": (Filter("properties.plan", "contains", "r"), "contains(plan, 'r')"),
    "not_contains": (Filter("properties.plan", "not_contains", "r"), "has_plan and not contains(plan, 'r')"),
    "regex": (Filter("properties.plan", "regex", "^(pro|fr)"), "regexp_matches(plan, '^(pro|fr)')"),
    "not_regex": (Filter("properties.plan", "not_regex", "^pro$"), "not regexp_matches(plan, '^pro$')"),
    "gt": (Filter("properties.k", "gt", "50"), "k > 50"),
    "lt": (Filter("properties.plan", "lt", "1"), "case when plan = '12.5' then 12.5 else 0 end < 1"),
    "gte": (Filter("properties.k", "gte", "50"), "k >= 50"),
    "lte": (Filter("value", "lte", "100.5"), "value <= 100.5"),
    "between": (Filter("properties.k", "between", values=("10", "20")), "k between 10 and 20"),
    "not_between": (Filter("properties.k", "not_between", values=("10", "20")), "k < 10 or k > 20"),
    "is_date_before": (Filter("properties.seen", "is_date_before", "2024-02-01"), "seen = '2024-01-15'"),
    "is_date_after": (Filter("properties.seen", "is_date_after", "2024-01-10"), "seen = '2024-01-15'"),
    "is_date_exact": (Filter("properties.seen", "is_date_exact", "2024-01-15"), "seen = '2024-01-15'"),
    "in": (Filter("properties.plan", "in", values=("pro", "free")), "plan in ('pro', 'free')"),
    "not_in": (Filter("properties.plan", "not_in", values=("pro", "free")), "plan not in ('pro', 'free')"),
    "contains_multi": (Filter("properties.plan", "contains_multi", values=("ro", "12")), "contains(plan, 'ro') or contains(plan, '12')"),
    "not_contains_multi": (Filter("properties.plan", "not_contains_multi", values=("ro", "12")), "not (contains(plan, 'ro') or contains(plan, '12'))"),
    "is_set": (Filter("properties.ok", "is_set"), "ok <> ''"),
    "is_not_set": (Filter("properties.ok", "is_not_set"), "ok = ''"),
}
for _op in OPERATORS:
    _f, _sql = FILTERS[_op]
    query(f"select event_id, person_id from pe where {_sql}", f"filter_{_op}")(lambda spark, sf, f=_f: M.events(spark, sf).where(condition(f)).select("event_id", "person_id"))


# Retention, lifecycle, stickiness
def _retention_sql(unit: str, cohort: str, back_to: str, periods: int, back: str = "view") -> str:
    diff = f"date_diff('{unit}', c.b, r.b)"
    return f""", c as ({cohort}), r as (select distinct person_id, cast(date_trunc('{unit}', ts) as date) as b from ev where event_name = '{back}' and ts >= timestamp '2024-01-01' and ts <= timestamp '{back_to} 23:59:59'),
p as (select c.b, {diff} as o, count(distinct c.person_id) as n from c join r using (person_id) where {diff} between 0 and {periods} group by 1, 2),
s as (select b, count(distinct person_id) as size from c group by b)"""


_SHOW = " select strftime(s.b, '%Y-%m-%d') as cohort, s.size as cohort_size, p.o::int as \"offset\", coalesce(p.n, 0) as n_persons, floor(coalesce(p.n, 0) * 100.0 / s.size * 100.0 + 0.5) / 100.0 as rate from s left join p on s.b = p.b"
_RECUR = "select distinct person_id, cast(date_trunc('{u}', ts) as date) as b from ev where event_name = 'view' and ts >= timestamp '{a}' and ts <= timestamp '{b} 23:59:59'"
_EVER = "select person_id, cast(date_trunc('week', min(ts)) as date) as b from ev where event_name = 'view' group by person_id having min(ts) >= timestamp '2024-01-01' and min(ts) <= timestamp '2024-01-22 23:59:59'"
DAYS = R.ActivitySpec(("view",), "2024-01-08", "2024-01-16", "day", periods=6)


@query(_retention_sql("day", _RECUR.format(u="day", a="2024-01-08", b="2024-01-16"), "2024-01-22", 6) + _SHOW)
def retention_recurring_day(spark, sf):
    return R.retention(M.events(spark, sf), DAYS)


@query(_retention_sql("week", _EVER, "2024-02-12", 3) + _SHOW)
def retention_first_time_week(spark, sf):
    return R.retention(M.events(spark, sf), R.ActivitySpec(("view",), "2024-01-03", "2024-01-24", "week", kind="first_time", periods=3))


@query(_retention_sql("month", _RECUR.format(u="month", a="2024-01-01", b="2024-01-01"), "2024-02-01", 1, "purchase") + _SHOW)
def retention_return_event_month(spark, sf):
    return R.retention(M.events(spark, sf), R.ActivitySpec(("view",), "2024-01-05", "2024-01-25", "month", periods=1, return_names=("purchase",)))


@query(
    _retention_sql("day", _RECUR.format(u="day", a="2024-01-08", b="2024-01-16"), "2024-01-22", 6)
    + """, g as (select s.b, s.size, o.o from s cross join (select unnest(range(0, 7)) as o) o where s.b + cast(o.o + 1 as int) <= date '2024-01-20')
select g.o::int as "offset", floor(sum(coalesce(p.n, 0)) * 100.0 / sum(g.size) * 100.0 + 0.5) / 100.0 as rate from g left join p on g.b = p.b and g.o = p.o group by 1"""
)
def retention_average(spark, sf):
    return R.retention_average(M.events(spark, sf), DAYS, "2024-01-20")


def _life_sql(unit: str, start: str, low: str, high: str) -> str:
    return f""", a as (select distinct person_id, cast(date_trunc('{unit}', ts) as date) as b from ev where event_name = 'purchase' and ts >= timestamp '{start}' and ts <= timestamp '{high} 23:59:59'),
old as (select distinct person_id from ev where event_name = 'purchase' and ts < timestamp '{start}'),
m as (select *, lag(b) over w as p, lead(b) over w as n from a window w as (partition by person_id order by b)),
st as (select person_id, b, case when p is null and person_id not in (select person_id from old) then 'new' when p = cast(b - interval 1 {unit} as date) then 'returning' else 'resurrecting' end as status from m where b >= date '{low}'
union all select person_id, cast(b + interval 1 {unit} as date), 'dormant' from m where (n is null or n <> cast(b + interval 1 {unit} as date)) and cast(b + interval 1 {unit} as date) between date '{low}' and date '{high}')"""


_LIFE = " select strftime(b, '%Y-%m-%d') as bucket, status, case status when 'dormant' then -count(distinct person_id) else count(distinct person_id) end as n_persons from st group by b, status"
LIFE = R.ActivitySpec(("purchase",), FROM, TO, "day")


@query(_life_sql("day", "2024-01-04", FROM, TO) + _LIFE)
def lifecycle_day(spark, sf):
    return R.lifecycle(M.events(spark, sf), LIFE)


@query(_life_sql("week", "2024-01-01", "2024-01-08", "2024-01-28") + _LIFE)
def lifecycle_week(spark, sf):
    return R.lifecycle(M.events(spark, sf), replace(LIFE, date_from="2024-01-08", date_to="2024-01-28", unit="week"))


@query(_life_sql("day", "2024-01-04", FROM, TO) + f", l as ({_LIFE}) select status, sum(n_persons)::bigint as n_persons from l group by status")
def lifecycle_totals(spark, sf):
    return R.lifecycle_totals(M.events(spark, sf), LIFE)


def _stick_sql(unit: str, total: int) -> str:
    return f""", a as (select person_id, count(distinct date_trunc('{unit}', ts)) as n_active from ev where event_name = 'purchase' and {IN} group by 1)
select n_active, count(*) as n_persons, floor(count(*) * 100.0 / sum(count(*)) over () * 10.0 + 0.5) / 10.0 as share, {total}::bigint as total_periods from a group by n_active"""


@query(_stick_sql("day", 21))
def stickiness_day(spark, sf):
    return R.stickiness(M.events(spark, sf), LIFE)


@query(_stick_sql("week", 4))
def stickiness_week(spark, sf):
    return R.stickiness(M.events(spark, sf), replace(LIFE, unit="week"))


@query(f"select event_id from ev where event_name = 'view' and {IN}", "shared_filter_scan")
def shared_filter_scan(spark, sf):
    from eventloom.functions.filters import matches
    from eventloom.functions.timeutil import in_range

    return M.events(spark, sf).where(matches(("view",)) & in_range(FROM, TO)).select(F.col("event_id"))
